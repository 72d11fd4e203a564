"""A landed change feed as a source whose offset is the sync token, and the documents kept in step with it.

A feed is a folder with one folder a token, token=<token>, of files with one payload a line. Tokens
sort as text. A token's folder must appear whole (land() writes elsewhere and renames).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from cairn.functions.text import slugify
from cairn.operators.mutations import last_of
from cairn.registry import query
from cairn.sources.scratch import fresh_root
from cairn.sources.views import Graph

_BRAND = "struct<id:string,name:string,country:string,logo_url:string,website:string,product_count:bigint>"
_PRODUCT = "struct<id:string,name:string,brand_id:string,brand_name:string,category:string,subcategory:string,image_url:string>"
_THREE = "struct<added:array<{0}>,updated:array<{0}>,deleted:array<{0}>>"
PAYLOAD = f"brands {_THREE.format(_BRAND)}, products {_THREE.format(_PRODUCT)}, next_sync_token string, full_sync boolean"
#: The order in which the changes of one payload count.
OPS = ("added", "updated", "deleted")
#: Changes in one payload that land() writes, about.
PAGE = 1000


class _File(InputPartition):
    def __init__(self, token: str, path: str):
        self.token, self.path = token, path


class _Folder:
    """What both readers need: the files of the tokens behind one and up to another."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.since = options.get("since") or ""

    def files(self, after: str, upto: str | None) -> list[_File]:
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        out = []
        for folder in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if folder.type == pafs.FileType.Directory and folder.base_name.startswith("token="):
                token = unquote(folder.base_name[6:])
                if after < token and (upto is None or token <= upto):
                    found = fs.get_file_info(pafs.FileSelector(folder.path))
                    out += [_File(token, f.path) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
        return sorted(out, key=lambda f: (f.token, f.path))

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        """Lines as they are; Spark parses them."""
        fs, _ = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), "")
        with fs.open_input_stream(part.path) as f:
            rest, size = b"", 1 << 20
            while True:
                got = f.read(size)
                *lines, rest = (rest + got).split(b"\n")
                if not got:
                    lines = [rest]
                lines = [x.decode() for x in lines if x.strip()]
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([part.token] * len(lines)), pa.array(lines, pa.string())], ["token", "payload"])
                if not got:
                    return


class _Batch(_Folder, DataSourceReader):
    def partitions(self) -> list[_File]:
        return self.files(self.since, None) or [_File("", "")]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from super().read(part)


class _Stream(_Folder, DataSourceStreamReader):
    """Offsets are {"token": ...}: Spark's checkpoint holds how far the feed was applied."""

    def initialOffset(self) -> dict:
        self.seen = self.since
        return {"token": self.since}

    def latestOffset(self) -> dict:
        self.seen = max([getattr(self, "seen", self.since), *[f.token for f in self.files(getattr(self, "seen", self.since), None)]])
        return {"token": self.seen}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return self.files(start["token"], end["token"]) or [_File("", "")]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from super().read(part)

    def commit(self, end: dict) -> None:
        pass


class ChangeFeed(DataSource):
    """format("change_feed").option("since", token).load(folder): token and payload of all lines behind a token."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return "token string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def read_feed(spark: SparkSession, path: str, since: str = "") -> DataFrame:
    """The landed lines behind a token, once."""
    spark.dataSource.register(ChangeFeed)
    return spark.read.format("change_feed").option("since", since).load(path)


def stream_feed(spark: SparkSession, path: str) -> DataFrame:
    """The landed lines as a stream."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("change_feed").load(path)


def land(payloads: DataFrame, path: str) -> None:
    """token, payload as a feed folder: written aside, then each token's folder is moved in whole."""
    spark = payloads.sparkSession
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    payloads.select("token", F.col("payload").alias("value")).write.partitionBy("token").text(aside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(hadoop.Path(aside)):
        if s.getPath().getName().startswith("token="):
            fs.rename(s.getPath(), hadoop.Path(f"{path}/{s.getPath().getName()}"))
    fs.delete(hadoop.Path(aside), True)


def _placed(n: int, op: str) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(F.lit(op).alias("op"), F.struct(F.lit(n).alias("n"), i.alias("i")).alias("place"), x.alias("x"))


def changes(lines: DataFrame) -> DataFrame:
    """entity, doc_id, op, token, place and the fields of the document: one row a change.

    A brand's document is named by its slug, a product's by its brand's and its own. Lines that are
    no payload give no rows. place orders the changes of one payload.
    """
    p = lines.select("token", F.from_json("payload", PAYLOAD).alias("p"))
    none = F.lit(None).cast("string")
    out = []
    for entity in ("brands", "products"):
        kind = f"array<{_BRAND if entity == 'brands' else _PRODUCT}>"
        listed = F.concat(*[F.transform(F.coalesce(F.col(f"p.{entity}.{op}"), F.array().cast(kind)), _placed(n, op)) for n, op in enumerate(OPS)])
        rows = p.select("token", F.explode(listed).alias("c")).select("token", "c.op", "c.place", "c.x.*").filter("name IS NOT NULL")
        text = lambda c: F.coalesce(c, F.lit(""))
        if entity == "brands":
            fields = [text(F.col(c)).alias(c) for c in ("country", "logo_url", "website")] + [F.coalesce("product_count", F.lit(0)).alias("product_count")]
            fields += [none.alias(c) for c in ("brand", "brand_id", "category", "subcategory", "image_url")]
            doc = slugify("name")
        else:
            fields = [none.alias(c) for c in ("country", "logo_url", "website")] + [F.lit(None).cast("long").alias("product_count")]
            fields += [text(F.col("brand_name")).alias("brand"), *[text(F.col(c)).alias(c) for c in ("brand_id", "category", "subcategory", "image_url")]]
            doc = F.concat_ws("/", slugify("brand_name"), slugify("name"))
        out.append(rows.select(F.lit(entity).alias("entity"), doc.alias("doc_id"), "op", "token", "place", "name", F.col("id").alias("graph_id"), *fields))
    return out[0].unionByName(out[1])


class Mirror:
    """Documents kept in step with a feed, in a folder that executors share.

    The saved token is the offset in Spark's checkpoint. Each micro-batch writes the next version of the
    documents under its own number and overwrites it if it is replayed, so a restart after any
    failure changes nothing. clear_token() begins a new epoch: the next sync reads the feed from
    its start and applies it to the documents that are there.
    """

    def __init__(self, spark: SparkSession, feed: str, root: str):
        self.spark, self.feed, self.root = spark, feed, root

    def _names(self, path: str, prefix: str) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        p = hadoop.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if n.startswith(prefix))

    def _epoch(self) -> str:
        return (self._names(f"{self.root}/state", "epoch=") or [f"epoch={0:06d}"])[-1]

    def saved_token(self) -> str | None:
        """The token up to which the feed was applied; none before the first sync of an epoch."""
        state = f"{self.root}/state/{self._epoch()}"
        done = [int(n) for n in self._names(f"{state}/commits", "") if n.isdigit()]
        if not done:
            return None
        lines = self.spark.read.text(f"{state}/offsets/{max(done)}").collect()  # a few lines: version, settings, one offset a source
        return json.loads(lines[-1]["value"])["token"]

    def clear_token(self) -> None:
        new = int(self._epoch()[6:]) + 1
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        p = hadoop.Path(f"{self.root}/state/epoch={new:06d}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)

    def documents(self) -> DataFrame | None:
        """The last version whose batch has ended."""
        versions = self._names(f"{self.root}/documents", "v=")
        return self.spark.read.parquet(f"{self.root}/documents/{versions[-1]}") if versions else None

    def sync(self, full: bool = False) -> dict:
        """Apply what has landed behind the saved token; returns what the last run wrote, and the new token."""
        if full:
            self.clear_token()
        epoch, before = self._epoch(), self.saved_token()
        stats = {"written": 0, "deleted": 0}

        def batch(lines: DataFrame, n: int) -> None:
            mine = f"v={epoch[6:]}-{n:09d}"
            older = [v for v in self._names(f"{self.root}/documents", "v=") if v < mine]
            last = last_of(changes(lines), ["entity", "doc_id"], ["token", "place"]).drop("place").persist()
            try:
                new = last.filter("op <> 'deleted'").drop("op")
                if older:
                    old = self.spark.read.parquet(f"{self.root}/documents/{older[-1]}")
                    gone = old.join(last.select("entity", "doc_id"), ["entity", "doc_id"], "left_anti")
                    new = gone.unionByName(new)
                new.write.mode("overwrite").parquet(f"{self.root}/documents/{mine}")
                for r in last.groupBy((F.col("op") == "deleted").alias("gone")).count().collect():
                    stats["deleted" if r["gone"] else "written"] += r["count"]
            finally:
                last.unpersist()

        q = stream_feed(self.spark, self.feed).writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.root}/state/{epoch}").trigger(availableNow=True).start()
        q.awaitTermination()
        return stats | {"sync_type": "incremental" if before else "full", "sync_token": self.saved_token()}


def _products(g: Graph) -> DataFrame:
    """Product changes of the work events: what an event of a user id says of the item of that number."""
    e = F.col("status")
    op = F.when(e == "signup", "added").when(e.isin("purchase", "click"), "updated").when(e == "error", "deleted")
    items = g.item().select(F.col("node_id").alias("entity"), "name", "brand", "category")
    rows = g.work_event().withColumn("op", op).filter("op IS NOT NULL").join(items, "entity")
    return rows.select("event_id", "op", F.date_format("ts", "yyyy-MM-dd").alias("token"), "entity", "name", "brand", "category")


def land_products(g: Graph, path: str) -> None:
    """The product changes as a feed of one token a day, in payloads of PAGE changes, about; a document's changes of a day share one."""
    rows = _products(g)
    pages = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / PAGE).alias("pages"))
    text = lambda c: F.col(c).cast("string")
    product = F.struct(
        "event_id", text("entity").alias("id"), "name", F.lit("").alias("brand_id"), F.col("brand").alias("brand_name"), "category",
        F.concat(F.lit("https://img.example.com/"), text("event_id")).alias("image_url"),
    )
    each = lambda op: F.sort_array(F.collect_list(F.when(F.col("op") == op, product))).alias(op)
    paged = rows.join(pages, "token").groupBy("token", F.pmod(F.xxhash64("brand", "name"), F.col("pages")).alias("page")).agg(*[each(op) for op in OPS])
    payload = F.to_json(F.struct(F.struct(*OPS).alias("products"), F.col("token").alias("next_sync_token"), F.lit(False).alias("full_sync")))
    land(paged.select("token", payload.alias("payload")), path)


def _slug_sql(c: str) -> str:
    return f"""coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[''"]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"""


_CHANGES = f"""pc AS (SELECT event_id, CASE status WHEN 'signup' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS op, strftime(ts, '%Y-%m-%d') AS token, i.name, coalesce(i.brand, '') AS brand,
    coalesce(i.category, '') AS category, CAST(i.node_id AS VARCHAR) AS graph_id, {_slug_sql("i.brand")} || '/' || {_slug_sql("i.name")} AS doc_id
  FROM work_event JOIN item i ON i.node_id = entity WHERE status IN ('signup', 'purchase', 'click', 'error') AND i.name IS NOT NULL)"""


def _mirror(g: Graph) -> Mirror:
    root = fresh_root(g.spark, "feed")
    land_products(g, f"{root}/feed")
    return Mirror(g.spark, f"{root}/feed", f"{root}/mirror")


@query("feed_documents", f""", {_CHANGES}
  SELECT doc_id, name, brand, category, graph_id, 'https://img.example.com/' || event_id AS image_url, token FROM pc
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY token DESC, op DESC, event_id DESC) = 1 AND op < 2""")
def feed_documents(g: Graph) -> DataFrame:
    """The documents after the whole landed feed has gone through the stream, each with the token of its last change."""
    mirror = _mirror(g)
    mirror.sync()
    return mirror.documents().select("doc_id", "name", "brand", "category", "graph_id", "image_url", "token")


@query("feed_changes_since", f""", {_CHANGES}
  SELECT token, CASE op WHEN 0 THEN 'added' WHEN 1 THEN 'updated' ELSE 'deleted' END AS op, count(*) AS n, count(DISTINCT doc_id) AS documents FROM pc WHERE token > '2024-01-15' GROUP BY 1, 2""")
def feed_changes_since(g: Graph) -> DataFrame:
    """The changes behind a token by day and kind, read from the landed feed."""
    mirror = _mirror(g)
    rows = changes(read_feed(g.spark, mirror.feed, "2024-01-15"))
    return rows.groupBy("token", "op").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))
