"""Operator 9: shards by jump consistent hashing, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, gapless_rank, table

#: The multiplier of the published generator, and 32- and 16-bit masks.
MULTIPLIER = 2862933555777941757
M32, M16 = 0xFFFFFFFF, 0xFFFF
#: A key jumps once every time the number of shards grows by a factor of e on average, so a
#: path of more than this many jumps has a chance below 1e-50 for any number of shards.
MOST_JUMPS = 128


def _low(x: Column, c: int) -> Column:
    """x * c modulo 2**32 for 32-bit x and c, without leaving 64-bit range."""
    return x * (c & M16) + F.shiftleft((x * (c >> 16)).bitwiseAND(M16), 16)


def key_of(col: str) -> Column:
    """A 60-bit number from a key of any type; null counts as the empty string."""
    digits = F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def jump_shards(key: Column, n: int) -> Column:
    """struct(shard among n, shard among n + 1) of a 64-bit key.

    Both come from one walk: the shard among n is the last stop before n.
    """
    lo_c, hi_c = MULTIPLIER & M32, MULTIPLIER >> 32

    def step(s: Column, _: Column) -> Column:
        lo, hi, at = s["lo"], s["hi"], s["at"]
        p, q = lo * (lo_c & M16), lo * (lo_c >> 16)
        t = p + F.shiftleft(q.bitwiseAND(M16), 16) + 1
        carry = F.shiftright(t, 32) + F.shiftright(q, 16)
        new_hi = (carry + _low(hi, lo_c) + _low(lo, hi_c)).bitwiseAND(M32)
        jump = F.floor((at + 1) * (F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + 1)))
        moved = F.struct(
            t.bitwiseAND(M32).alias("lo"), new_hi.alias("hi"), jump.alias("at"),
            F.when(at < n, at).otherwise(s["b"]).alias("b"), at.alias("grown"),
        )
        return F.when(at > n, s).otherwise(moved)

    start = F.struct(
        key.bitwiseAND(M32).alias("lo"), F.shiftrightunsigned(key, 32).alias("hi"),
        F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("grown"),
    )
    steps = F.sequence(F.lit(1), F.lit(min(n + 1, MOST_JUMPS)))
    if n < MOST_JUMPS:
        return F.aggregate(steps, start, step, lambda s: F.struct(s["b"].alias("shard"), s["grown"].alias("grown_shard")))
    whole = lambda s: F.when(s["at"] > n, s["b"]).otherwise(F.raise_error(F.lit("a walk of too many jumps")).cast("long"))
    return F.aggregate(steps, start, step, lambda s: F.struct(whole(s).alias("shard"), s["grown"].alias("grown_shard")))


def assign_shards(df: DataFrame, key: str, n_shards: int) -> DataFrame:
    """df with shard and grown_shard (the shard if one more is appended), a narrow step.

    A row's shard depends on its key and n_shards alone; appending a shard moves about
    1 / (n_shards + 1) of the keys, all of them into the new shard.
    """
    return (
        df.withColumn("_s", jump_shards(key_of(key), n_shards))
        .withColumn("shard", F.col("_s.shard").cast("int"))
        .withColumn("grown_shard", F.col("_s.grown_shard").cast("int"))
        .drop("_s")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Documents dealt to shards by doc_id, with a gapless place inside each shard.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Null text counts as no
    bytes (size 1, checksum 0); a null doc_id is hashed as the empty string and comes first.
    Repeated rows each get a slot. Slots follow doc_id, size, checksum. Other columns are
    ignored, so names of theirs cannot clash; an empty table gives an empty result.

    The text is read once and only its length and checksum travel. A shard's rows lie in many
    ranges of doc_id, so neither a shard nor a repeated key is numbered in one task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_at"),
    )
    order = ["doc_id", "size", "text_crc32", "_at"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.keep(sizes, "sizes")  # ranges are sampled first: that reads this table twice, not the texts
    ranged = rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    placed = scratch.keep(assign_shards(ranged, "doc_id", n_shards), "placed")
    scratch.drop_all_but("placed")
    ranked = gapless_rank(placed, ["shard"], "_range", order, "slot")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 16)


#: Recursive steps of the same walk in 128-bit arithmetic; the checksum byte by byte from a table.
OP9_SQL = """
WITH RECURSIVE bits AS (
  SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         CAST(xor(list_reduce(list_prepend(4294967295, list_transform(
                regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
              lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS BIGINT) AS crc,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents, tab
), walk AS (
  SELECT rid, CAST(key AS HUGEINT) AS k, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS grown, 0 AS i FROM d
  UNION ALL
  SELECT rid, nk, CAST(floor((pos + 1) * (2147483648.0::DOUBLE / CAST((nk >> 33) + 1 AS DOUBLE))) AS BIGINT),
         CASE WHEN pos < 16 THEN pos ELSE b END, pos, i + 1
  FROM (SELECT *, (((k & 4294967295::HUGEINT) * 2862933555777941757::HUGEINT
                    + ((((k >> 32) * 2862933555777941757::HUGEINT) & 4294967295::HUGEINT) << 32) + 1)
                   & 18446744073709551615::HUGEINT) AS nk FROM walk)
  WHERE pos < 17
), last AS (SELECT rid, max_by(b, i) AS shard, max_by(grown, i) AS grown_shard FROM walk GROUP BY rid)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS BIGINT) AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM d JOIN last USING (rid)
"""
