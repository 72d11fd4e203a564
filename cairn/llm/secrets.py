"""Operator 2: secret scans with corpus-wide ownership frequency, in SQL expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, table

#: The three base patterns (kind, pattern, group that holds the secret, its least length).
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32)]
#: A bare run that may be a secret although no base pattern names it.
BARE = r"[A-Za-z0-9+/_=-]{24,}"


#: Numbers of an array that are summed up one after another; longer arrays are summed up by pieces.
PIECE = 128
SPANS = "array<struct<start:int,kind_no:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: what a lambda names from outside is worked out at each call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        at = op(s["at"], x)
        return F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out"))

    return F.aggregate(values, zero, add, lambda s: s["out"])


def running(values: Column, start: int, op: Callable[[Column, Column], Column]) -> Column:
    """op over each prefix of an array of integers, from start on.

    An array grows by copying, so prefixes are made within pieces of PIECE numbers, and once more over
    the results of whole pieces: the time goes with the length.
    """

    def of(values: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(PIECE))
        return let(F.transform(first, lambda i: F.slice(values, i, F.lit(PIECE))), summed)

    def summed(pieces: Column) -> Column:
        whole = F.transform(pieces, lambda p: F.aggregate(p, F.lit(start), op))
        before = F.concat(F.array(F.lit(start)), _running(whole, F.lit(start), op))
        return let(before, lambda at: F.flatten(F.transform(pieces, lambda p, i: _running(p, F.get(at, i), op))))

    return let(values, of)


def spans_of(text: Column, kind_no: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind_no, end, value>> of a pattern's leftmost non-overlapping matches.

    The text between matches comes from split() and the matches from regexp_extract_all(); both
    follow the same left-to-right search, so their lengths add up to positions in code points.
    access and hex match maximal runs, so their least length can stand in the pattern itself.
    """
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    span = lambda x: F.struct((x["end"] - F.length(x["whole"])).alias("start"), F.lit(kind_no).alias("kind_no"), x["end"].alias("end"), x["value"].alias("value"))

    def placed(whole: Column) -> Column:
        gap = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        ends = running(F.zip_with(gap, whole, lambda g, w: F.length(g) + F.length(w)), 0, lambda a, b: a + b)
        every = F.transform(F.arrays_zip(ends.alias("end"), whole.alias("whole"), value.alias("value")), span)
        return F.filter(every, lambda x: F.length(x["value"]) >= least)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.from_json(F.lit("[]"), SPANS))


def apart(bare: Column, base: Column) -> Column:
    """Those of bare that touch none of base: none that begins before reaches into them, and none begins in them."""
    far = 2**31 - 1
    is_base = lambda x: x["kind_no"] < len(KINDS)

    def alone(both: Column) -> Column:
        reach = running(F.transform(both, lambda x: F.when(is_base(x), x["end"]).otherwise(0)), 0, lambda a, b: F.greatest(a, b))
        next_ = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(is_base(x), x["start"]).otherwise(far))), far, lambda a, b: F.least(a, b)))
        marked = F.arrays_zip(both.alias("x"), reach.alias("reach"), next_.alias("next"))
        kept = F.filter(marked, lambda m: ~is_base(m["x"]) & (m["reach"] <= m["x"]["start"]) & (m["next"] >= m["x"]["end"]))
        return F.transform(kept, lambda m: m["x"])

    both = F.array_sort(F.transform(F.concat(base, bare), lambda x: F.struct(x["start"], x["kind_no"], x["end"], x["value"])))
    return F.when((F.size(base) == 0) | (F.size(bare) == 0), bare).otherwise(let(both, alone))


def _listed(spans: Column, names: list[str]) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["kind_no"], x["end"])))
    names_col = F.array(*[F.lit(n) for n in names])
    one = lambda x: F.concat_ws(
        ":", F.element_at(names_col, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string")
    )
    return F.array_join(F.transform(ordered, one), ",")


def scan_secrets(
    docs: DataFrame, repo: str = "doc_id", owner: str = "source", copied_owners: int = 3, owned_repos: int = 3
) -> DataFrame:
    """Secrets in every whole text, and how many repositories and owners hold each value.

    Base spans follow KINDS. Bare runs of 24 or more token characters with lower-case and
    upper-case letters and digits, touching no base span, are candidates too. Every value is
    hashed, and each hash is counted over distinct owners and repositories of all rows. A
    value with copied_owners or more owners is a copied example; one that a single owner
    holds in at most owned_repos repositories is owned, and so looks live. Bare runs that are
    owned join the spans under the kind "owned"; base spans always stay.

    Returns one row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied,
    n_owned (candidates of either kind in the row). Null text counts as empty (no spans), a null
    repository or owner as the empty name. Repeated rows give repeated results and count once as
    holders. Other columns are ignored; an empty table gives an empty result.

    The text is scanned once, in a narrow step; only hashes and positions of candidates travel.
    A hash held by a third of all rows is counted by partial sums, and its join back to the rows
    is a plain equi-join that adaptive execution may split.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("_repo"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), F.monotonically_increasing_id().alias("_row"),
        *[spans_of(text, k, p, g, n).alias(f"_{name}") for k, (name, p, g, n) in enumerate(KINDS)],
        spans_of(text, len(KINDS), BARE, 0, 24).alias("_bare"),
    )
    base = F.concat(*[F.col(f"_{k[0]}") for k in KINDS])
    mixed = lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]")
    hashed = lambda x: F.struct(x["start"], x["kind_no"], x["end"], F.sha2(x["value"], 256).alias("hash"))
    found = scratch.keep(
        rows.withColumn("_base", base).withColumn("_bare", apart(F.filter("_bare", mixed), F.col("_base"))).select(
            "doc_id", "_repo", "_owner", "_row",
            *[F.size(f"_{k[0]}").cast("long").alias(f"n_{k[0]}") for k in KINDS],
            F.transform(F.concat("_base", "_bare"), hashed).alias("_found"),
        ),
        "found",
    )
    each = found.filter(F.size("_found") > 0).select("_row", "_repo", "_owner", F.explode("_found").alias("_x")).select(
        "_row", "_repo", "_owner", "_x.*"
    )
    owners = (
        each.groupBy("hash", "_owner", "_repo").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("_repos"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("_repos").alias("n_repos"))
    )
    judged = each.join(owners, "hash").select(
        "_row", "start", "kind_no", "end", (F.col("n_owners") >= copied_owners).alias("copied"),
        ((F.col("n_owners") == 1) & (F.col("n_repos") <= owned_repos)).alias("owned"),
    )
    bare = F.col("kind_no") == len(KINDS)
    per_row = judged.groupBy("_row").agg(
        F.count_if("copied").alias("n_copied"), F.count_if("owned").alias("n_owned"),
        F.collect_list(F.when(bare & F.col("owned"), F.struct("start", "kind_no", "end"))).alias("_more"),
    )
    names = [k[0] for k in KINDS] + ["owned"]
    slim = F.transform("_found", lambda x: F.struct(x["start"], x["kind_no"], x["end"]))
    base = F.filter(slim, lambda x: x["kind_no"] < len(KINDS))
    more = F.coalesce(F.col("_more"), F.array().cast("array<struct<start:int,kind_no:int,end:int>>"))
    return found.join(per_row, "_row", "left").select(
        "doc_id", *[f"n_{k[0]}" for k in KINDS],
        F.sha2(_listed(base, names), 256).alias("base_sha256"), _listed(F.concat(base, more), names).alias("spans"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("n_owned", F.lit(0)).alias("n_owned"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _sql_spans(kind_no: int, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {kind_no} AS kind_no, i, list_sum(list_transform(gaps[:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS start, length(hits[i]) AS n, vals[i] AS value
      FROM (SELECT rid, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT rid, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits,
               regexp_extract_all(text, '{p}', {group}) AS vals FROM d))"""


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS repo,
                  coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
every AS ({' UNION ALL '.join(_sql_spans(k, p, g) for k, (_, p, g, _n) in enumerate(KINDS))}),
base AS (SELECT rid, kind_no, start, start + n AS stop, value FROM every
         WHERE length(value) >= CASE kind_no WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END),
bare AS (SELECT rid, 3 AS kind_no, start, start + n AS stop, value FROM ({_sql_spans(3, BARE, 0)}) b
         WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
           AND NOT EXISTS (SELECT 1 FROM base WHERE base.rid = b.rid AND base.start < b.start + b.n AND b.start < base.stop)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
held AS (SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repo)) AS n_repos
         FROM cand JOIN d USING (rid) GROUP BY value),
judged AS (SELECT cand.*, n_owners >= 3 AS copied, n_owners = 1 AND n_repos <= 3 AS owned,
                  CASE kind_no WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END
                  || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS line
           FROM cand JOIN held USING (value)),
agg AS (SELECT rid, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
               count(*) FILTER (kind_no = 2) AS n_hex, count(*) FILTER (copied) AS n_copied, count(*) FILTER (owned) AS n_owned,
               coalesce(string_agg(line, ',' ORDER BY start, kind_no) FILTER (kind_no < 3), '') AS base,
               coalesce(string_agg(line, ',' ORDER BY start, kind_no) FILTER (kind_no < 3 OR owned), '') AS spans
        FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_copied, 0) AS n_copied, coalesce(n_owned, 0) AS n_owned
FROM d LEFT JOIN agg USING (rid)
"""
