"""Duplicate detection: probes, pairs within a brand, leader clusters and vocabulary matches.

Pairs are pairs of different names; for clusters, of different names and brands: equal items
are one node, so copies never multiply. Candidates come from equi-joins on tokens or brands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import fuzzy
from cairn.functions.text import name_tokens, normalized_name
from cairn.operators import rules
from cairn.operators.aggregates import first_by
from cairn.operators.graph import either_contains
from cairn.operators.quality import messy_brands
from cairn.registry import query
from cairn.sources.scratch import keeper
from cairn.sources.views import Graph


#: Names of a brand that are compared with as many others by one group of the join.
BLOCK = 250
#: Characters that are counted one by one; all others are counted as one.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: How often a letter has bits of its own, and letters that are counted in one number.
COUNTED, A_NUMBER = 5, 12


def letter_bits(c: Column) -> dict[str, Column]:
    """How often each of LETTERS stands in a text, as so many bits, COUNTED at most; letters: how many there are.

    The bits that two texts have in common are the letters they share. Those beyond COUNTED are letters less bits.
    """
    each = [F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in LETTERS]
    ones = [F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(COUNTED))) - 1 for n in each]
    parts = [ones[i : i + A_NUMBER] for i in range(0, len(ones), A_NUMBER)]
    out = {f"b{k}": reduce(Column.__add__, [x * F.lit(1 << COUNTED * i) for i, x in enumerate(part)]) for k, part in enumerate(parts)}
    return out | {"letters": reduce(Column.__add__, each)}


def pairs_within_brand(g: Graph, least: float = 85.0) -> DataFrame:
    """Different names of one brand whose composite similarity is least or more.

    Of the composite, partial ratio and token set ratio hold 45 of 100 at most. The ratio and the
    token sort ratio are at most twice the letters that both names have over their lengths, so
    counts of letters rule most pairs out before any is aligned. A brand's names are dealt to
    blocks, and each pair of blocks is a group of its own: a brand of very many names is no load
    for one task, though all its pairs of blocks are met. What is left is dealt by its two names,
    which are aligned once, not again for each brand that has both.
    """
    names = g.item().filter("name IS NOT NULL").select(F.lower(F.coalesce("brand", F.lit("unknown"))).alias("brand"), F.lower("name").alias("name")).distinct()
    blocks = names.groupBy("brand").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    single = F.trim(F.regexp_replace("name", r"\s+", " "))
    bits = letter_bits(F.col("name"))
    numbers = [c for c in bits if c != "letters"]
    dealt = names.join(blocks, "brand").select("brand", "name", F.length("name").alias("n"), F.length(single).alias("m"), *[x.alias(c) for c, x in bits.items()],
                                               F.pmod(F.xxhash64("name"), F.col("blocks")).alias("k"), "blocks")
    dealt = dealt.withColumn("over", reduce(Column.__sub__, [F.col("letters"), *[F.bit_count(c) for c in numbers]]))
    kept = ("name", "n", "m", "letters", "over", *numbers)
    one = dealt.select("brand", F.col("k").alias("i"), F.explode(F.sequence(F.col("k"), F.col("blocks") - 1)).alias("j"), *[F.col(c).alias(f"{c}1") for c in kept])
    two = dealt.select("brand", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))).alias("i"), F.col("k").alias("j"), *[F.col(c).alias(f"{c}2") for c in kept])
    share = lambda both, c, weight: F.when(F.col(f"{c}1") + F.col(f"{c}2") > 0, both * 2.0 * weight / (F.col(f"{c}1") + F.col(f"{c}2"))).otherwise(weight)
    shorter = share(F.least("n1", "n2"), "n", 30.0) + share(F.least("m1", "m2"), "m", 25.0) + 45
    shared = reduce(Column.__add__, [F.bit_count(F.col(f"{c}1").bitwiseAND(F.col(f"{c}2"))) for c in numbers]) + F.least("over1", "over2")
    common = lambda c: shared + F.least(F.col(f"{c}1") - F.col("letters1"), F.col(f"{c}2") - F.col("letters2"))
    most = share(common("n"), "n", 30.0) + share(common("m"), "m", 25.0) + 45
    once = (F.col("i") != F.col("j")) | (F.col("name1") < F.col("name2"))
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few names are many pairs: a given number is not made smaller
    spread = lambda df: df.repartition(tasks, "brand", "i", "j")
    pairs = spread(one).join(spread(two), ["brand", "i", "j"]).filter(once & (shorter >= least - 1e-6) & (most >= least - 1e-6))
    pairs = pairs.select("brand", F.least("name1", "name2").alias("name"), F.greatest("name1", "name2").alias("other"))
    pairs = pairs.repartition(tasks, "name", "other").sortWithinPartitions("name", "other")
    return pairs.withColumn("similarity", fuzzy.scored(lambda a, b: fuzzy.in_brand(a, b, least), F.col("name"), F.col("other"), in_place=True)).filter(F.col("similarity") >= least)


@query("dup_pairs_in_brand")
def dup_pairs_in_brand(g: Graph) -> DataFrame:
    return pairs_within_brand(g).select("brand", "name", "other", F.round("similarity", 6).alias("similarity"))


def probe(g: Graph, name: str, brand: str | None, least: float = 65.0, k: int = 15) -> DataFrame:
    """The k best matches of a name: the brand's items, items that hold one of its first three terms,
    and items that contain it or are contained, which gain 10. A (name, brand) is scored in the
    first of these that yields it."""
    items = g.item().filter("name IS NOT NULL").select("node_id", "name", "brand")
    terms = [t for t in name.lower().replace("-", " ").split()[:3] if len(t) >= 3]
    streams = []
    if brand:
        streams.append((items.filter(either_contains(F.col("brand"), F.lit(brand))), 1, 0))
    for i, t in enumerate(terms):
        streams.append((items.filter(F.contains(F.lower("name"), F.lit(t))).orderBy("name", "node_id").limit(20), 2 + i, 0))
    streams.append((items.filter(either_contains(F.col("name"), F.lit(name))).orderBy("name", "node_id").limit(15), 9, 10))
    every = None
    for rows, order, boost in streams:
        rows = rows.withColumn("stream", F.lit(order)).withColumn("boost", F.lit(boost))
        every = rows if every is None else every.unionByName(rows)
    first = first_by(every, ["name", "brand"], ["stream", "node_id"])
    score = fuzzy.scored(fuzzy.composite, normalized_name("name"), normalized_name(F.lit(name)))
    bonus = F.when(fuzzy.scored(fuzzy.ratio, F.lower("brand"), F.lit((brand or "").lower())) > 80, 15).otherwise(0)
    scored = first.withColumn("similarity", F.least(F.lit(100.0), score + bonus + F.col("boost")))
    return scored.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "name", "node_id").limit(k)


@query("dup_probe")
def dup_probe(g: Graph) -> DataFrame:
    band = F.when(F.col("similarity") >= 95, "same").when(F.col("similarity") >= 85, "likely").when(F.col("similarity") >= 75, "possible").otherwise("similar")
    return probe(g, "red widget", "Brand#17").select("node_id", "name", "brand", F.round("similarity", 6).alias("similarity"), band.alias("band"))


def shared_marks(nodes: DataFrame) -> DataFrame:
    """key, mark: what makes two nodes (key, name, brand) alike, once each: two tokens of the name, or one token with a brand that is not empty.

    All nodes with a mark in common are alike, so a mark that a third of them has is as many rows, not their square.
    """
    words = nodes.select("key", "brand", F.array_sort(name_tokens("name")).alias("w"))
    pairs = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda y: F.concat_ws("\1", x, y))))
    branded = F.when(F.col("brand") != "", F.transform("w", lambda x: F.concat_ws("\2", x, "brand"))).otherwise(F.array().cast("array<string>"))
    return words.select("key", F.explode(F.concat(pairs, branded)).alias("mark")).distinct()


def leaders(marks: DataFrame, keep) -> DataFrame:
    """key, leader of every node of marks (key, mark), where nodes that share a mark are neighbours.

    The sequential rule: taken in order, a node leads unless an earlier neighbour leads, and what does not lead
    joins the earliest leader among its neighbours. Each round finds the nodes that come first in all
    their marks: they lead, and all who share a mark with them do not. A mark has one leader at most, so at the end
    each node takes the least leader of its marks. Work is linear in marks, whatever many share; keep
    writes a table and reads it again.
    """
    several = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    marks = keep(marks.join(several, "mark", "left_semi").select("key", "mark"), "marks")
    open_, found, k = marks, None, 0
    while True:
        first = open_.groupBy("mark").agg(F.min("key").alias("first"))
        marked = open_.join(first, "mark")
        lead = marked.groupBy("key").agg(F.bool_and(F.col("first") == F.col("key")).alias("leads")).filter("leads").select("key")
        lead = keep(lead, f"lead{k}")
        if lead.isEmpty():
            break
        found = lead if found is None else found.unionByName(lead)
        gone = marked.join(lead.withColumnRenamed("key", "first"), "first", "left_semi").select("key").distinct()
        open_ = keep(open_.join(gone, "key", "left_anti"), f"open{k}")
        k += 1
    if found is None:
        return marks.select("key", F.col("key").alias("leader")).limit(0)
    led = marks.join(found, "key").select("mark", F.col("key").alias("leader"))
    return marks.join(led, "mark").groupBy("key").agg(F.min("leader").alias("leader"))


def leader_clusters(names: DataFrame, pairs: DataFrame, keep) -> DataFrame:
    """name, leader of all names by the sequential rule (leaders), where pairs (a, b) are neighbours."""
    both = pairs.select(F.concat_ws("\0", "a", "b").alias("mark"), F.explode(F.array("a", "b")).alias("key"))
    led = leaders(both.select("key", "mark").distinct(), keep).withColumnRenamed("key", "name")
    return names.select("name").join(led, "name", "left").select("name", F.coalesce("leader", "name").alias("leader"))


@query("dup_leader_clusters")
def dup_leader_clusters(g: Graph) -> DataFrame:
    """Clusters of items by common tokens and brands, with what to do with them.

    Items of one name and brand are one node, counted as often as it occurs. Copies of a leader
    are members only if its tokens are enough to match it with itself.
    """
    brand = F.lower(F.coalesce("brand", F.lit("")))
    nodes = g.item().filter("name IS NOT NULL").groupBy("name", brand.alias("brand")).agg(F.count(F.lit(1)).alias("copies"))
    keep = keeper(g.spark)
    nodes = keep(nodes.withColumn("key", F.concat("name", F.lit("\0"), "brand")), "nodes")
    clusters = leaders(shared_marks(nodes), keep).toDF("key", "leads")
    found = nodes.join(clusters, "key", "left").withColumn("leads", F.coalesce("leads", "key"))
    itself = F.size(name_tokens("name")) >= F.when(F.col("brand") != "", 1).otherwise(2)
    members = F.when((F.col("key") == F.col("leads")) & ~itself, 1).otherwise(F.col("copies"))
    n = found.groupBy("leads").agg(F.sum(members).alias("members"), F.max(F.when(F.col("key") == F.col("leads"), F.col("name"))).alias("leader"))
    n = n.filter("members > 1")
    return n.select("leader", "members", F.when(F.col("members") <= 3, "merge").otherwise("review").alias("advice"))


@query("dup_vocabulary")
def dup_vocabulary(g: Graph) -> DataFrame:
    """The three nearest canonical brands of each different brand; the vocabulary is a fixed list."""
    vocabulary = F.array(*[F.lit(v) for v in sorted(set(rules.CANONICAL_BRANDS.values()))])
    brands = messy_brands(g).filter("brand IS NOT NULL").select("brand").distinct()
    pairs = brands.select("brand", F.explode(vocabulary).alias("known"))
    scored = pairs.withColumn("score", F.round(fuzzy.scored(fuzzy.weighted_ratio, F.lower("brand"), F.lower("known")), 6)).filter("score >= 75")
    r = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("score"), "known"))
    return scored.withColumn("r", r).filter("r <= 3").select("brand", "known", "score", F.when(F.col("score") >= 90, "match").otherwise("uncertain").alias("verdict"))


@query("dup_exact_names", "SELECT name, count(*) AS n, min(node_id) AS first_id FROM item GROUP BY name HAVING count(*) > 1")
def dup_exact_names(g: Graph) -> DataFrame:
    return g.item().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_id")).filter("n > 1")


@query("dup_largest_groups", "SELECT lower(name) AS name, count(*) AS members, count(DISTINCT brand) AS brands, min(node_id) AS first_id FROM item WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY members DESC, name LIMIT 50")
def dup_largest_groups(g: Graph) -> DataFrame:
    """The fifty largest groups of items of one name, the largest first."""
    groups = g.item().filter("name IS NOT NULL").groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("members"), F.countDistinct("brand").alias("brands"), F.min("node_id").alias("first_id"))
    return groups.filter("members > 1").orderBy(F.desc("members"), "name").limit(50)
