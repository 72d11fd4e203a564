"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every node in links (a, b): label is the least node that it reaches.

    Each round hangs the larger neighbours of every node, then its smaller ones, below the
    least of them; links stay as many or become fewer. A round is two grouped minima and a
    join back, so a node with very many neighbours is met by partial sums and a join that
    adaptive execution may split. The table is written after each round. It ends when every
    node has either one smaller neighbour and no other, or no smaller one; the first grouped
    minimum of a round tells, and holds the labels then.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    edges = scratch.keep(edges, f"{name}-edges0")
    step = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = both.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("below"))
        hangs = F.col("below").isNotNull() & ((F.col("below") != F.col("lo")) | (F.col("hi") > F.col("u")))
        least = scratch.keep(seen.select("u", F.least("lo", "u").alias("m"), hangs.alias("open")), f"{name}-least{step}")
        if not least.agg(F.max("open")).first()[0]:
            return least.select(F.col("u").alias("node"), F.col("m").alias("label"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        edges = scratch.keep(small, f"{name}-edges{step}")
        scratch.drop(f"{name}-edges{step - 1}", f"{name}-least{step - 1}")
