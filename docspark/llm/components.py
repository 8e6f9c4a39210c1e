"""Connected components of a graph of links, by alternating star contraction.

Each round hangs every node under the smallest node that its neighbours know of; the number of rounds grows
with the logarithm of the longest chain. Only links are shuffled. Each round is written to the shared
folder, so neither the plan nor the lineage grows. Nodes with more than 1/256 of all links are joined by broadcast, so that no
task gets all neighbours of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import join_counted, materialise


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the smallest node of its component."""
    links = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        met = join_counted(both, least, ["a"], 2 * mark[0])
        large = materialise(met.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        under = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
        small = join_counted(large, under, ["a"], 2 * mark[0]).select(F.explode(F.array(pair("b", "m"), pair("a", "m"))).alias("x")).select("x.*")
        links = materialise(small.where("a <> b").distinct(), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(links.select("b", "b").distinct())
