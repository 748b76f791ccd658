"""Connected components of a table of links, by alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Each round is two aggregations and two joins on a node; no link list, no component and no label
table ever reaches the driver, which sees one checksum row a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import drop, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): for every node in ``links``, the smallest node that it reaches.

    Nulls and links from a node to itself are ignored; repeated links and either direction count
    once; an empty table gives an empty one.  The result reads one written table.  Ends at the fixed point (a graph of n nodes needs
    about log(n) rounds); ``rounds`` only guards against an endless loop and raises.
    """
    both = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges, last, before = both.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), None, None
    for _ in range(rounds):
        # a written table ends the plan, so it doesn't grow with the rounds
        edges = materialise(_small_star(_large_star(edges)), "stars")
        sums = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(u as decimal(38)) - v)")).first()
        drop(last)
        if tuple(sums) == before:
            nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return nodes.unionByName(roots)
        last, before = edges, tuple(sums)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
