"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.stages import written


def connected_components(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """``node, label`` for every node of the undirected ``links`` (u, v); label is the smallest node reachable.

    Each round points every node's larger neighbours, then every node and its
    smaller neighbours, at the smallest one nearby, until nothing changes; the
    number of rounds grows with the logarithm of the longest chain.  Links of
    one node are never gathered: its smallest neighbour is aggregated, written
    and joined back, so that a node with very many links can be split.  ``keep``
    writes the table of a round.
    """
    up = lambda d: d.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    smallest = lambda d: d.join(keep(d.groupBy("u").agg(F.min("v").alias("m")), "least"), "u")
    edges, mark = keep(up(links), "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = smallest(both).withColumn("m", F.least("u", "m"))
        large = keep(up(near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        small = smallest(large)
        edges = keep(up(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))), "links")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
