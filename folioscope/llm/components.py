"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a handful of joins and aggregations; no neighbourhood is ever gathered
in one row, so a hub with any number of neighbours is an ordinary skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import remove, scratch, shuffles_removed

#: Rounds of star contraction double the reach, so this covers any graph that fits in a cluster.
MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v): every node's far neighbours get the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.where("v < u")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges ``u``, ``v``; the component is its smallest node.

    Self-loops and null ends are ignored; an empty table gives an empty result.  Every round is written to the shared
    folder, and the round before goes when its successor is there.
    """
    spark, kept = edges.sparkSession, []

    def written(df: DataFrame) -> DataFrame:
        kept.append(scratch(spark, "stars"))
        with shuffles_removed(spark):
            df.write.parquet(kept[-1])
        for path in kept[:-1]:
            remove(spark, path)
        del kept[:-1]
        return spark.read.schema(df.schema).parquet(kept[-1])

    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        with shuffles_removed(spark):
            state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("s")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        now = written(_stars(_stars(now, large=True), large=False))
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
