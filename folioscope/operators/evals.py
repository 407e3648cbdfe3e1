"""Hit rates, ranks, medians, deltas and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(rows: DataFrame, by: list[str], hit: Column, counted: Column) -> DataFrame:
    """(hits, n): conditions met among the rows that count."""
    return rows.groupBy(*by).agg(F.count_if(counted & hit).alias("hits"), F.count_if(counted).alias("n"))


def reciprocal_rank(found: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """MRR with never-found as zero, and how many were never found or found first."""
    return found.groupBy(*by).agg(F.round(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col(rank).isNull()).alias("never_found"), F.count_if(F.col(rank) == 1).alias("first_place"))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at place n div 2 of the sorted values.

    Values are counted first; a group's counts are then summed up in order by a window, which spills and holds no group
    in a row.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    upto = F.sum("c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    places = counts.select(*by, value, "c", upto.alias("upto"), F.sum("c").over(group).alias("total"))
    middle = F.floor(F.col("total") / 2)
    return places.where((F.col("upto") > middle) & (F.col("upto") - F.col("c") <= middle)).select(*by, F.col(value).cast("double").alias("upper_median"))


def deltas(before: DataFrame, after: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Full outer join of two result sets: before, after and their difference."""
    a, b = before.select(metric, F.col(value).alias("before")), after.select(metric, F.col(value).alias("after"))
    return a.join(b, metric, "full_outer").withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def cost(inp: Column, out: Column, written: Column, read: Column, price_in: float, price_out: float) -> Column:
    """Dollars of a reply; cache writes cost 1.25 and cache reads 0.1 of an input token."""
    return F.round((inp * price_in + written * price_in * 1.25 + read * price_in * 0.10 + out * price_out) / 1e6, 6)
