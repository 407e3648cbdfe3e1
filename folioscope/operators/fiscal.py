"""Fiscal calendars, as-of baselines, windows of years and staleness of dated filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchor(day: Column) -> Column:
    """A period that ends in the first week of a month belongs to the month before."""
    return F.when(F.day(day) <= 7, F.date_sub(day, F.day(day))).otherwise(day)


def year_end_month(filings: DataFrame, key: str, day: str, annual: Column, tie: str) -> DataFrame:
    """(key, fye): month of the newest annual filing's anchor."""
    newest = filings.where(annual).groupBy(key).agg(F.max(F.struct(F.col(day), F.col(tie))).alias("x"))
    return newest.select(key, F.month(anchor(F.col(f"x.{day}"))).cast("long").alias("fye"))


def labels(filings: DataFrame, fye: DataFrame, key: str, day: str, annual: Column, offset: int = 0) -> DataFrame:
    """Adds fiscal_label: ``FY2025`` for annual filings, ``FY2025 Q3`` for others; without a known year end the own month counts."""
    a = anchor(F.col(day))
    month = F.month(a)
    end = F.coalesce(F.col("fye"), month)
    year = F.year(a) + F.when(month > end, 1).otherwise(0) + offset
    quarter = F.floor(F.pmod(month - end, F.lit(12)) / 3)
    return filings.join(fye, key, "left").withColumn("fiscal_label", F.when(annual, F.format_string("FY%d", year)).otherwise(F.format_string("FY%d Q%d", year, quarter))).drop("fye")


def baseline(filings: DataFrame, key: str, day: str, id_col: str, annual: Column, forward: bool = False) -> DataFrame:
    """As-of join: for each other filing the newest annual one at or before it (``forward``: the earliest after it).

    One window over both sides sorted by key; nothing is compared pairwise.
    """
    mark = F.when(annual, F.struct(F.col(day), F.col(id_col)))
    w = Window.partitionBy(key).orderBy(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    if forward:
        hit = F.min(mark).over(w.rangeBetween(1, Window.unboundedFollowing))
    else:
        hit = F.max(mark).over(w.rangeBetween(Window.unboundedPreceding, 0))
    found = filings.withColumn("__hit", hit)
    return found.where(~annual).select(key, id_col, day, F.col(f"__hit.{id_col}").alias("baseline_id"), F.col(f"__hit.{day}").alias("baseline_day"))


def stale(newest: DataFrame, key: str, day: str, years: int = 3) -> DataFrame:
    """Keys whose newest filing is more than ``years`` behind the newest of all."""
    cutoff = newest.agg(F.add_months(F.max(day), -12 * years)).first()[0]
    return newest.where(F.col(day) < F.lit(cutoff)).select(key, day)


def missing_years(filings: DataFrame, key: str, day: str, first: int, last: int) -> DataFrame:
    """(key, year) of the asked years in which a key has no filing."""
    asked = filings.select(key).distinct().select(key, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return asked.join(filings.select(key, F.year(day).alias("year")).distinct(), [key, "year"], "left_anti").select(key, F.col("year").cast("long").alias("year"))


def window_years(filings: DataFrame, key: str, day: str, annual: Column, n: int) -> DataFrame:
    """(key, year): the last ``n`` years up to the newest annual filing, and later years in progress."""
    ends = filings.groupBy(key).agg(F.max(F.when(annual, F.year(day))).alias("top"), F.max(F.year(day)).alias("newest")).where("top is not null")
    return ends.select(key, F.explode(F.sequence(F.col("top") - n + 1, F.col("newest"))).alias("year")).select(key, F.col("year").cast("long").alias("year"))
