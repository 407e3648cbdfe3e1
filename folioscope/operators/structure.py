"""Document structure: lines, table blocks, running headers, sections, spans and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import running_total, strip


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, start, line): every line with its place in the text."""
    parts = F.split(text_col, "\n")
    # offsets are summed inside the row, so no document is shuffled
    ends = running_total(F.transform(parts, lambda x: F.length(x) + 1))
    starts = F.zip_with(ends, parts, lambda e, x: e - F.length(x) - 1)
    zipped = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.arrays_zip(starts.alias("start"), parts.alias("line"))).alias("n", "x"))
    return zipped.select("doc_id", "n", F.col("x.start").alias("start"), F.col("x.line").alias("line"))


def table_blocks(of_lines: DataFrame, shortest: int = 3, gap_chars: int = 80) -> DataFrame:
    """(doc_id, first_line, n_lines, n_rows) of every run of pipe rows; one short other line may stand between two."""
    w = Window.partitionBy("doc_id").orderBy("n")
    pipe = F.col("line").contains("|")
    marked = of_lines.withColumn("pipe", pipe).withColumn("inside", pipe | (F.coalesce(F.lag(pipe).over(w), F.lit(False)) & F.coalesce(F.lead(pipe).over(w), F.lit(False)) & (F.length("line") < gap_chars)))
    island = marked.withColumn("island", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(w)).where("inside")
    return island.groupBy("doc_id", "island").agg(F.min("n").alias("first_line"), F.count("*").alias("n_lines"), F.count_if("pipe").alias("n_rows")).where(F.col("n_rows") >= shortest).drop("island")


def running_headers(of_lines: DataFrame, least: int = 5, longest: int = 120) -> DataFrame:
    """(doc_id, header, copies, kept_line): short lines without digits that repeat; the first copy survives."""
    key = strip(F.col("line"))
    rows = of_lines.select("doc_id", "n", key.alias("header")).where((F.length("header") > 0) & (F.length("header") < longest) & ~F.col("header").rlike("[0-9]"))
    return rows.groupBy("doc_id", "header").agg(F.count("*").alias("copies"), F.min("n").alias("kept_line")).where(F.col("copies") >= least)


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after a stop, question or exclamation mark before white space, and at line ends."""
    marked = F.regexp_replace(text, "([.!?])[ \\t]+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: strip(s)), lambda s: s != "")


def spans(marks: DataFrame, by: str, at: str, end: Column) -> DataFrame:
    """Adds span_end: the next mark of the group, or ``end``."""
    return marks.withColumn("span_end", F.coalesce(F.lead(at).over(Window.partitionBy(by).orderBy(at)), end))


def fill_forward(rows: DataFrame, by: str, order: str, value: Column, to: str = "inherited") -> DataFrame:
    """The last known value of the rows before."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(w))


def containing(points: DataFrame, ranges: DataFrame, by: str, at: str, start: str, end: str) -> DataFrame:
    """Range join inside a key: each point with the range start <= at < end that holds it.

    Ranges of a key don't overlap, so a point's range is the last one that begins at or
    before it: one sort by key serves both sides and nothing is compared pairwise.
    """
    extra = [c for c in ranges.columns if c not in (by, start)]
    marks = ranges.select(F.col(by), F.col(start).alias(at), F.lit(0).alias("is_point"), F.struct(F.col(start).alias(start), *extra).alias("range"))
    own = [c for c in points.columns if c not in (by, at)]
    asks = points.select(by, at, F.lit(1).alias("is_point"), F.struct(*own).alias("own") if own else F.lit(None).alias("own"))
    both = marks.unionByName(asks, allowMissingColumns=True)
    held = both.withColumn("range", F.last("range", ignorenulls=True).over(Window.partitionBy(by).orderBy(at, "is_point").rowsBetween(Window.unboundedPreceding, 0)))
    out = held.where(f"is_point = 1 and range is not null and {at} < range.{end}")
    return out.select(by, at, *(F.col(f"own.{c}").alias(c) for c in own), *(F.col(f"range.{c}").alias(c) for c in (start, *extra)))


def density(marks: DataFrame, by: str, at: Column, kind: str, reach: int, least: int) -> DataFrame:
    """Rows from which at least ``least`` distinct kinds stand within ``reach``."""
    w = Window.partitionBy(by).orderBy(at).rangeBetween(0, reach)
    return marks.withColumn("kinds", F.size(F.collect_set(kind).over(w))).where(F.col("kinds") >= least)
