"""Evidence checks: what is matched, flagged or left unchecked; unchecked is never a pass."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folioscope.functions.text import EDGE, lower, squeeze

OUTCOMES = ("matched", "flagged", "unchecked")
# fixed values: scale words, and the tokens below which a quote locates nothing
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
MIN_TOKENS = 3


def canon(c: Column) -> Column:
    """Text for comparison: bars and white space are one space, letters are lower case."""
    return lower(squeeze(F.regexp_replace(c, "\\|", " ")))


def locate_exact(quotes: DataFrame, sources: DataFrame, quote_id: str, quote: str, source_id: str, text: str, width: int = 24) -> DataFrame:
    """(quote_id, source_id, place): every source whose canonical text holds the quote.

    A quote can only lie where its first ``width`` characters do, so sources are cut into
    their distinct windows of that width that begin a word, and joined to the quotes' heads
    on equality; the whole quote is then compared.
    """
    q = quotes.select(F.col(quote_id).alias("quote_id"), canon(F.col(quote)).alias("q")).where(F.length("q") >= width).withColumn("head", F.substring("q", 1, width))
    heads = q.select("head").distinct()
    s = sources.select(F.col(source_id).alias("source_id"), canon(F.col(text)).alias("t"))
    # a look-ahead at every word's beginning: one pass over the text
    heads_of = F.regexp_extract_all("t", F.lit(f"(?<![^ ])(?=(.{{{width}}}))"), F.lit(1))
    windows = s.select("source_id", F.explode(F.array_distinct(heads_of)).alias("head"))
    near = windows.join(heads, "head", "left_semi").join(q, "head").select("source_id", "quote_id", "q").distinct()
    return near.join(s, "source_id").where(F.contains("t", "q")).select("quote_id", "source_id", F.expr("cast(instr(t, q) as bigint)").alias("place"))


def period_agrees(column_end: Column, claimed: Column) -> Column:
    """The same day, or the same month where the claim names its last day."""
    return (column_end == claimed) | ((claimed == F.last_day(claimed)) & (F.trunc(column_end, "MM") == F.trunc(claimed, "MM")))


def significant(x: Column, digits: Column) -> Column:
    """A positive number rounded to so many significant digits."""
    power = F.floor(F.log10(x)) + 1 - digits
    return F.round(x / F.pow(F.lit(10.0), power)) * F.pow(F.lit(10.0), power)


def first_match(figures: DataFrame, sources: DataFrame, by: str, figure: str, source: str, order: str) -> DataFrame:
    """Left join of figures with the first equal source of their key; outcome matched or flagged."""
    first = sources.groupBy(F.col(by).alias("__by"), F.col(source).alias("__value")).agg(F.min(order).alias("place"))
    hit = figures.join(first, (F.col(by) == F.col("__by")) & (F.col(figure) == F.col("__value")), "left").drop("__by", "__value")
    return hit.withColumn("outcome", F.when(F.col("place").isNull(), "flagged").otherwise("matched"))


def factor(scale: Column) -> Column:
    """What a scale word stands for; null for none."""
    out = F.lit(None).cast("double")
    for word, value in SCALES.items():
        out = F.when(scale == word, F.lit(value)).otherwise(out)
    return out


def at_precision(x: Column, digits: Column) -> Column:
    """A number at so many significant digits, half to even, as a decimal that can be joined on."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x)) + 1 - digits)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.bround(x / unit) * unit).try_cast("decimal(38,6)")


def match_figures(figures: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """Adds (place, converted, outcome) to figures: the printed number each of them is.

    ``figures``: by, digits, sig (significant digits), percent, dollar, scale (a word or null).
    ``sources``: by, place (not null), digits, percent, scale.  A percentage is only a printed percentage; what has a
    currency sign or a scale word is none.  Equal digits come first; else a number of another scale that reads as the
    figure at its precision.  Of several the first place.

    Figures are joined once on their digits and once on their value at their precision, so neither compares every
    figure with every number.  Numbers are rescaled to each pair of a scale word and a precision that figures have,
    and there are few of those in a whole table.
    """
    s = sources.select(F.col(by).alias("s_by"), F.col("digits").alias("s_digits"), F.col("percent").alias("s_percent"), F.col("scale").alias("s_scale"), F.col("place").alias("s_place"))
    first = {"p_any": F.col("s_place"), "p_percent": F.when(F.col("s_percent"), F.col("s_place")), "p_plain": F.when(~F.col("s_percent"), F.col("s_place"))}
    printed = s.groupBy(F.col("s_by").alias("p_by"), F.col("s_digits").alias("p_digits")).agg(*(F.min(c).alias(n) for n, c in first.items()))
    fits = F.when(F.col("percent"), F.col("p_percent")).when(~F.col("dollar") & F.col("scale").isNull(), F.col("p_any")).otherwise(F.col("p_plain"))

    scaled = factor(F.col("scale")).isNotNull() & ~F.col("percent")
    # collected, not broadcast: a broadcast that waits for a pass over all figures may time out
    pairs = figures.where(scaled).select("scale", F.col("sig").cast("int")).distinct().collect()
    asked = F.array(*(F.struct(F.lit(scale).alias("scale"), F.lit(sig).alias("sig")) for scale, sig in pairs)).cast("array<struct<scale:string,sig:int>>")
    value = F.col("s_digits").cast("double") * factor(F.col("s_scale")) / factor(F.col("r.scale"))
    each = s.where(~F.col("s_percent")).select("*", F.explode(asked).alias("r")).where(F.col("s_scale") != F.col("r.scale"))
    rescaled = each.select(F.col("s_by").alias("r_by"), F.col("r.scale").alias("r_scale"), F.col("r.sig").alias("r_sig"), at_precision(value, F.col("r.sig")).alias("r_value"), "s_place")
    rescaled = rescaled.where("r_value is not null").groupBy("r_by", "r_scale", "r_sig", "r_value").agg(F.min("s_place").alias("r_place"))

    f = figures.withColumn("f_value", F.when(scaled, at_precision(F.col("digits").cast("double"), F.col("sig"))))
    same = (F.col(by) == F.col("r_by")) & (F.col("scale") == F.col("r_scale")) & (F.col("sig") == F.col("r_sig")) & (F.col("f_value") == F.col("r_value"))
    hit = f.join(printed, (F.col(by) == F.col("p_by")) & (F.col("digits") == F.col("p_digits")), "left").join(rescaled, same, "left")
    out = hit.select(*(F.col(c) for c in figures.columns), F.coalesce(fits, "r_place").alias("place"), (fits.isNull() & F.col("r_place").isNotNull()).alias("converted"))
    return out.withColumn("outcome", F.when(F.col("place").isNull(), "flagged").otherwise("matched"))


def row_scale(units: Column, units_source: Column) -> Column:
    """struct(scale, reason): the scale that an excerpt's own unit line states, or why there is none."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(units), F.lit(rf"\b({'|'.join(SCALES)})s?\b"), F.lit(1)))
    reason = (
        F.when(F.coalesce(units, F.lit("")) == "", "no unit line")
        .when(F.coalesce(units_source, F.lit("")) != "declared", "the unit line was carried in from an earlier excerpt")
        .when(F.lower(units).rlike(r"\bexcept\b"), "the unit line excepts rows it does not name")
        .when(F.size(words) != 1, "the unit line names no single scale word")
    )
    return F.struct(F.when(reason.isNull(), F.get(words, F.lit(0))).alias("scale"), reason.alias("reason"))


def unit_outcome(claimed: Column, printed: Column, converted: Column) -> Column:
    """A claim's scale word against that of the number it stands for."""
    return F.when(claimed.isNull() | printed.isNull(), "unchecked").when((claimed != printed) & ~converted, "flagged").otherwise("matched")


def ungrounded(text: Column, coverage: Column, tickers: list[str]) -> Column:
    """array<string>: the years and known tickers that a text names and the coverage doesn't.

    A year is a run of digits and hyphens of its own, so no part of a date or number counts.
    """
    held = F.regexp_extract_all(coverage, F.lit("[A-Za-z0-9]+"), F.lit(0))
    years = F.filter(F.regexp_extract_all(text, F.lit("[0-9-]+"), F.lit(0)), lambda x: x.rlike("^(?:19|20)[0-9]{2}$"))
    named = F.filter(F.regexp_extract_all(text, F.lit(rf"{EDGE}[A-Z]{{2,5}}{EDGE}"), F.lit(0)), lambda x: x.isin(*tickers))
    return F.filter(F.concat(years, named), lambda x: ~F.array_contains(held, x))


def tokens(c: Column) -> Column:
    """Words of a text for comparison."""
    return F.filter(F.split(canon(c), " "), lambda x: x != "")


def token_share(quote: Column, excerpt: Column) -> Column:
    """Share of a quote's distinct tokens that the best window of an excerpt holds; null below three tokens.

    A window has as many tokens as the quote has distinct ones. It slides in Python, one step a token: inside Spark
    every place would split both texts again.
    """
    least = MIN_TOKENS

    @F.pandas_udf(DoubleType())
    def run(quotes: pd.Series, excerpts: pd.Series) -> pd.Series:
        def share(quote: str | None, excerpt: str | None) -> float | None:
            said = [w for w in quote.split(" ") if w] if quote is not None else []
            if len(said) < least or excerpt is None:
                return None
            held = dict.fromkeys(said, 0)
            have = [w for w in excerpt.split(" ") if w]
            width = min(len(held), len(have))
            now = best = 0
            for i, w in enumerate(have):
                if w in held:
                    now += held[w] == 0
                    held[w] += 1
                if i >= width and have[i - width] in held:
                    held[have[i - width]] -= 1
                    now -= held[have[i - width]] == 0
                best = max(best, now)
            return best / len(held)

        return pd.Series([share(q, e) for q, e in zip(quotes, excerpts, strict=True)], dtype="float64")

    return run(canon(quote), canon(excerpt))


def rollup(findings: DataFrame, by: list[str]) -> DataFrame:
    """(matched, checkable, unchecked) of each group."""
    n = {o: F.count_if(F.col("outcome") == o) for o in OUTCOMES}
    return findings.groupBy(*by).agg(n["matched"].alias("matched"), (n["matched"] + n["flagged"]).alias("checkable"), n["unchecked"].alias("unchecked"))


def unlinked(uses: DataFrame, claims: DataFrame, key: list[str]) -> DataFrame:
    """Uses that name no existing claim."""
    return uses.join(claims.select(*key).distinct(), key, "left_anti")


def with_next(chunks: DataFrame, file: str, seq: str, text: str) -> DataFrame:
    """Adds next_text: the text of the directly following chunk, if there is one."""
    w = Window.partitionBy(file).orderBy(seq)
    return chunks.withColumn("next_text", F.when(F.lead(seq).over(w) == F.col(seq) + 1, F.lead(text).over(w)))
