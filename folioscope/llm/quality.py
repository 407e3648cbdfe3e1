"""Quality rules with risk-controlled thresholds.  DataFrame functions only.

Measures of a text are taken from all of it.  The base rules reject short and
repetitive texts.  The method adds one cutoff per rule and stratum (language): on the
labelled rows that pass the base rules, a cutoff may be used only if the exact binomial
bound shows that it rejects at most the allowed share of good documents of the stratum.

Guarantee: with probability at least 1 - ``delta``, in every stratum at once, the
cutoffs together reject at most a share ``alpha`` of the good documents.  Each rule gets
alpha / rules (union bound); cutoffs of a rule are nested and tested from the most
lenient on, stopping at the first that fails (fixed-sequence testing, which needs no
further correction); rules and strata share delta by Bonferroni.  Among the certified
cutoffs of a rule the one with the most rejected bad minus ten times the rejected good
labels is used, the more lenient in a tie; none, if that isn't positive.

Defined results: a null text has no words; a null language is a stratum of its own;
label rows with a null quality or id don't count, and of repeated label rows the lowest
counts; a stratum with too few good labels gets no cutoff and keeps what the base rules
keep; repeated rows are judged one by one; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import checkpoint, stored, text_or_empty

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rules by name: a ratio of a text, rejected above a cutoff.
RULES = {
    "symbols": "n_symbols / greatest(1, word_chars)",
    "dup_lines": "n_dup_lines / greatest(1, n_lines)",
    "repeats": "n_repeat_words / greatest(1, n_words)",
}
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)
#: Rows of cutoffs up to which they are broadcast; beyond, an ordinary join is planned.
BROADCAST_ROWS = 10_000
#: Standard deviations below the observed count within which the terms of a binomial tail are summed; a geometric series bounds the rest.
DEVIATIONS = 40
_TEMP = "__quality_"


def measures(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long), each name with ``prefix``."""
    t = _TEMP
    words, lines, keys, bits = (F.col(t + x) for x in ("words", "lines", "keys", "bits"))
    text = F.col(t + "text")
    right, left = (lambda x, k, f=f: F.call_function(f, x, k) for f in ("shiftright", "shiftleft"))
    # a window's hash with its place in the lowest bits: sorted, windows that may be equal stand side by side
    window = lambda i: left(right(F.xxhash64(words[i], words[i + 1], words[i + 2]), bits), bits).bitwiseOR(i.cast("long"))
    same = lambda x, y: right(x, bits) == right(y, bits)
    place = lambda x: x.bitwiseAND(left(F.lit(1).cast("long"), bits) - 1).cast("int")
    n = F.size(words)
    out = (
        docs.withColumn(t + "text", text_or_empty(text_col))
        .withColumn(t + "words", F.filter(F.split(text, SPACE), lambda w: w != ""))
        .withColumn(t + "lines", F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != ""))
        .withColumn(t + "bits", F.length(F.bin(n.cast("long"))))
        .withColumn(t + "keys", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).otherwise(F.array().cast("array<bigint>")))
        .withColumn(
            t + "found",
            F.filter(keys, lambda x, j: ((j > 0) & same(x, F.get(keys, j - 1))) | ((j < F.size(keys) - 1) & same(x, F.get(keys, j + 1)))),
        )
    )
    # the few that may be equal are sorted by their words, so only equal windows count
    by_words = F.array_sort(F.transform(F.col(t + "found"), lambda x: F.struct(words[place(x)].alias("a"), words[place(x) + 1].alias("b"), words[place(x) + 2].alias("c"), place(x).alias("at"))))
    out = out.withColumn(t + "sorted", F.when(F.size(t + "found") > 0, by_words))
    ranked = F.col(t + "sorted")
    alike = lambda x, y: y.isNotNull() & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    again = F.filter(ranked, lambda x, j: ((j > 0) & alike(x, F.get(ranked, j - 1))) | alike(x, F.get(ranked, j + 1)))
    covered = F.coalesce(F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))))), F.lit(0))
    covered = F.when(ranked.isNotNull(), covered).otherwise(0)
    columns = {
        "n_words": n,
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
    }
    out = out.select(*[c for c in out.columns if not c.startswith(t)], *(v.cast("long").alias(prefix + k) for k, v in columns.items()))
    return out


def base_failed(prefix: str = "") -> Column:
    n, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * repeats > 50 * n)


def ratio(rule: str, prefix: str = "") -> Column:
    expr = RULES[rule]
    for name in ("n_symbols", "word_chars", "n_dup_lines", "n_lines", "n_repeat_words", "n_words"):
        expr = expr.replace(name, "\0" + name)
    return F.expr(expr.replace("\0", prefix))


def _stirling(x: Column) -> Column:
    """log(x!) less Stirling's formula, of whole x from 1 on."""
    d = x.cast("double")
    small = F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double")) - ((d + 0.5) * F.log(d) - d + 0.5 * math.log(2 * math.pi))
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / (d * d)) / (d * d)) / (d * d)) / (d * d)) / d
    return F.when(x <= 20, small).otherwise(series)


def tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < p n, to double precision at every size; 1 otherwise.

    The largest term, that of k, comes from Loader's expansion; the others from their ratios, which fall.  Terms more
    than ``DEVIATIONS`` below k are bounded by a geometric series and added, so the result is never too small.
    """
    kd, nd = k.cast("double"), n.cast("double")
    away = lambda x, mean: x * F.log(x / mean) + mean - x
    log_k = _stirling(n) - _stirling(k) - _stirling(n - k) - away(kd, nd * p) - away(nd - kd, nd * (1 - p)) + 0.5 * F.log(nd / (2 * math.pi * kd * (nd - kd)))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] * (i / (nd - i + 1)) * odds
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    last = F.greatest(F.lit(1).cast("long"), k - F.ceil(F.sqrt(nd * p) * DEVIATIONS).cast("long"))
    ratio_below = (last - 1) / (nd - last + 2) * odds
    terms = F.aggregate(F.sequence(k, last, F.lit(-1).cast("long")), start, step)
    total = terms["s"] + F.when(last > 1, terms["t"] * ratio_below / (1 - ratio_below)).otherwise(0.0)
    return F.when(k >= p * n, F.lit(1.0)).when(k == 0, F.exp(nd * math.log1p(-p))).otherwise(F.exp(log_k) * total)


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str, stratum_col: str, label_col: str = "quality", alpha: float = 0.06, delta: float = 0.05, min_good: int = 200) -> DataFrame:
    """(stratum, rule columns with a cutoff or null) of every stratum with at least ``min_good`` good labels.

    ``measured`` has the measures, the id and the stratum of every document; the labels may cover any part of them.
    """
    each = alpha / len(RULES)
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of_id")).agg(F.min(label_col).alias("good"))
    passed = measured.where(~base_failed()).select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), *(ratio(r).alias(r) for r in RULES))
    known = passed.join(lab, F.col("id") == F.col("of_id"))
    sums = [F.sum((F.col("good") == 1).cast("long")).alias("n_good")]
    for r in RULES:
        for i, c in enumerate(CUTOFFS):
            sums += [F.sum(((F.col(r) > c) & (F.col("good") == v)).cast("long")).alias(f"{r}_{i}_{v}") for v in (0, 1)]
    counts = checkpoint(known.groupBy("stratum").agg(*sums).where(F.col("n_good") >= min_good))
    tests = max(1, counts.count() * len(RULES))
    long = counts.select("stratum", "n_good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"{r}_{i}_0").alias("bad"), F.col(f"{r}_{i}_1").alias("wrong")) for i, c in enumerate(CUTOFFS))).alias("steps")) for r in RULES))).alias("x")).select("stratum", "n_good", "x.rule", F.posexplode("x.steps").alias("nth", "step"))
    tested = long.select("stratum", "rule", "nth", "step.*", (tail(F.col("step.wrong"), F.col("n_good"), each) <= delta / tests).alias("passes"))
    first = tested.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("passes"), F.col("nth"))).alias("stop"), F.collect_list(F.struct("nth", "cutoff", "bad", "wrong")).alias("steps"))
    gain = lambda s: s["bad"] - 10 * s["wrong"]
    fit = F.filter(F.array_sort("steps"), lambda s: (F.col("stop").isNull() | (s["nth"] < F.col("stop"))) & (gain(s) > 0))
    best = F.array_max(F.transform(fit, lambda s: F.struct(gain(s).alias("gain"), (-s["nth"]).alias("lenient"), s["cutoff"].alias("cutoff"))))
    chosen = first.select("stratum", "rule", best["cutoff"].alias("cutoff"))
    return checkpoint(chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES)))


def judge(measured: DataFrame, chosen: DataFrame, stratum_col: str, prefix: str = "") -> DataFrame:
    """Adds <prefix>base_failed and <prefix>kept to the measured rows."""
    small = chosen.select(F.col("stratum").alias(_TEMP + "stratum"), *(F.col(r).alias(_TEMP + r) for r in RULES))
    if chosen.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    out = measured.join(small, F.col(stratum_col).eqNullSafe(F.col(_TEMP + "stratum")), "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(ratio(r, prefix) > F.col(_TEMP + r), F.lit(False))
    return out.withColumn(prefix + "base_failed", base_failed(prefix)).withColumn(prefix + "kept", ~base_failed(prefix) & ~over).drop(*(c for c in out.columns if c.startswith(_TEMP)))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """One row a document: id, measures, base_failed and kept."""
    chosen = docs.select(id_col, stratum_col, text_col)
    measured = checkpoint(measures(chosen, text_col).drop(text_col))
    return judge(measured, cutoffs(measured, labels, id_col, stratum_col, **options), stratum_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The measures are taken once and written beside the rows; the cutoffs read their columns, and the filter all of them.
    """
    p = "__kept_"
    names = [*("n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words".split())]
    rows = stored(measures(docs, text_col, p), "measured")
    measured = rows.select(id_col, stratum_col, *(F.col(p + n).alias(n) for n in names))
    return judge(rows, cutoffs(measured, labels, id_col, stratum_col, **options), stratum_col, p).where(p + "kept").select(*docs.columns)
