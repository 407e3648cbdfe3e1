"""Personal data: four base kinds and identifiers found by bootstrapped contexts.  DataFrame functions only.

Base kinds are regular expressions whose matches are leftmost and do not overlap;
places are found from the lengths of the matches and of the text between them, in code
points.  Possessive runs and a start at the edge of a run keep every pattern linear in
long texts.

Bootstrapping: candidates are the words that hold a digit or an at sign (identifiers of
plain letters are out of its reach).  Those inside base spans are seeds.  The word before
a candidate, the word after it and both together are its patterns.  Patterns and distinct
candidates form a graph that is scored in rounds until the patterns settle to two digits, or six times: a pattern by
the mean score of its candidates and the number of distinct seeds that support it, a
candidate by its best pattern.  Candidates outside base spans whose pattern keeps a high score are reported as
kind ``id``.  Only counts and scores by pattern and by candidate are shuffled, never
texts, and never the pairs within a pattern.

Defined results: a null text is empty; repeated rows and null ids are scanned like any
row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import checkpoint, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Patterns by kind; a match starts at the edge of a run or where the match before ended.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried on it.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<!\S)\S*[0-9@]\S*"
#: Seeds that must support a pattern, score it must keep to be looked at and to be strong, and rounds at most.
MIN_SEEDS, KEPT_SCORE, MIN_SCORE, ROUNDS = 5, 0.5, 0.95, 6
#: Characters up to which a pattern is named by itself, else by its SHA-1; rows of patterns up to which they are broadcast.
NAMED, BROADCAST_ROWS = 64, 50_000


def spans(between: Column, matches: Column) -> Column:
    """array<struct<s, e, t>> of the matches, given the text between them."""
    sizes = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    # running sums by doubling: each step adds the sum that ends a power of two earlier
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(matches).cast("long"))) - 1)
    earlier = lambda sums, i, k: F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))
    ends = F.aggregate(steps, sizes, lambda sums, k: F.transform(sums, lambda x, i: x + earlier(sums, i, k)))
    return F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("t")))


def digits_of(x: Column) -> Column:
    return F.translate(x, " ().+-", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    n = F.length(digits)
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, double(value(i))).otherwise(value(i)))
    return (n > 0) & (total % 10 == 0)


def accepted(kind: str, x: Column) -> Column:
    """The test that a match of a kind must pass."""
    n = F.length(digits_of(x))
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(x))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, base, found) of every row, written to the shared folder.

    ``base``: array of (k, kind, s, e) in order; ``found``: array of candidates (s, e, t, before, after).
    """
    names = {**{k: (PATTERNS[k], HINTS[k]) for k in KINDS}, "word": (CANDIDATE, "[0-9@]")}
    df = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    none = F.array().cast("array<string>")
    for kind, (pattern, hint) in names.items():
        has = F.col("text").contains(hint) if kind == "email" else F.col("text").rlike(hint)
        df = df.withColumn(f"m_{kind}", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, (pattern, _) in names.items():
        df = df.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none))
    for kind in names:
        df = df.withColumn(f"s_{kind}", spans(F.col(f"g_{kind}"), F.col(f"m_{kind}")))
    def of_kind(i: int, kind: str) -> Column:
        good = F.filter(f"s_{kind}", lambda x: accepted(kind, x["t"]))
        return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e")))

    base = [of_kind(i, kind) for i, kind in enumerate(KINDS)]
    gaps, words = F.col("g_word"), F.col("m_word")
    blank = lambda x: F.coalesce(F.trim(F.translate(x, "\t\n\x0b\x0c\r", "")) == "", F.lit(False))
    last = lambda x: F.regexp_extract(x, r"(?<!\S)(\S++)\s*+\z", 1)
    first = lambda x: F.regexp_extract(x, r"\A\s*+(\S++)", 1)
    # the neighbour is the nearest whole word of the text between, or the next candidate if there is only space
    found = F.transform(
        "s_word",
        lambda x, i: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["t"].alias("t"),
            F.lower(F.when(blank(F.get(gaps, i)), F.coalesce(F.get(words, i - 1), F.lit(""))).otherwise(last(F.get(gaps, i)))).alias("before"),
            F.lower(F.when(blank(F.get(gaps, i + 1)), F.coalesce(F.get(words, i + 1), F.lit(""))).otherwise(first(F.get(gaps, i + 1)))).alias("after"),
        ),
    )
    return checkpoint(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_sort(F.concat(*base)).alias("base"), found.alias("found")))


def bootstrap(scanned: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE, rounds: int = ROUNDS) -> DataFrame:
    """(row, s, e) of the candidates outside base spans that a high-confidence pattern finds."""
    each = scanned.select("row", "base", F.explode("found").alias("c"))
    inside = F.exists("base", lambda b: (b["s"] < F.col("c.e")) & (F.col("c.s") < b["e"]))
    before, after = F.col("c.before"), F.col("c.after")
    named = lambda x: F.when(F.length(x) > NAMED, F.concat(F.left(x, F.lit(16)), F.sha1(x))).otherwise(x)
    both = F.when((before != "") & (after != ""), F.concat(F.lit("="), named(before), F.lit(" "), named(after)))
    patterns = F.filter(F.array(F.when(before != "", F.concat(F.lit("<"), named(before))), F.when(after != "", F.concat(F.lit(">"), named(after))), both), lambda x: x.isNotNull())
    seen = each.select("row", "c.s", "c.e", F.lower("c.t").alias("inst"), inside.alias("seed"), patterns.alias("patterns"))
    # the graph's edges, once each, however often a pattern and an instance meet
    edges = checkpoint(seen.select("inst", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "inst").agg(F.max("seed").alias("seed")))
    scores = edges.select("pattern", "inst", "seed", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score"))
    before_state = None
    for _ in range(max(1, rounds)):
        kept = scores.groupBy("pattern").agg(F.avg("score").alias("p"), F.sum(F.col("seed").cast("long")).alias("seeds")).where((F.col("seeds") >= min_seeds) & (F.col("p") >= KEPT_SCORE))
        kept = checkpoint(kept.select("pattern", "p"))
        state = kept.agg(F.count("*").alias("n"), F.sum(F.xxhash64("pattern", F.round("p", 2)) % (1 << 40)).alias("sum")).first()
        small = F.broadcast(kept) if state["n"] <= BROADCAST_ROWS else kept
        if state == before_state or not state["n"]:
            break
        before_state = state
        inst = edges.join(small, "pattern").groupBy("inst").agg(F.max("p").alias("best"))
        scores = checkpoint(edges.join(inst, "inst", "left").select("pattern", "inst", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score")))
    strong = kept.where(F.col("p") >= min_score).select("pattern")
    strong = F.broadcast(strong) if state["n"] <= BROADCAST_ROWS else strong
    unseen = seen.where(~F.col("seed")).select("row", "s", "e", F.explode("patterns").alias("pattern"))
    return unseen.join(strong, "pattern", "left_semi").select("row", "s", "e").distinct()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, base, spans): arrays of (s, k, kind, e); ``spans`` holds the discovered ones too, as kind ``id``."""
    scanned = scan(docs, id_col, text_col)
    extra = bootstrap(scanned, **options).groupBy(F.col("row").alias("of_row")).agg(F.array_sort(F.collect_list(F.struct("s", F.lit(len(KINDS)).alias("k"), F.lit("id").alias("kind"), "e"))).alias("more"))
    joined = scanned.select("row", "doc_id", "base").join(extra, F.col("row") == F.col("of_row"), "left")
    return joined.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def count_of(kind: str, x: Column) -> Column:
    return F.size(F.filter(x, lambda b: b["kind"] == kind)).cast("long")


def written(x: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(x, lambda b: F.concat_ws(":", b["kind"], b["s"], b["e"])), ",")


def redact(text: Column, x: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are joined from the left."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, b: Column) -> Column:
        new = b["s"] >= a["at"]
        out = F.concat(a["out"], F.substr(text, a["at"] + 1, F.greatest(F.lit(0), b["s"] - a["at"])), F.when(new, F.concat(F.lit("["), b["kind"], F.lit("]"))).otherwise(""))
        return F.struct(F.greatest(a["at"], b["e"]).alias("at"), out.alias("out"))

    return F.aggregate(x, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
