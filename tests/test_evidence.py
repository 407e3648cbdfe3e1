"""Replies and evidence checks on small invented cases."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import replies
from folioscope.operators import checks, evals, structure

EMPTY = {"summary": [], "claims": [], "table": [], "not_comparable": [], "gaps": []}


def parsed(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, raw string")
    return [r for r in replies.answers(rows, "raw").orderBy("n").collect()]


def test_replies_are_salvaged_or_refused(spark):
    claim = {"text": "a } \\ \" {", "tickers": [], "period_end": "", "period_kind": "", "citations": ["[C2]", "C10", "page 3"], "quote": "q"}
    good = json.dumps({**EMPTY, "claims": [claim, {**claim, "id": "own"}]})
    rows = parsed(spark, f"Sure:\n```json\n{good}\n``` done {{", good[:-1] + ",}", good[:-2], "no object", '{"claims": [}', '{"claims": "x"}', json.dumps({"claims": []}), None, '{"a": "never closed }')
    for r in rows[:2]:
        assert r.error is None and [c.id for c in r.answer.claims] == ["K1", "own"]
        assert r.answer.claims[0].citations == ["C2", "C10"] and r.answer.claims[0].text == claim["text"]
    assert [r.error for r in rows[2:]] == ["truncated", "no JSON object", "invalid JSON", "invalid JSON", "summary is missing", "no JSON object", "truncated"]
    assert all(r.answer is None for r in rows[2:])


def test_stored_replies_come_before_canned_ones(spark):
    asked = spark.createDataFrame([("a", "one two"), ("b", " ".join(map(str, range(20))))], "question_key string, excerpt string")
    store = spark.createDataFrame([("a", "stored"), ("a", "two")], "question_key string, raw_text string")
    rows = {r.question_key: r for r in replies.replayed(asked, store, "excerpt").collect()}
    assert (rows["a"].raw_text, rows["a"].replayed, rows["b"].replayed) == ("stored", True, False)
    (answer,) = parsed(spark, rows["b"].raw_text)
    assert answer.error is None and answer.answer.claims[0].quote == " ".join(map(str, range(12)))


@pytest.mark.parametrize(
    ("figure", "sources", "place", "converted"),
    [
        (("130.5", 4, False, True, "billion"), [("130497", False, "million", 1)], 1, True),
        (("130.4", 4, False, True, "billion"), [("130497", False, "million", 1)], None, False),
        (("17", 2, True, False, None), [("17", False, None, 1), ("17", True, None, 2)], 2, False),
        (("17", 2, False, True, None), [("17", True, None, 1)], None, False),
        (("17", 2, False, False, None), [("17", True, None, 3), ("17", False, None, 4)], 3, False),
        (("5", 1, False, False, "million"), [("5000", False, "thousand", 1), ("5", False, "thousand", 2)], 2, False),
        (("5", 1, False, False, "million"), [("5000", False, None, 1)], None, False),
        (("0", 1, False, False, "million"), [("0.0", False, "thousand", 1)], 1, True),
        (("100", 3, False, False, "million"), [("99970", False, "thousand", 1)], 1, True),
    ],
)
def test_figures_and_the_numbers_they_are(spark, figure, sources, place, converted):
    claims = spark.createDataFrame([("x", 1, *figure)], "chunk string, figure_id int, digits string, sig int, percent boolean, dollar boolean, scale string")
    printed = spark.createDataFrame([("x", *s) for s in sources] + [("y", figure[0], figure[2], figure[4], 9)], "chunk string, digits string, percent boolean, scale string, place int")
    (r,) = checks.match_figures(claims, printed, "chunk").collect()
    assert (r.place, r.converted, r.outcome) == (place, converted, "flagged" if place is None else "matched")


def test_scales_of_unit_lines(spark):
    rows = spark.createDataFrame([("USD millions", "declared"), ("USD millions", "inherited"), ("USD millions, except shares", "declared"), ("thousands and millions", "declared"), (None, "declared"), ("shares", "declared")], "u string, s string")
    got = rows.select(checks.row_scale(F.col("u"), F.col("s")).alias("x")).collect()
    assert [r.x.scale for r in got] == ["million", None, None, None, None, None]
    assert [r.x.reason is None for r in got] == [True] + [False] * 5


def test_outcome_of_units(spark):
    rows = spark.createDataFrame([("million", "million", False), ("million", "billion", False), ("million", "billion", True), (None, "million", False), ("million", None, False)], "c string, p string, v boolean")
    assert [r.o for r in rows.select(checks.unit_outcome(F.col("c"), F.col("p"), F.col("v")).alias("o")).collect()] == ["matched", "flagged", "matched", "unchecked", "unchecked"]


def test_gaps_name_only_what_is_covered(spark):
    x = checks.ungrounded(F.lit("AAPL and MSFT in 2023, 2024 and 2024-05, item 120245, THE END"), F.lit("AAPL: FY2022, 2024"), ["AAPL", "MSFT"])
    assert spark.range(1).select(x.alias("x")).first().x == ["2023", "MSFT"]


def test_share_of_a_quote_in_its_best_window(spark):
    share = lambda q, t: spark.range(1).select(checks.token_share(F.lit(q), F.lit(t)).alias("x")).first().x
    assert share("a b c d", "x x a | B c y d") == 0.75 and share("a b c", "a b c") == 1.0
    assert share("a b", "a b") is None and share("a b c", "") == 0.0 and share("a a b b", "b a") == 1.0


def test_median_of_repeated_values(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in (1, 1, 1, 5)] + [("h", 2.0), ("h", 3.0)], "k string, v double")
    assert {tuple(r) for r in evals.upper_median(rows, ["k"], "v").collect()} == {("g", 1.0), ("h", 3.0)}


def test_places_of_many_lines(spark):
    text = "\n".join("é" * (i % 7) for i in range(50_000))
    rows = structure.lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).collect()
    assert [r.doc_id for r in rows].count(3) == 1 and not any(r.doc_id == 2 for r in rows)
    assert all(text[r.start : r.start + len(r.line)] == r.line for r in rows if r.doc_id == 1) and len(rows) == 50_001


def test_figures_are_shuffled_once_for_each_join(spark):
    """Every figure keeps its row, equal ones too, and no figure is grouped or joined back by an id."""
    claims = spark.createDataFrame([("x", "5", 1, False, False, "million")] * 2 + [("x", "7", 1, False, True, None), ("x", "9", 1, True, False, None), ("z", "5", 1, False, False, "million")], "chunk string, digits string, sig int, percent boolean, dollar boolean, scale string")
    printed = spark.createDataFrame([("x", "5000", False, "thousand", 4), ("x", "0.005", False, "billion", 3), ("x", "7", True, None, 1), ("x", "7", False, None, 2), ("x", "9", True, None, 8)], "chunk string, digits string, percent boolean, scale string, place int")
    out = checks.match_figures(claims, printed, "chunk")
    assert sorted((r.chunk, r.digits, r.place or 0, r.converted, r.outcome) for r in out.collect()) == [("x", "5", 3, True, "matched"), ("x", "5", 3, True, "matched"), ("x", "7", 2, False, "matched"), ("x", "9", 8, False, "matched"), ("z", "5", 0, False, "flagged")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("Aggregate ") == 2
