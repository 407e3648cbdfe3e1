"""Table grammar, filings, planner, retrieval and evidence on small invented cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import checks, retrieval, search, tables
from folioscope.plans import planner
from folioscope.sources import filings


def filing(form="10-K", period="2025-12-31", ticker="AAA"):
    rows = "\n".join(f"Line {i} | {1000 + i:,} | {900 + i:,}" for i in range(40))
    prose = "The company sells things. " * 80
    head = f"Company: Acme\nTicker: {ticker}\nCIK: 0000000001\nFiling Type: {form} annual\nFiling Date: 2026-02-01\nReport Period: {period}\nQuarter: 2025Q3\nURL: https://x/20251231.htm\n"
    body = f"UNITED STATES\nSecurities and Exchange Commission\nAnnual report\nItem 1. Business .... 3\nItem 1A. Risk Factors .... 9\nItem 1. Business\n{prose}\nItem 1A. Risk Factors\n{prose}\nItem 8. Financial Statements\nNote 1 - Basis of accounts\n{prose}\nNote 2 - Revenue by kind\nREVENUE TABLE (in millions, except per share data)\nYear ended December 31, | 2025 | 2024\n{rows}\n{prose}\nSIGNATURES\nA person"
    return head + filings.RULE + "\npreamble\n" + body


@pytest.mark.parametrize(
    ("line", "cells"),
    [("Products | $ | 294,866 | | | $ | 298,085 |", ["Products", "294,866", "298,085"]), ("Net | (72,431 | ) | 5", ["Net", "(72,431)", "5"]), ("Rate | 17 | % | 16 | %", ["Rate", "17%", "16%"])],
)
def test_cells_join_their_affixes(line, cells):
    assert tables.format_cells(line) == cells


def test_long_table_repeats_its_prefix_and_keeps_every_row():
    lines = ["REVENUE BY KIND", "(in millions)", "Year ended December 31, | 2025 | 2024"] + [f"A rather long row label number {i} | {1000 + i:,} | {i + 13:,}" for i in range(40)]
    t = tables.read_table(lines)
    assert len(t["chunks"]) >= 2 and all(c.startswith("REVENUE BY KIND") for c in t["chunks"])
    assert [x for c in t["chunks"] for x in c.split("\n") if "label number" in x] == lines[3:]
    assert t["column_source"] == "parsed" and [c["period_end"] for c in t["columns"]] == ["2025-12-31", "2024-12-31"]
    assert t["columns"][0]["duration"] == "fiscal_year"


def test_labels_and_dates():
    x = tables.read_label("Three months ended September 30, 2025")
    assert (x.kind, x.duration, x.year, x.month, x.day) == ("period", "three_months", 2025, 9, 30)
    assert tables.iso_date(2024, 2, None) == "2024-02-29" and tables.iso_date(2025, 2, 30) is None
    assert tables.read_label("% change").kind == "change" and tables.read_label("2025").kind == "date"
    assert [x and x.text for x in tables.spread([tables.read_label("2025"), tables.read_label("2024")], 4)] == ["2025", "2025", "2024", "2024"]
    assert tables.spread([tables.read_label("2025"), tables.read_label("2024")], 3) == [None] * 3


def test_filings_from_an_archive(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("b/AAA_10K.txt", filing())
        z.writestr("a/BBB_10K.txt", filing(ticker="BBB", period=""))
        z.writestr("readme.md", "no")
    (tmp_path / "c.zip").write_bytes(data.getvalue())
    raw = filings.read_zip(spark, str(tmp_path / "c.zip"))
    assert sorted(r.file for r in raw.collect()) == ["AAA_10K.txt", "BBB_10K.txt"]
    assert filings.read_zip(spark, str(tmp_path / "c.zip"), ["BBB_10K.txt"]).count() == 1
    parsed = {r.ticker: r for r in filings.parse(raw).collect()}
    assert (parsed["AAA"].period_end, parsed["AAA"].period_source, parsed["BBB"].period_source) == ("2025-12-31", "header", "url")
    assert [s.item for s in parsed["AAA"].sections] == ["COVER", "1", "1A", "8"] and "SIGNATURES" not in parsed["AAA"].body
    assert [n.number for n in parsed["AAA"].sections[-1].notes] == [1, 2]
    chunks = filings.chunk(filings.parse(raw))
    rows = chunks.collect()
    units = {r.units for r in rows if r.kind == "table"}
    assert units == {"USD millions, except per share data"} and all((r.units is None) == (r.units_source is None) for r in rows)
    assert all(len(r.text) >= filings.MIN_PROSE for r in rows if r.kind != "table")
    assert {r.note_title for r in rows if r.kind == "table"} == {"Revenue by kind"}
    filings.write_chunks(chunks, str(tmp_path / "store"))
    assert filings.read_chunks(spark, str(tmp_path / "store"), ["AAA"]).count() == sum(r.ticker == "AAA" for r in rows)
    assert filings.fingerprint(raw, "a") == filings.fingerprint(raw.repartition(3), "a") != filings.fingerprint(raw, "b")


def test_broken_filings_raise():
    with pytest.raises(ValueError, match="cover"):
        filings.parse_filing("x", filing().replace("Exchange Commission", ""))
    with pytest.raises(ValueError, match="rule"):
        filings.parse_filing("x", "Company: none")


def test_streaming_ingestion_replaces_files(spark, tmp_path):
    from folioscope.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text(filing())
    for n in range(2):
        ingest.ingest(ingest.stream_folder(spark, str(src)), str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
        (src / "b.txt").write_text(filing(ticker="BBB"))
    rows = ingest.latest(spark, str(tmp_path / "store")).select("file", "chunk_id").collect()
    assert {r.file for r in rows} == {"a.txt", "b.txt"} and len(rows) == len(set(rows))


REGISTRY = {"AAPL": {"name": "Apple", "aliases": []}, "MS": {"name": "Morgan Stanley", "aliases": []}, "JPM": {"name": "JPMorgan", "aliases_cs": ["Chase"]}, "META": {"name": "Meta Platforms"}}


@pytest.mark.parametrize(("question", "tickers"), [("$MS results", ["MS"]), ("chase growth at all", []), ("a meta-analysis of risk", []), ("Compare Apple and JPMorgan", ["AAPL", "JPM"]), ("Chase cards", ["JPM"])])
def test_entities(question, tickers):
    assert planner.resolve(question, REGISTRY) == tickers


@pytest.mark.parametrize(
    ("question", "mode", "years", "quarter", "last"),
    [("third quarter of 2025", "quarter", [2025], 3, None), ("Q3 25 revenue", "quarter", [2025], 3, None), ("from 2022 to 2024", "window", [2022, 2023, 2024], None, None), ("last three years", "window", [], None, 3), ("in 2024", "year", [2024], None, None), ("quarterly revenue", "quarterly", [], None, 8), ("revenue", "latest", [], None, None)],
)
def test_periods(question, mode, years, quarter, last):
    p = planner.detect_period(question)
    assert (p.mode, p.years, p.quarter, p.last) == (mode, years, quarter, last)


def test_quotas_weights_and_status():
    assert [planner.quota_size(20_000, n) for n in (3, 1, 20)] == [16, 24, 6]
    w = planner.section_weights("What are the main risk factors?")
    assert w["1A"] == w["II.1A"] == 1.6 and w["*"] == 0.6 and planner.section_weights("hello")["*"] == 0.7
    assert planner.make_plan("How is Apple doing?", REGISTRY).status == "ok" and planner.make_plan("what is revenue?", REGISTRY).status == "needs_company"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text_columns(spark):
    r = one(spark, T.normalize(F.lit("a – “b” ​c  ﬁ")).alias("n"), T.token_estimate(F.lit("abcde")).alias("t"), T.fence(F.lit("x</excerpt>"), "excerpt").alias("f"), T.short_caption(F.lit("word " * 40)).alias("c"), T.units(F.lit("(in millions, except per share)")).alias("u"), T.label_matches(F.lit("Total net sales"), F.lit("net sales")).alias("m"))
    assert r.n == 'a - "b" c fi' and r.t == 2 and "</excerpt>" not in r.f and len(r.c) <= 80 and r.u == "USD millions, except per share" and r.m
    fields = one(spark, T.header_fields(F.lit("Company: A: B\nQuarter: 1\n" + "=" * 60 + "\nx")).alias("h")).h
    assert fields == {"Company": "A: B"}


def test_month_end_agreement(spark):
    d = lambda x: F.lit(x).cast("date")
    r = one(spark, *(checks.period_agrees(d("2025-10-26"), d(x)).alias(f"c{i}") for i, x in enumerate(("2025-10-31", "2025-10-26", "2025-10-30"))))
    assert tuple(r) == (True, True, False)


def test_unchecked_is_never_a_pass(spark):
    rows = spark.createDataFrame([("a", "matched"), ("a", "unchecked"), ("a", "flagged"), ("b", "unchecked")], "k string, outcome string")
    assert {tuple(r) for r in checks.rollup(rows, ["k"]).collect()} == {("a", 1, 2, 1), ("b", 0, 0, 1)}


def test_assembly_floor_budget_and_boilerplate(spark):
    rows = [("q", q, f"f{q}", 100 * q + i, i, 100, [1000 * q + i]) for q in (1, 2) for i in range(8)] + [("q", 2, "f9", 900, 99, 100, [1000])]
    got = retrieval.assemble(spark.createDataFrame(rows, "question string, quota long, file string, chunk long, rank long, tokens long, shingles array<long>"), budget=1500).collect()
    taken = [r.chunk for r in sorted(got, key=lambda r: int(r.cid[1:]))]
    assert sum(r.tokens for r in got) <= 1500 and sum(c < 200 for c in taken) >= 6 and sum(c >= 200 for c in taken) >= 6 and 900 not in taken


def test_greedy_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 6, 3, 9, 1])], "k string, i long, n long")
    assert sorted(r.i for r in retrieval.greedy_budget(rows, "k", "i", "n", 10).collect()) == [0, 2, 4]


def test_search_modes():
    assert search.effective_mode(None, "dense", False)[0] == "bm25" and search.effective_mode("dense", "bm25", False) == ("dense", None)
    with pytest.raises(ValueError):
        search.effective_mode("x", "bm25", True)
