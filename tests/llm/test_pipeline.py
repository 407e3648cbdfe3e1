"""Every stage on its own input, and the whole."""

import corpus_pipeline as cp
from folioscope.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n=120):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 5003}" for i in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], SCHEMA)


def test_stage_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "toxicity", "SimHash near-dedup", "secret scans", "best-fit packing"]


def test_quality_stage_follows_the_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id for r in queries.op6_quality_rules(spark, sf).where("kept").collect()}
    out = cp.quality_rules(spark, docs, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want


def test_near_dedup_keeps_one_of_each_group(spark, sf):
    edited = words(1).split()
    edited[60] = "changed"
    rows = [(10, words(1)), (11, words(1)), (12, " ".join(edited)), (20, words(2)), (20, words(2)), (30, words(3)), (40, None), (41, ""), (None, words(4))]
    out = cp.near_dedup(spark, docs_of(spark, rows), sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 10), (False, 20), (False, 30), (False, 40), (True, 0)]


def test_secret_stage_keeps_documents(spark, sf):
    rows = [(1, "the tion password=0f3a9c1e7b5d2f8a64 of ing"), (2, None), (3, "plain")]
    out = {r.doc_id: r for r in cp.secret_scan(spark, docs_of(spark, rows), sf).collect()}
    assert "0f3a9c" not in out[1].text and out[1].n_chars == len(out[1].text) and out[2].text is None and out[3].text == "plain"


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = cp.run(spark, sf).collect()
    kept = {r.doc_id for r in out}
    assert kept and kept <= {r.doc_id for r in docs.collect()}
    assert all(r.offset + r.length <= 2048 for r in out)
