"""Toxicity and secret scan on held-out rows, and their edge cases."""

import random

import numpy as np
import pytest

from folioscope.llm import queries, secrets, toxicity

SCHEMA = "doc_id long, text string, source string"
EDGE = [(1, None, "a"), (2, "", None), (3, "x", "a"), (3, "x", "a"), (None, "some text", "a"), (4, "password=" + "a1" * 30000, "a")]


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad, low = rnd.random() < 0.2, rnd.random() < 0.3
        text = [rnd.choice(words) for _ in range(60)]
        if bad:
            text[rnd.randrange(60)] = rnd.choice(["vile", "nasty", "horrid"])
        if low:
            text[rnd.randrange(60)] = "clickhere"
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(not low), int(bad)))
    return rows, labels


def test_chain_on_held_out_rows(spark):
    rows, labels = corpus(1500, 1)
    chain = queries.toxicity_chain(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int"))
    assert len(chain.links[0]) == 0 and len(chain.links[1]) == 1
    scored = toxicity.score(spark.createDataFrame(rows[900:], SCHEMA), chain).withColumn("toxic", toxicity.is_positive(chain, "toxic"))
    truth = {i: t for i, _, t in labels}
    right = [r.toxic == bool(truth[r.doc_id]) for r in scored.collect()]
    assert np.mean(right) > 0.97
    kept = toxicity.drop_toxic(spark.createDataFrame(rows[900:], SCHEMA), chain)
    assert kept.columns == ["doc_id", "text", "source"]
    assert np.mean([truth[r.doc_id] for r in kept.collect()]) < 0.02


def test_query_follows_the_labels(spark, sf):
    rows = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in rows.values())


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    none = spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = queries.toxicity_chain(docs, none)
    assert toxicity.drop_toxic(docs, chain).count() == len(EDGE)
    one = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, queries.toxicity_chain(docs, one)).count() == len(EDGE)
    assert toxicity.score(docs.limit(0), chain).collect() == []


def test_logistic_matches_a_dense_solution():
    rng = np.random.default_rng(2)
    x = rng.random((400, 8)) < 0.4
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ np.linspace(-2, 2, 8))))).astype(float)
    rows, cols = np.nonzero(x)
    w, _, b = toxicity.fit_logistic(rows, cols, np.zeros((400, 0)), y, 8, steps=2000)
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) + w
    assert np.abs(slope).max() < 1e-2


@pytest.fixture(scope="module")
def forest():
    return secrets.train(secrets.example_findings())


def test_forest_on_held_out_findings(forest):
    held = secrets.example_findings(seed=77, each=80)
    p = forest.predict(np.array([secrets.features(*f[:4]) for f in held], dtype=float))
    assert np.mean((p > 0.5) == np.array([f[4] for f in held], dtype=bool)) > 0.98


def test_secrets_are_found_and_redacted(spark, forest):
    key, value = "AKIA" + "Q7ZP2M5X8R1K4T6W", "0f3a9c1e7b5d2f8a64"
    text = f"\U0001f600 the tion {key} and password={value} of ing, commit 2b1f7c9e5a3d8046b7e9c1a5f3d20846ab91c7e5 end"
    docs = spark.createDataFrame([(1, text, "src0"), (2, "nothing to see in thislongwordwithoutdigits", "src1")], SCHEMA)
    found = secrets.scan(docs, forest).collect()
    assert {r.secret for r in found} == {key, value} and {r.doc_id for r in found} == {1}
    assert all(text[r.start : r.end] == r.secret for r in found)
    out = {r.doc_id: r.text for r in secrets.redact(docs, forest).collect()}
    assert key not in out[1] and value not in out[1] and out[1].count("[SECRET]") == 2 and "password=[SECRET]" in out[1]
    assert out[2] == docs.where("doc_id = 2").first().text


def test_secret_edges(spark, forest):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    assert {r.doc_id for r in secrets.scan(docs, forest).collect()} <= {4}
    out = secrets.redact(docs, forest)
    assert out.count() == len(EDGE) and out.where("doc_id = 1").first().text is None
    assert secrets.scan(docs.limit(0), forest).collect() == []


def test_secret_query_against_the_single_process_kernel(spark, sf, forest):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(r.doc_id, s, e) for r in rows for s, e, _ in secrets.find_in([r.text], [r.source], forest)[0]}
    assert {(r.doc_id, r.start, r.end) for r in queries.op5_secret_scan(spark, sf).collect()} == want
