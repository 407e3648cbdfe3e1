"""Exact top-k against brute force, on hard distributions and edge cases."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, step):
    """As the oracle's SQL has it: every row is a candidate, and the rows of one query id share its places."""
    vs = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in vs if i % step == 0}:
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for o, own in vs if o == q for i, v in vs if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(spark, rows, k, step):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in topk.search(df, F.col("id") % step == 0, k=k, pivots=8).collect())


@pytest.mark.parametrize("kind", ["spread", "copies", "clusters"])
def test_search_is_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 4)
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(300):
        if kind == "copies" and i % 3 == 0:
            v = [0.5] * 6
        elif kind == "clusters":
            v = [x + rnd.gauss(0, 0.05) for x in rnd.choice(centres)]
        else:
            v = [round(rnd.gauss(0, 1) * 4) / 4 for _ in range(6)]
        rows.append((i, v, 0))
    # quantizing works on the stored single precision
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in v], n) for i, v, n in rows]
    assert found(spark, rows, 5, 10) == brute(rows, 5, 10)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 0), (1, None, 0), (2, [nan, 1.0], 0), (3, [inf, 1.0], 0), (4, [None, 1.0], 0), (None, [1.0, 1.0], 0), (5, [0.5], 0), (6, [], 0), (7, [1.0, 0.5], 0), (7, [1.0, 0.5], 0)]
    assert found(spark, rows, 5, 1) == brute(rows, 5, 1)
    assert found(spark, [(0, [1.0], 0)], 5, 1) == []
    twice = [(0, [1.0], 0), (0, [-2.0], 0), (1, [3.0], 0), (1, [3.0], 0), (2, [0.25], 0), (3, [-1.0], 0)]
    assert found(spark, twice, 3, 2) == brute(twice, 3, 2)
    with pytest.raises(OverflowError):
        found(spark, [(0, [1e30], 0), (1, [1.0], 0)], 5, 1)
    clash = spark.createDataFrame([(0, [1.0], 1, 1, 1), (1, [2.0], 1, 1, 1)], "vec_id long, embedding array<float>, id int, v int, rank int")
    assert [tuple(r) for r in topk.search(clash, F.col("id") == 0, k=5).collect()] == [(0, 1, 1, 131072)]
    assert topk.search(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []


def test_query_equals_its_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(queries.OP1_SQL).fetchall()
    assert sorted(tuple(r) for r in queries.op1_exact_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)
