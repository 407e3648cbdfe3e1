"""Weights, seats, context assembly under a budget, and prose packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight(weights: dict[str, float], item: Column) -> Column:
    """Section weight with the ``*`` default."""
    out = F.lit(weights.get("*", 1.0))
    for k, v in weights.items():
        if k != "*":
            out = F.when(item == k, F.lit(v)).otherwise(out)
    return out


def quota_chunks(budget: int, quotas: Column) -> Column:
    """Chunks a quota may take: the budget over 400 tokens a chunk, between 6 and 24."""
    return F.greatest(F.lit(6), F.least(F.lit(24), F.floor(F.lit(budget) / (quotas * 400)))).cast("long")


def priority_union(sources: list[tuple[int, DataFrame]], by: list[str], id_col: str) -> DataFrame:
    """One row a candidate with its best (priority, rank)."""
    every = None
    for p, df in sources:
        rows = df.select(*by, id_col, F.lit(p).cast("long").alias("priority"), F.col("rank").cast("long").alias("rank"))
        every = rows if every is None else every.unionByName(rows)
    best = every.groupBy(*by, id_col).agg(F.min(F.struct("priority", "rank")).alias("best"))
    return best.select(*by, id_col, "best.priority", "best.rank")


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of a key the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def _assemble(budget: int, floor: int, overlap: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = [g.sort_values(["rank", "chunk"]).to_dict("records") for _, g in pdf.groupby("quota", sort=True)]
        seen: set = set()
        for q in queues:  # a chunk belongs to the first quota that offers it
            q[:] = [c for c in q if not (c["chunk"] in seen or seen.add(c["chunk"]))]
        taken, used, at = [], 0, [0] * len(queues)

        def boilerplate(c: dict) -> bool:
            own = set(c["shingles"])
            return bool(own) and any(len(own & set(k["shingles"])) / len(own) >= overlap for k in taken if k["file"] != c["file"])

        def take(i: int) -> bool:
            nonlocal used
            while at[i] < len(queues[i]):
                c = queues[i][at[i]]
                at[i] += 1
                if used + c["tokens"] <= budget and not boilerplate(c):
                    taken.append(c)
                    used += c["tokens"]
                    return True
            return False

        for i in range(len(queues)):
            for _ in range(floor):
                if not take(i):
                    break
        while any([take(i) for i in range(len(queues))]):
            pass
        taken.sort(key=lambda c: (c["quota"], c["file"], c["chunk"]))
        return pd.DataFrame([{"question": pdf["question"].iloc[0], "cid": f"C{n}", "chunk": c["chunk"], "tokens": c["tokens"]} for n, c in enumerate(taken, 1)], columns=["question", "cid", "chunk", "tokens"])

    return run


def assemble(candidates: DataFrame, budget: int = 20_000, floor: int = 6, overlap: float = 0.6) -> DataFrame:
    """The context of each question: (question, cid, chunk, tokens).

    ``candidates``: question string, quota long, file string, chunk long, rank long, tokens
    long, shingles array<long>; a few hundred rows a question.  Each quota gets its floor in
    turn, then they go round robin; a chunk over the budget or mostly contained in a kept
    chunk of another file is passed over.
    """
    return candidates.groupBy("question").applyInPandas(_assemble(budget, floor, overlap), "question string, cid string, chunk long, tokens long")


def greedy_budget(rows: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows taken in order while they fit; one that doesn't is skipped, not the end."""
    step = lambda a, x: F.when(a["used"] + x[size] <= budget, F.struct((a["used"] + x[size]).alias("used"), F.concat(a["out"], F.array(x[order])).alias("out"))).otherwise(a)
    picked = F.aggregate(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(size)))), F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out")), step, lambda a: a["out"])
    return rows.groupBy(by).agg(picked.alias("x")).select(by, F.explode("x").alias(order))


def pack_prose(sentences: Column, soft: int = 1400) -> Column:
    """Greedy packing of an array of sentences into chunks of at most ``soft`` characters (longer sentences stand alone)."""
    step = lambda a, s: F.when((F.size(a) > 0) & (F.length(F.element_at(a, -1)) + 1 + F.length(s) <= soft), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(" "), s)))).otherwise(F.concat(a, F.array(s)))
    return F.aggregate(sentences, F.array().cast("array<string>"), step)
