"""Exact top-k search by inner product with a pivot-distance index.

Index: every vector is keyed by its nearest pivot and its distance to it, and sorted by
(pivot, distance, id); runs of vectors in that order are annuli, stored as one matrix
each with their range of distances, largest norm and smallest id.  Pivots are chosen by
farthest-first traversal of a bounded sample (``SAMPLE`` rows with the lowest hash of the
id); their number grows with the square root of the table up to ``PIVOTS``; every vector
is indexed.  An annulus holds ``BLOCK`` vectors, or more on tables so large that there
would be over ``ANNULI`` of them; so the directory of annuli, without their vectors, is
small enough to be sent to every task (about 50 MB at most, below 7e10 vectors).

Search: for a query q and a vector x of an annulus around pivot p the triangle inequality
gives |q - x| >= gap, the distance of d(q, p) from the annulus, hence
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + max |x|^2 - gap^2) / 2.  A query has a
cursor at every pivot, which starts at its own distance and walks outward in both
directions; the cursor with the best bound moves next.  A query visits one annulus, then
four times as many each round, and stops when no cursor can reach its k-th score.  No
query ever meets the whole directory row by row.  Components are integers, so scores and
squared distances are exact and so is the result.

Queries and annuli meet in blocks: the queries of an annulus are gathered in groups of
about ``GROUP``, and a group yields at most k rows a query.  Vectors travel in the
smallest integer type that holds them.

Defined results: vectors that are null, or hold a null or non-finite component, or have a
null id take no part; rows that repeat an id are candidates and queries of their own, and
one id's queries share its k places, none of which goes to a row of that id; shorter
vectors count as padded with zeros, so an empty one scores 0; ties go to smaller ids; with
fewer than k others all are returned; components so large that a score might not fit in a
long raise OverflowError; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import checkpoint

SAMPLE, PIVOTS, LEAST_PIVOTS, BLOCK, ANNULI, GROUP, GROWTH = 2048, 1024, 32, 1024, 1 << 20, 512, 4
#: Products below this are exact in double precision.
_EXACT = 1 << 52


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of every component of the usable vectors."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return usable.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda a: F.floor(F.lit(scale) * a.cast("double"))).alias("v"))


def smallest_type(largest: int) -> str:
    return next((f"<i{n}" for n in (2, 4) if largest < 1 << (8 * n - 1)), "<i8")


def _matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dims).astype(np.int64)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    bound = np.abs(a).max(initial=0) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the row farthest from those before it."""
    chosen, least = [0], None
    while len(chosen) < min(count, len(sample)):
        d = ((sample - sample[chosen[-1]]).astype(np.float64) ** 2).sum(axis=1)
        least = d if least is None else np.minimum(least, d)
        if least.max() == 0:
            break
        chosen.append(int(least.argmax()))
    return sample[chosen]


def packed_rows(vectors: DataFrame, dims: int, kind: str) -> DataFrame:
    """(id, v binary): each vector as little-endian integers of type ``kind``, padded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            flat = np.zeros(len(sizes) * dims, dtype=kind)
            row = np.repeat(np.arange(len(sizes)), sizes)
            flat[row * dims + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
            step = dims * flat.itemsize
            data = flat.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[i : i + step] for i in range(0, len(data), step)], pa.binary())], ["id", "v"])

    return vectors.mapInArrow(run, "id long, v binary")


def build_index(vectors: DataFrame, pivots: np.ndarray, dims: int, kind: str, rows: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(keyed, annuli): keyed holds id, v, pivot, dist2, norm2 of every vector."""
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p2 = (pivots * pivots).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims, kind)
            norm2 = (x * x).sum(axis=1)
            d2 = norm2[:, None] + p2 - 2 * _dots(x, pivots)
            near = d2.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d2[np.arange(len(x)), near]), pa.array(norm2)], ["id", "v", "pivot", "dist2", "norm2"])

    keyed = checkpoint(vectors.mapInArrow(key, "id long, v binary, pivot int, dist2 long, norm2 long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["annulus", "pivot", "near2", "far2", "norm2", "least", "ids", "vs"]
        part, seq, held = TaskContext.get().partitionId(), 0, None

        def block(t: pa.Table):
            nonlocal seq
            seq += 1
            ids = t.column("id").to_numpy()
            d = t.column("dist2").to_numpy()
            return [part << 32 | seq, t.column("pivot")[0].as_py(), int(d.min()), int(d.max()), int(t.column("norm2").to_numpy().max()), int(ids.min()), ids.astype("<i8").tobytes(), b"".join(t.column("v").to_pylist())]

        def emit(rows: list) -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            pivot = t.column("pivot").to_numpy()
            starts = np.concatenate(([0], np.nonzero(np.diff(pivot))[0] + 1, [len(pivot)]))
            pieces = [(a, min(a + block_rows, hi)) for lo, hi in zip(starts, starts[1:]) for a in range(lo, hi, block_rows)]
            if not pieces:
                continue
            if len(pieces) > 1:
                yield emit([block(t.slice(a, b - a)) for a, b in pieces[:-1]])
            held = t.slice(pieces[-1][0], pieces[-1][1] - pieces[-1][0])
        if held is not None and len(held):
            yield emit([block(held)])

    parts = max(1, -(-rows // (8 * block_rows)))
    annuli = keyed.repartitionByRange(parts, "pivot", "dist2", "id").sortWithinPartitions("pivot", "dist2", "id").mapInArrow(cut, "annulus long, pivot int, near2 long, far2 long, norm2 long, least long, ids binary, vs binary")
    return keyed, checkpoint(annuli)


class Directory:
    """The annuli of every pivot in order of distance, without their vectors."""

    def __init__(self, table: pa.Table, pivots: np.ndarray):
        self.pivots, self.p2 = pivots, (pivots * pivots).sum(axis=1)
        pivot, near2, far2, annulus = (table.column(c).to_numpy() for c in ("pivot", "near2", "far2", "annulus"))
        order = np.lexsort((annulus, far2, near2, pivot))
        self.annulus, self.norm2, self.least = (table.column(c).to_numpy()[order] for c in ("annulus", "norm2", "least"))
        self.near, self.far = np.sqrt(near2[order].astype(float)), np.sqrt(far2[order].astype(float))
        self.ends = np.searchsorted(pivot[order], np.arange(len(pivots) + 1))
        self.most = np.array([self.norm2[a:b].max(initial=0) for a, b in zip(self.ends, self.ends[1:])])

    def walk(self, q: np.ndarray, kth: int | None, kth_id: int | None, walked: int, batch: int) -> tuple[list[int], int]:
        """Up to ``batch`` annuli that may hold better vectors, after the first ``walked`` in order of their pivots' bounds; the new count."""
        q2 = int((q * q).sum())
        d = np.sqrt((q2 + self.p2 - 2 * (self.pivots @ q)).astype(float)).tolist()

        def bound(norm2: int, gap: float) -> int:
            both = q2 + norm2
            return math.floor((both - gap * gap) / 2 + both * 1e-9 + 1e-6)

        heap: list[tuple[int, int, int, int]] = []

        def offer(p: int, at: int, step: int) -> None:
            if self.ends[p] <= at < self.ends[p + 1]:
                gap = max(0.0, d[p] - float(self.far[at]), float(self.near[at]) - d[p])
                heapq.heappush(heap, (-bound(int(self.most[p]), gap), p, at, step))

        for p in range(len(d)):
            start = int(self.ends[p] + np.searchsorted(self.near[self.ends[p] : self.ends[p + 1]], d[p], side="right"))
            offer(p, start - 1, -1)
            offer(p, start, 1)
        out, seen = [], 0
        while heap and len(out) < batch:
            best, p, at, step = heapq.heappop(heap)
            if kth is not None and -best < kth:
                break
            seen += 1
            offer(p, at + step, step)
            if seen > walked:
                own = bound(int(self.norm2[at]), max(0.0, d[p] - float(self.far[at]), float(self.near[at]) - d[p]))
                if kth is None or own > kth or (own == kth and self.least[at] < kth_id):
                    out.append(int(self.annulus[at]))
        return out, max(seen, walked)


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k best others of every vector whose id satisfies ``queries``, a condition on ``id``."""
    whole = quantized(vectors, id_col, vector_col, scale)
    largest = F.max(F.array_max(F.transform("v", lambda a: F.abs(a.cast("double")))))
    dims, rows, most = whole.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*"), F.coalesce(largest, F.lit(0.0))).first()
    dims, most = max(1, dims), int(most)
    if most**2 * dims >= 1 << 61:
        raise OverflowError("components are too large for scores in a long")
    kind = smallest_type(most)
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    if not rows:
        return empty
    packed = checkpoint(packed_rows(whole, dims, kind))
    sample = packed.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    count = pivots or min(PIVOTS, max(LEAST_PIVOTS, math.isqrt(rows // BLOCK)))
    chosen = choose_pivots(np.frombuffer(b"".join(r["v"] for r in sample), dtype=kind).reshape(-1, dims).astype(np.int64), count)
    keyed, annuli = build_index(packed, chosen, dims, kind, rows, max(BLOCK, -(-rows // ANNULI)))
    directory = Directory(annuli.select("annulus", "pivot", "near2", "far2", "norm2", "least").toArrow(), chosen)
    shared = vectors.sparkSession.sparkContext.broadcast(directory)
    asked = keyed.where(queries).select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("q"), F.col("v").alias("q_v"))
    none = F.lit(None).cast("long")
    state = checkpoint(asked.select("*", none.alias("kth"), none.alias("kth_id"), F.lit(0).cast("long").alias("walked")))
    groups = max(1, -(-state.count() // GROUP))

    def visits_of(batch_size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                found, at = [], []
                for r, (v, kth, kth_id, walked) in enumerate(zip(_matrix(batch.column(2), dims, kind), *(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
                    annuli_, seen = shared.value.walk(v, kth, kth_id, walked, batch_size)
                    found += [(a, seen) for a in annuli_]
                    at += [r] * len(annuli_)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["row", "q", "q_v", "annulus", "seen"])

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ids, vs, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, dtype="<i8")
                x = np.frombuffer(vs, dtype=kind).reshape(-1, dims).astype(np.int64)
                qs = np.frombuffer(b"".join(a["q_v"] for a in asks), dtype=kind).reshape(-1, dims).astype(np.int64)
                for a, s in zip(asks, _dots(qs, x), strict=True):
                    other = ids != a["q"]
                    s, i = s[other], ids[other]
                    if len(s) > k:
                        keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                        s, i = s[keep], i[keep]
                    order = np.lexsort((i, -s))[:k]
                    out += [(a["row"], a["q"], int(i[n]), int(s[n])) for n in order]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], pa.int64()) for n in range(4)], ["row", "q", "id", "score"])

    ranked = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    best, batch = None, 1
    while True:
        visits = checkpoint(state.mapInArrow(visits_of(batch), "row long, q long, q_v binary, annulus long, seen long"))
        if visits.isEmpty():
            break
        gathered = visits.groupBy("annulus", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("row", "q", "q_v")).alias("asks"))
        found = gathered.withColumnRenamed("annulus", "of_annulus").join(annuli.select("annulus", "ids", "vs"), F.col("annulus") == F.col("of_annulus")).select("ids", "vs", "asks").mapInArrow(score, "row long, q long, id long, score long")
        new = found if best is None else found.unionByName(best.select("row", "q", "id", "score"))
        best = checkpoint(new.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))
        reached = visits.groupBy(F.col("row").alias("r_row")).agg(F.max("seen").alias("seen"))
        kth = best.where(F.col("rank") == k).select(F.col("row").alias("k_row"), F.col("score").alias("kth"), F.col("id").alias("kth_id"))
        # a query without visits this round has stopped
        state = checkpoint(
            state.drop("kth", "kth_id", "walked")
            .join(reached, F.col("row") == F.col("r_row"))
            .join(kth, F.col("row") == F.col("k_row"), "left")
            .select("row", "q", "q_v", "kth", "kth_id", F.col("seen").alias("walked"))
        )
        batch *= GROWTH
    if best is None:
        return empty
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id")).cast("int")
    return best.select("q", "id", "score", place.alias("place")).where(F.col("place") <= k).select(F.col("q").alias("query_id"), F.col("place").alias("rank"), "id", "score")
