"""Near-duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint of 64 bits is cut into blocks.  Two fingerprints at most ``d`` bits
apart differ in at most ``d`` of ``m`` blocks, so they agree on at least ``m - d``:
every choice of ``m - d`` blocks is a join key, and pairs that meet under a key are
verified by their Hamming distance.  ``m`` is the smallest number of blocks whose
keys are long enough for the number of fingerprints at hand, so that a key's expected
number of members stays bounded at every size; the answer does not depend on it.

Documents with one fingerprint are one class before any join.  The members of a key
are never paired by the join: a key with up to ``TILE`` members is searched in one
step that emits at most one link a member (a spanning forest of the verified pairs);
a larger one is dealt over pairs of tiles of that size.  Components of the links are
found by :mod:`folioscope.llm.components`.

Defined results: a null text is empty, and a text without words has fingerprint zero,
which is linked like any other; repeated rows share their class; rows that repeat an id
are linked by their own texts only; null ids link like any but never name a component (one
of null ids alone is null); an empty table gives an empty result; other columns are kept
by :func:`keep_one` and not read.

:func:`similar_classes` judges by the shingles themselves: see there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import checkpoint, remove, spilled, stored, text_or_empty
from folioscope.llm.components import components

#: Members of a key that are searched in one step.
TILE = 1024
#: Members that a key may have on average before keys are made longer.
FULL = 64
_SLAB = 1 << 16
#: Documents from which common shingles are taken, and in how many of them a shingle is common.
SAMPLE, COMMON = 4096, 5
#: Bits between fingerprints of the pairs that are verified first.
DISTANCE = 4
#: Bits of a parity sketch; shingles from which the SimHash is looked at, and its distance for a pair worth verifying early.
SKETCH, LONG, LOOSE = 512, 64, 22


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words of the lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), 42)] if found else [], dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    starts = np.concatenate(([0], ends[: len(found) - words])).tolist()
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _SLAB):
        ones += np.unpackbits(hashes[i : i + _SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row."""
    plain = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_hashes(text.as_py(), words)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return plain.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) of a spanning forest of the pairs at most ``distance`` bits apart.

    Breadth first: each scan looks only at fingerprints not reached yet, so a dense
    group costs little more than one scan and the links never outnumber the members.
    """
    left = np.arange(len(fps))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            if near.any():
                found = left[near]
                a += [at] * len(found)
                b += found.tolist()
                queue += found.tolist()
                left = left[~near]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def block_choices(count: int, distance: int, bits: int = 64) -> list[list[tuple[int, int]]]:
    """Keys as lists of (shift, width): all choices of m - distance blocks, m the least that keeps keys small."""
    for m in range(distance + 1, distance + 5):
        cuts = [round(i * bits / m) for i in range(m + 1)]
        blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        choices = [list(c) for c in combinations(blocks, m - distance)]
        if count <= FULL << min(sum(w for _, w in c) for c in choices):
            break
    return choices


def block_keys(count: int, distance: int):
    """Column: array of (key, value) of a fingerprint ``fp``."""
    def value(choice):
        out = F.lit(0).cast("long")
        for shift, width in choice:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            out = F.shiftleft(out, width).bitwiseOR(part)
        return out

    return F.array(*(F.struct(F.lit(i).alias("key"), value(c).alias("value")) for i, c in enumerate(block_choices(count, distance))))


def links(keyed: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) between the nodes of ``keyed`` (node, fp, key, value) that share a key and are close.

    They connect what the verified pairs connect; each key gives at most one link a member.
    """
    sizes = keyed.groupBy("key", "value").agg(F.count("*").alias("n")).where("n > 1")
    # a key with many members is dealt over the pairs of its tiles; a key of one tile stays whole
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp", "node"), F.col("tiles")).cast("int")
    dealt = (
        keyed.join(sizes.select("key", "value", tiles.alias("tiles")), ["key", "value"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def search(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i, j = forest(rows[:, 4].astype(np.int64).view(np.uint64), distance)
            return rows[i, 5], rows[j, 5]

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if held:
                rows = np.concatenate([*held, rows])
            if not len(rows):
                continue
            cuts = np.nonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))[0] + 1
            groups = np.split(rows, cuts)
            held = [groups.pop()]
            found = [search(g) for g in groups if len(g) > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["u", "v"])
        if held and len(held[0]) > 1:
            u, v = search(held[0])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    by = ["key", "value", "a", "b"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long").where("u != v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row: documents linked by chains of pairs at most ``distance`` bits apart.

    Links and components are over fingerprints; a component is then named by its smallest id.
    """
    fps = checkpoint(fingerprints(docs, id_col, text_col, words))
    classes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    keyed = classes.select(F.col("fp").alias("node"), "fp", F.explode(block_keys(classes.count(), distance)).alias("k")).select("node", "fp", "k.key", "k.value")
    found = components(links(keyed, distance))
    member = classes.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of_fp"), "least", F.coalesce("component", "fp").alias("component"))
    member = checkpoint(member)
    names = member.groupBy(F.col("component").alias("of_component")).agg(F.min("least").alias("component_id"))
    named = member.join(names, F.col("component") == F.col("of_component")).select("of_fp", "component_id")
    return fps.join(named, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")


def set_keys(hashes: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first n - ceil(least n) + 1 of n distinct hashes, common ones (a sorted array) last.

    Two sets with a similarity of at least ``least`` share one of these, whatever the order.
    """
    n = len(hashes)
    if not n:
        return hashes
    last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(n, dtype=bool)
    return np.concatenate([hashes[~last], hashes[last]])[: n - math.ceil(least * n - 1e-9) + 1]


def parity_sketch(hashes: np.ndarray, bits: int = SKETCH) -> bytes:
    """Parities of the hashes by residue; two sketches never differ in more bits than their sets in hashes."""
    counts = np.bincount((hashes >> np.uint64(11)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def long_sketch(hashes: np.ndarray) -> bytes:
    """A parity sketch of at least a bit a hash (a power of two), or nothing where ``SKETCH`` bits are that many."""
    return parity_sketch(hashes, 1 << (len(hashes) - 1).bit_length()) if len(hashes) > SKETCH else b""


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two long sketches differ, the longer one folded to the length of the other."""
    a, b = sorted((a, b), key=len)
    x, y, size = int.from_bytes(a), int.from_bytes(b), 8 * len(b)
    while size > 8 * len(a):
        size //= 2
        y = (y >> size) ^ (y & ((1 << size) - 1))
    return (x ^ y).bit_count()


def common_shingles(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Frequent shingles of a bounded sample.  They only order the keys; no result depends on them."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), words)).astype("<i8") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.array([], dtype="<i8")]))], ["hash"])

    found = docs.select(text_or_empty(text_col).alias("text")).sample(share, seed=7).mapInArrow(run, "hash long")
    top = found.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "hash").limit(1 << 16)
    return np.sort(np.array([r["hash"] for r in top.select("hash").collect()], dtype=np.int64).view(np.uint64))


def close_to(at: int, others: np.ndarray, fps: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, least: float, loose: int) -> np.ndarray:
    """Which of ``others`` (positions) may have a similarity of ``least`` with ``at``.

    Sizes and parity sketches never rule out such a pair.  Fingerprints of ``LONG`` shingles and more that differ in
    over ``loose`` bits do, with a small probability; with 64 they rule out nothing.
    """
    low, high = np.minimum(sizes[others], sizes[at]), np.maximum(sizes[others], sizes[at])
    ok = (low >= least * high - 1e-9) & ((low < LONG) | (np.bitwise_count(fps[others] ^ fps[at]) <= loose))
    some = np.nonzero(ok)[0]
    if len(some):
        far = np.bitwise_count(sketches[others[some]] ^ sketches[at]).sum(axis=1, dtype=np.int64)
        ok[some] = far <= (1 - least) / (1 + least) * (sizes[others[some]] + sizes[at]) + 1e-9
    return ok


def candidate_pairs(dealt: DataFrame, least: float, crossing: bool) -> DataFrame:
    """Pairs (u < v) of ``dealt`` (value, a, b, node, fp, n, component, sketch) that share a value and may be similar.

    Of a spanning forest of each group's pairs within ``LOOSE`` bits those of different components, or with
    ``crossing`` all its pairs of different components, however far their fingerprints are.
    """
    loose = 64 if crossing else LOOSE

    def search(node, fps, sizes, comp, sketches) -> tuple[list, list]:
        left, us, vs = np.argsort(node, kind="stable"), [], []
        if (comp == comp[0]).all():
            return us, vs
        if crossing:
            while len(left) > 1:
                at, left = left[0], left[1:]
                others = left[comp[left] != comp[at]]
                near = others[close_to(at, others, fps, sizes, sketches, least, loose)]
                us.append(np.full(len(near), node[at]))
                vs.append(node[near])
            return us, vs
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                ok = close_to(at, left, fps, sizes, sketches, least, loose)
                if ok.any():
                    new = left[ok & (comp[left] != comp[at])]
                    us.append(np.full(len(new), node[at]))
                    vs.append(node[new])
                    queue += left[ok].tolist()
                    left = left[~ok]
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows, held_sketches = np.zeros((0, 7), dtype=np.int64), np.zeros((0, SKETCH // 64), dtype=np.uint64)

        def pairs(cuts: list[int], rows: np.ndarray, sketches: np.ndarray):
            us, vs = [], []
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    r = rows[a:b]
                    u, v = search(r[:, 3], r[:, 4].copy().view(np.uint64), r[:, 5], r[:, 6], sketches[a:b])
                    us += u
                    vs += v
            none = np.array([], dtype=np.int64)
            us, vs = np.concatenate([none, *us]), np.concatenate([none, *vs])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(us, vs)), pa.array(np.maximum(us, vs))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)])
            held_rows = np.concatenate([held_rows, rows])
            held_sketches = np.concatenate([held_sketches, np.frombuffer(b"".join(batch.column(7).to_pylist()), dtype=np.uint64).reshape(-1, SKETCH // 64)])
            cuts = [0, *(np.nonzero((held_rows[1:, :3] != held_rows[:-1, :3]).any(axis=1))[0] + 1).tolist()]
            yield pairs(cuts, held_rows, held_sketches)
            held_rows, held_sketches = held_rows[cuts[-1] :], held_sketches[cuts[-1] :]
        yield pairs([0, len(held_rows)], held_rows, held_sketches)

    by = ["value", "a", "b"]
    plain = dealt.select(*by, "node", "fp", "n", "component", "sketch")
    return plain.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long").where("u != v").distinct()


def allowed(pairs: DataFrame, traits: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` of nodes whose long sketches in ``traits`` (of_node, n, long) don't rule the similarity out.

    ``SKETCH`` bits rule out nothing between sets of several thousand hashes, and sets of that size are what verifying
    ships; a long sketch is at most a 32nd of its set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n_u, n_v, long_u, long_v = (c.to_pylist() for c in batch.columns)
            most = (1 - least) / (1 + least)
            ok = [not a or not b or bits_apart(a, b) <= most * (m + n) + 1e-9 for m, n, a, b in zip(n_u, n_v, long_u, long_v, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).filter(pa.array(ok, pa.bool_())) for c in (u, v)], ["u", "v"])

    some = traits.where(F.length("long") > 0)
    left, right = (some.select(F.col("of_node").alias(f"of_{k}"), F.col("n").alias(f"n_{k}"), F.col("long").alias(f"long_{k}")) for k in "uv")
    both = pairs.join(left, F.col("u") == F.col("of_u"), "left").join(right, F.col("v") == F.col("of_v"), "left")
    return both.select("u", "v", "n_u", "n_v", "long_u", "long_v").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs of nodes whose sets of shingles have a similarity of at least ``least``.

    ``first`` (node, least_id, least_sha) names a row of each node; ``docs`` has doc_id, text and sha.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["of", "hashes"])

    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    asked = first.join(ids, F.col("node") == F.col("id"), "left_semi")
    texts = docs.join(asked, (F.col("sha") == F.col("least_sha")) & F.col("doc_id").eqNullSafe(F.col("least_id"))).select("node", "text")
    # rows that repeat id and text give one set
    sets, at = spilled(texts.mapInArrow(run, "of long, hashes array<bigint>").dropDuplicates(["of"]), "sets")
    left, right = (sets.select(F.col("of").alias(f"of_{k}"), F.col("hashes").alias(f"set_{k}")) for k in "uv")
    both = pairs.join(left, F.col("u") == F.col("of_u")).join(right, F.col("v") == F.col("of_v"))
    common, total = F.size(F.array_intersect("set_u", "set_v")), F.size("set_u") + F.size("set_v")
    out = checkpoint(both.where(common / (total - common) >= least).select("u", "v").distinct())
    remove(docs.sparkSession, at)
    return out


def with_sha(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, sha): what names a row of a table whose ids may repeat or be null."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha1(text).alias("sha"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, sha, fp, component) of every row: documents linked by chains of pairs with a shingle similarity of at least ``least``.

    The similarity is that of the sets of ``words``-word shingles, taken exactly for every linked pair.  Texts with one
    set are one class, a node, whatever their ids.

    First the SimHash method: pigeonhole blocks of the classes' fingerprints, join, Hamming check (``DISTANCE`` bits),
    verified pairs, components.  Similar pairs can be further apart than any distance that blocks can serve, so the
    rest follows exactly: classes that share one of their first shingles (:func:`set_keys`, which no similar pair
    misses) are candidates if sizes and parity sketches, for long texts of a bit a shingle, allow the similarity.  Of these a spanning forest of each
    group's pairs with near fingerprints is verified, one candidate of each node and then those that are still apart;
    then all candidates that the components don't connect yet, whatever their fingerprints.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    common = common_shingles(docs, text_col, words)
    plain = with_sha(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            columns = [
                pa.array([majority(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([parity_sketch(s) for s in sets], pa.binary()),
                pa.array([long_sketch(s) for s in sets], pa.binary()),
                pa.array([set_keys(s, common, least).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "sha", "fp", "n", "digest", "sketch", "long", "keys"])

    rows = stored(plain.mapInArrow(run, f"doc_id {kind}, sha string, fp long, n long, digest binary, sketch binary, long binary, keys array<bigint>"), "shingles")
    # of every class one row, by (null ids last, id, sha), and a number that is stored with it
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha"))
    classes = rows.groupBy("digest").agg(lowest.alias("row")).select("digest", F.col("row.doc_id").alias("least_id"), F.col("row.sha").alias("least_sha"), F.monotonically_increasing_id().alias("node"))
    first = stored(classes, "classes")
    named = first.select(F.col("digest").alias("of_digest"), "node", "least_id", "least_sha")
    own = rows.join(named, (F.col("digest") == F.col("of_digest")) & (F.col("sha") == F.col("least_sha")) & F.col("doc_id").eqNullSafe(F.col("least_id")))
    keyed = own.select("node", F.explode("keys").alias("value")).distinct()
    sizes = keyed.groupBy("value").agg(F.count("*").alias("members")).where("members > 1").select(F.col("value").alias("of_value"), F.ceil(F.col("members") / TILE).cast("int").alias("tiles"))
    shared = stored(keyed.join(sizes, F.col("value") == F.col("of_value")).select("node", "value", "tiles"), "shared")
    traits = stored(own.select(F.col("node").alias("of_node"), "fp", "n", "sketch", "long").distinct(), "traits")

    def dealt(named: DataFrame) -> DataFrame:
        # a value with many members is dealt over the pairs of its tiles
        tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
        out = shared.join(named, F.col("node") == F.col("of_node")).withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return out.withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other"))

    def more(part: DataFrame, pairs: DataFrame) -> DataFrame:
        """The components with the similar ones of ``pairs`` as further links."""
        return components(part.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(verified(pairs, first, plain, words, least)))

    def labelled(part: DataFrame) -> DataFrame:
        return traits.join(part, F.col("of_node") == F.col("node"), "left").select("of_node", "fp", "n", "sketch", F.coalesce("component", "of_node").alias("component"))

    blocks = traits.select(F.col("of_node").alias("node"), "fp", F.explode(block_keys(traits.count(), DISTANCE)).alias("k")).select("node", "fp", "k.key", "k.value")
    near = checkpoint(links(blocks, DISTANCE).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    found = components(verified(near, first, plain, words, least))
    tested = checkpoint(allowed(candidate_pairs(dealt(labelled(found)), least, crossing=False).join(near, ["u", "v"], "left_anti"), traits, least))
    # one candidate of each node first: in a group of copies that connects nearly all, and few others are left to verify
    once = checkpoint(tested.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"))
    if not once.isEmpty():
        found = more(found, once)
    named_u, named_v = (found.select(F.col("node").alias(f"node_{k}"), F.col("component").alias(f"component_{k}")) for k in "uv")
    apart = F.col("component_u").isNull() | F.col("component_v").isNull() | (F.col("component_u") != F.col("component_v"))
    open_ = tested.join(once, ["u", "v"], "left_anti").join(named_u, F.col("u") == F.col("node_u"), "left").join(named_v, F.col("v") == F.col("node_v"), "left").where(apart).select("u", "v")
    open_ = checkpoint(open_)
    if not open_.isEmpty():
        found = more(found, open_)
    rest = checkpoint(allowed(candidate_pairs(dealt(labelled(found)), least, crossing=True).join(tested.unionByName(near), ["u", "v"], "left_anti"), traits, least))
    if not rest.isEmpty():
        found = more(found, rest)
    member = first.join(found, "node", "left").select(F.col("digest").alias("of_digest"), F.coalesce("component", "node").alias("component"))
    return rows.join(member, F.col("digest") == F.col("of_digest")).select("doc_id", "sha", "fp", "component")


def leaders(classes: DataFrame) -> DataFrame:
    """(component, row): of every component of :func:`similar_classes` the row (no_id, doc_id, sha) that stays."""
    return classes.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha")).alias("row"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) of every row of :func:`similar_classes`; a component is named by its smallest id, or null without one."""
    classes = checkpoint(similar_classes(docs, id_col, text_col, words, least))
    names = leaders(classes).select(F.col("component").alias("of_component"), F.col("row.doc_id").alias("component_id"))
    return classes.join(names, F.col("component") == F.col("of_component")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of ``docs`` of every group: the smallest id (null ids last), of equal ids the smallest SHA-1 of the text.

    Of rows that repeat both, one stays, whatever their other columns.
    """
    kept = leaders(checkpoint(similar_classes(docs, id_col, text_col, words, least))).select(F.col("row.doc_id").alias("__id"), F.col("row.sha").alias("__sha"))
    kept = checkpoint(kept)
    same = (F.sha1(text_or_empty(text_col)) == F.col("__sha")) & F.col(id_col).eqNullSafe(F.col("__id"))
    chosen = docs.join(kept, same, "left_semi")
    key = [F.col(id_col).alias("__of_id"), F.sha1(text_or_empty(text_col)).alias("__of_sha")]
    again = checkpoint(chosen.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1"))
    if again.isEmpty():
        return chosen
    repeats = (F.sha1(text_or_empty(text_col)) == F.col("__of_sha")) & F.col(id_col).eqNullSafe(F.col("__of_id"))
    one = chosen.join(again, repeats, "left_semi").groupBy(*key).agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return chosen.join(again, repeats, "left_anti").unionByName(one)
