"""Groups by exact shingle similarity against brute force over all pairs."""

import random
from pathlib import Path

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import simhash
from folioscope.llm.common import shared_dir
from folioscope.llm.components import components


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()


def corpus(seed=4):
    """Texts of many lengths with copies at similarities around 0.8, and a line that many share."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    line, out = fresh(9), []
    for n in (5, 6, 8, 12, 20, 34, 50, 60, 90, 150, 300, 900):
        for k in range(25):
            base = fresh(n)
            at = rnd.randrange(n)
            edited = list(base)
            if k % 3 == 0:
                edited += fresh(max(1, round(n * rnd.uniform(0.18, 0.32))))
            elif k % 3 == 1:
                for i in rnd.sample(range(n), max(1, round(n * rnd.uniform(0.015, 0.06)))):
                    edited[i] = "changed"
            else:
                edited[at:at] = line
            out += [base, edited]
    hub = fresh(120)
    for _ in range(40):
        edited = list(hub)
        edited[rnd.randrange(120)] = "x"
        edited[rnd.randrange(120)] = f"y{rnd.randrange(9)}"
        out.append(edited)
    return [" ".join(t) for t in out]


def brute(texts, least=0.8):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and both / (len(a) + len(b) - both) >= least and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in range(len(texts))}


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    texts = corpus()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(rows).collect()} == brute(texts)


def test_stage_keeps_what_is_below_and_drops_what_is_above(spark, sf):
    texts = corpus(9)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, c in brute(texts).items() if i == c}
    assert {r.doc_id for r in cp.near_dedup(spark, docs, sf).collect()} == want


def test_stage_links_by_blocks_and_whatever_the_distance(spark, sf, monkeypatch):
    """The blocks give links, and a pair of similarity 0.8 counts though its fingerprints are over ``LOOSE`` bits apart."""
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(10**9)}" for _ in range(104)]
    bits = lambda text: 2 * np.unpackbits(simhash.shingle_hashes(text, 5).view(np.uint8).reshape(-1, 8), axis=1).astype(int) - 1
    lead = bits(" ".join(base)).sum(axis=0)
    weak, added = np.argsort(abs(lead))[:34], list(base)
    for _ in range(25):  # of many words the one whose shingle turns most of the bits that the base hardly decides
        tries = [f"v{rnd.randrange(10**9)}" for _ in range(300)]
        turned = [-(np.where(lead > 0, 1, -1) * bits(" ".join([*added[-4:], w]))[0])[weak].sum() for w in tries]
        added.append(tries[int(np.argmax(turned))])
    a, b = " ".join(base), " ".join(added)
    far = np.bitwise_xor(*(np.int64(simhash.majority(simhash.shingle_hashes(t, 5))) for t in (a, b))).view(np.uint64)
    assert int(far).bit_count() > simhash.LOOSE and len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) == 0.8
    met, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *x: met.append(links(*x)) or met[-1])
    long = [f"n{i}" for i in range(401)]
    docs = spark.createDataFrame([(1, a), (2, b), (3, " ".join(long[:400])), (4, " ".join(long))], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, sf).collect()) == [1, 3]
    assert [x.isEmpty() for x in met] == [False]


def test_long_texts_with_a_common_passage_are_not_verified(spark, monkeypatch):
    """Sets of long texts are shipped for pairs that may be similar only, and go when they are compared."""
    rnd = random.Random(5)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(700) for _ in range(4)]
    texts = [passages[i % 4] + fresh(1600 + 40 * i) for i in range(16)]
    texts.append(texts[0] + fresh(540))  # similarity over 0.8
    texts.append(texts[1] + fresh(640))  # below
    texts = [" ".join(t) for t in texts]
    asked, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *x: asked.extend(pairs.collect()) or verified(pairs, *x))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = Path(shared_dir(spark).removeprefix("file://"))
    before = set(at.glob("sets-*"))
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(rows).collect()} == brute(texts)
    assert 1 <= len(asked) <= 3 and set(at.glob("sets-*")) == before


def test_long_sketches_never_differ_in_more_bits_than_their_sets():
    rng = np.random.default_rng(3)
    for n, more in ((560, 0), (900, 250), (1000, 40), (4000, 900), (4090, 20)):
        both = rng.integers(0, 2**64, n + more, dtype=np.uint64)
        a, b = both[:n], both[n // 20 :]
        far = simhash.bits_apart(simhash.long_sketch(a), simhash.long_sketch(b))
        assert far == simhash.bits_apart(simhash.long_sketch(b), simhash.long_sketch(a)) and (n // 20 + more) / 2 < far <= n // 20 + more
    assert simhash.long_sketch(both[:512]) == simhash.long_sketch(both[:0]) == b""


def test_components_leave_their_last_round_only(spark):
    at = Path(shared_dir(spark).removeprefix("file://"))
    files = lambda: {p for p in at.rglob("part-*") if p.is_file()}
    before = files()
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = components(chain)
    assert len({p.parent for p in files() - before}) == 1
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(201)}


def test_components_are_over_fingerprints(spark, monkeypatch):
    """A fingerprint of null ids bridges its neighbours, and rows that repeat an id don't."""
    fps = {1: [(1, 0), (None, 0b1111), (2, 0b11111111)], 2: [(7, 0), (7, (1 << 62) - 1), (9, 1), (2, (1 << 62) - 2)]}
    for rows in fps.values():
        frame = spark.createDataFrame(rows, "doc_id long, fp long")
        monkeypatch.setattr(simhash, "fingerprints", lambda *a, f=frame, **k: f)
        got = sorted((r.fp, r.component_id) for r in simhash.near_duplicates(frame, distance=4).collect())
        if rows[0][0] == 1:
            assert got == [(0, 1), (0b1111, 1), (0b11111111, 1)]
        else:
            assert got == [(0, 7), (1, 7), ((1 << 62) - 2, 2), ((1 << 62) - 1, 2)]


def test_keep_one_with_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(20, a, "x"), (20, b, "x"), (3, a + " end", "x"), (None, a, "y"), (None, "lone words of a null id here", "z"), (5, None, "n"), (6, "", "n"), (20, b, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string").withColumn("node", F.lit(1)).withColumn("component", F.lit(2))
    kept = sorted(((r.doc_id is None, r.doc_id or 0), (r.text or "")[:3]) for r in simhash.keep_one(docs).collect())
    assert kept == [((False, 3), "a0 "), ((False, 5), ""), ((False, 20), "b0 "), ((True, 0), "lon")]
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(docs.limit(0)).collect() == []
