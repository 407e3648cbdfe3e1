"""Operators on document tables against brute force, and their edge cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import pytest
import xxhash

from folioscope.llm import packing, quality, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (1, None, "en", "s"),
    (2, "", "en", "s"),
    (3, "a", None, "s"),
    (3, "a", None, "s"),
    (None, "lone words here with no id at all", "en", "s"),
    (5, "x \n\n  y   z\t\x0b tail  ", "de", "s"),
    (6, "word " * 30000, "en", "s"),
    (7, "\U0001f600 café \U0001f600 café   café", "fr", "s"),
    (8, "A" * 50000, "en", "s"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string, piece string")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def fingerprint(text):
    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g, 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, distance):
    parent = {k: k for k in fps}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance and root(a) != root(b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in fps}


def test_simhash_query_against_brute_force(spark, sf, texts):
    rows = queries.op3_simhash_near_dedup(spark, sf).collect()
    fps = {k: fingerprint(t) for k, t in texts.items()}
    groups = linked(fps, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{fps[k]:016x}", groups[k]) for k in fps}


@pytest.mark.parametrize("distance", [2, 4, 6])
def test_simhash_links_on_dense_groups(spark, distance, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "TILE", 16)
    rnd = random.Random(7)
    fps = {}
    for group in range(12):
        base = rnd.getrandbits(64)
        for _ in range(40):
            fps[len(fps)] = base ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5)))
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in ((k, f & ((1 << 64) - 1)) for k, f in fps.items())]
    fps = {k: v & ((1 << 64) - 1) for k, v in signed}
    keyed = spark.createDataFrame(signed, "node long, fp long").selectExpr("*").withColumn("k", __import__("pyspark").sql.functions.explode(simhash.block_keys(len(fps), distance))).select("node", "fp", "k.key", "k.value")
    found = {r.node: r.component for r in simhash.components(simhash.links(keyed, distance)).collect()}
    assert {k: found.get(k, k) for k in fps} == linked(fps, distance)


def test_simhash_edges(edge):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    by = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert by[(1, 0)] == by[(2, 0)] == 1
    assert {r.component_id for r in rows if r.doc_id == 3} == {3}
    assert simhash.near_duplicates(edge.limit(0)).collect() == []


def slow_measures(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_query_against_brute_force(spark, sf, texts):
    rows = queries.op6_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dups, repeats = slow_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame([(1, None), (None, 1), (6, 1), (6, 0)], "doc_id long, quality int")
    rows = quality.assess(edge, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.n_repeat_words) for r in rows) == Counter((i, slow_measures(t)[0], slow_measures(t)[4]) for i, t, *_ in EDGE)
    assert quality.assess(edge.limit(0), labels.limit(0)).collect() == []
    kept = quality.keep_good(edge, labels)
    assert kept.columns == edge.columns and kept.collect() == []


def test_quality_cutoffs_hold_their_guarantee(spark):
    rows = [(i, "de" if i % 2 else "en", "$" * (i % 7 == 0) * 40 + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(2000)]
    labels = [(i, int(i % 7 != 0)) for i in range(2000)]
    got = quality.assess(spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept == (r.doc_id % 7 != 0) for r in got)


def test_binomial_tail(spark):
    import math

    cases = [(0, 100, 0.02), (3, 100, 0.05), (10, 1000, 0.02), (5, 50, 0.02)]
    F = __import__("pyspark").sql.functions
    for k, n, p in cases:
        got = spark.range(1).select(quality.tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = 1.0 if k >= p * n else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-9)


def check_packing(rows, docs, capacity):
    """Places are gapless; pieces cover every document; ids are the tokenizer's."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    want = Counter()
    for i, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k, (start, n) in enumerate(packing.cut(len(ids), capacity)):
            own = b"".join(x.to_bytes(4, "little") for x in ids[start : start + n])
            want[(i, k, start, n, zlib.crc32(own))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(seqs) <= -(-total // capacity) * 1.02 + 1


def test_packing_query(spark, sf, texts):
    check_packing(queries.op10_best_fit_packing(spark, sf).collect(), list(texts.items()), 2048)


def test_packing_edges(edge):
    rows = packing.pack_documents(edge, f"{queries.TOKENIZERS}/byte_bpe_50k.json", capacity=64).collect()
    check_packing(rows, [(i, t) for i, t, *_ in EDGE], 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack_documents(edge.limit(0), f"{queries.TOKENIZERS}/byte_bpe_50k.json").collect() == []


def test_packing_splits_like_the_tokenizer():
    from tokenizers import Tokenizer

    tok, fast = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json"), packing.encoder(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    pieces = ["a", " ", "  ", "\n", "\n\n", "\t", " ", "b,", ".", "'s", "12", "é", "\x00", "<|endoftext|>", " x"]
    for parts in itertools.product(pieces, repeat=4):
        text = "".join(parts)
        assert fast.ids(text) == b"".join(i.to_bytes(4, "little") for i in tok.encode(text, add_special_tokens=False).ids), repr(text)


def slow_pii(text):
    """Base spans by Python's re, straight from their description."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def slow_written(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in spans)


def test_pii_query_against_brute_force(spark, sf, texts):
    rows = queries.op4_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = slow_pii(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in want) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(slow_written(want).encode()).hexdigest()
        assert set(slow_written(want).split(",")) <= set(r.spans.split(",")) or not want


def test_pii_base_spans_on_hard_texts(spark):
    from folioscope.llm import pii

    hard = ["a@b.c_d@e.f", "x.y+z@a-b.co.uk. q@r", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255 1.2.3.256", "4111 1111-1111 1111 4111111111111111 4111111111111112", "+1 (988) 555-2485 +12 ++4412345678901 +1-", "\U0001f600 é a@b.cd \U0001f600 10.0.0.1", "9" * 20000, "a" * 20000 + "@", "1 2 3 4 5 " * 3000, None, "", "a@b.c@d.e.f@g"]
    rows = pii.find(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")).collect()
    assert {r.doc_id: [tuple(b) for b in r.base] for r in rows} == {i: slow_pii(t) for i, t in enumerate(hard)}


def test_pii_contexts_discover_unseen_identifiers(spark):
    from folioscope.llm import pii

    rows = [(i, f"some text mailto p{i}@x.example.com thanks for item {i}") for i in range(20)] + [(100, "write mailto weird42#at#host thanks"), (101, "plain item 77 here")]
    found = {r.doc_id: pii_text for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() for pii_text in [[b.kind for b in r.spans]]}
    assert found[100] == ["id"] and found[101] == [] and found[3] == ["email"]


def test_pii_texts_without_digits_hold_seeds_and_candidates(spark):
    from folioscope.llm import pii

    rows = [(i, f"some text mailto {chr(97 + i)}@x.example.com thanks for it") for i in range(20)] + [(100, "write mailto weird@host thanks"), (101, "plain @ sign here")]
    found = {r.doc_id: [(b.kind, b.s, b.e) for b in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == [("id", 13, 23)] and found[101] == [] and [k for k, *_ in found[3]] == ["email"]


def test_pii_edges(edge):
    from folioscope.llm import pii

    assert len(pii.find(edge).collect()) == len(EDGE)
    assert pii.find(edge.limit(0)).collect() == []
