"""Encoding against the library, and exact round trips."""

import numpy as np
import pytest
import sentencepiece

from folioscope.llm import queries, sentencepiece_lattice as lattice

MODEL = f"{queries.TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_heap_merges_follow_the_library(library):
    import random

    pieces, rnd = lattice.load(MODEL), random.Random(4)
    for _ in range(3000):
        text = "".join(rnd.choice(["the", "an", " ", "  ", "\n", "é", "日", "\U0001f600", "x", "ing", "a", "\t", "­", "0"]) for _ in range(rnd.randrange(14)))
        ids = [i for w in lattice.words_of(text) for i in lattice.merge(w, pieces)]
        assert ids == library.encode(text), repr(text)
        assert lattice.decode(np.array(ids, dtype=int), pieces) == text


def hand_made_unigram() -> bytes:
    """A serialised unigram model written field by field; nothing is trained."""
    import struct

    def field(number, data):
        return bytes([number << 3 | 2]) + (bytes([len(data)]) if len(data) < 128 else bytes([len(data) & 127 | 128, len(data) >> 7])) + data

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = "a b c d e n t ▁ ▁a an ▁an ant ▁ant be ▁be bed tent nt en ▁t te ▁▁ \n é abc bca cab".split(" ")
    pieces += [(w, -1.0 - 0.37 * ((7 * k) % 11), 1) for k, w in enumerate(words)]
    out = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in pieces)
    trainer = bytes([3 << 3, 1]) + bytes([4 << 3]) + bytes([len(pieces) & 127 | 128, len(pieces) >> 7]) + b"\x98\x02\x01"  # unigram, size, byte fallback
    normalizer = field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1])
    return out + field(2, trainer) + field(3, normalizer)


def test_unigram_fold_follows_viterbi_and_the_library(spark):
    import random

    model, rnd = hand_made_unigram(), random.Random(9)
    pieces = lattice.parse(model)
    assert pieces.unigram
    known = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["".join(rnd.choice(["a", "b", "c", "d", "e", "n", "t", "ant", "bed", " ", "  ", "\n", "é", "日", "z"]) for _ in range(rnd.randrange(18))) for _ in range(300)]
    texts += ["ab" * 60, "", "ant" * 3000]
    for t in texts:
        slow = [i for w in lattice.words_of(t) for p in lattice.segments(w, pieces.pairs) for i in lattice.viterbi(p, pieces)]
        assert slow == known.encode(t), repr(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(bytes(r.ids), dtype="<u4").tolist() for r in lattice.encode_with(docs, pieces).collect()}
    assert got == {i: known.encode(t) for i, t in enumerate(texts)}


def test_fold_follows_the_library(spark, library):
    import random

    rnd = random.Random(8)
    some = ["the", "an", " ", "  ", "   ", " " * 13, " " * 17, "\n", "é", "日", "\U0001f600", "x", "ing", "A", "\t", "0", "9", "=", "ou", "str", "ength", "'s", "."]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randrange(24))) for _ in range(1500)] + ["e" * 62, "e" * 63, "e" * 64, "the" * 20, "the" * 21]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lattice.encode(docs, MODEL).collect()
    assert all(r.round_trip for r in rows)
    assert {r.doc_id: np.frombuffer(bytes(r.ids), dtype="<u4").tolist() for r in rows} == {i: library.encode(t) for i, t in enumerate(texts)}


def test_clashing_columns(spark, library):
    names = "chunk words word nth ids ids_ blob blobs edges used id piece three".split()
    docs = spark.createDataFrame([(1, "the tent", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    (row,) = lattice.encode(docs, MODEL).collect()
    assert np.frombuffer(bytes(row.ids), dtype="<u4").tolist() == library.encode("the tent")


def test_query_against_the_library(spark, sf, library):
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_sentencepiece(spark, sf).collect()
    want = {i: np.array(library.encode(t), dtype="<u4").tobytes() for i, t in texts.items()}
    assert {r.doc_id: (r.n_pieces, r.ids_crc32, r.round_trip) for r in rows} == {i: (len(x) // 4, zlib.crc32(x), True) for i, x in want.items()}


def test_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "a  b\n\nc "), (3, "a  b\n\nc "), (None, "\U0001f600é\x00"), (5, "x" * 30000), (6, "word " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, bytes(r.ids)) for r in lattice.encode(docs, MODEL).collect())
    assert got == sorted((i or 0, np.array(library.encode(t or ""), dtype="<u4").tobytes()) for i, t in rows)
    assert lattice.encode(docs.limit(0), MODEL).collect() == []
