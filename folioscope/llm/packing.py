"""Best-fit packing of tokenised documents into fixed-length training sequences.

Method: bulk-synchronous best-fit.  Documents and the gaps of open sequences are
kept in size order; in every superstep a successor sweep gives each gap to at
most one document (the longest documents choose first and take the smallest gap
that holds them, documents of one length by rank), the gaps are updated, and the
next superstep begins.  When a sweep matches nothing, as many sequences as the
remaining tokens need at least are opened for the longest remaining documents.

Lengths are integers of at most ``capacity``, and documents of one length are
interchangeable.  So the sorted lists are held as runs (length, count): the sweep
works on at most ``capacity`` runs of documents however large the corpus is, and
what is distributed is tokenising, ranking every piece within its length and
giving each rank its place.  No text or token leaves the task that made it.

Defined results: a null text is empty (one piece holding the end id); repeated
rows and null ids are packed like any other row; an empty table gives an empty
result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import checkpoint, text_or_empty

#: Entries that a Python worker keeps of the word cache; beyond them words are encoded anew.
CACHE_WORDS = 1_000_000
#: A run of white space that must be seen whole: a space inside it, or one that ends the text after another.
_SPACES = re.compile(r"\s \s|\s \Z")


class ByteBpe:
    """Token ids of a byte-level BPE file of the ``tokenizers`` library.

    The pre-tokeniser of that file never joins the end of a word with a following
    space, so a text is encoded space by space with a cache of the words seen.
    The vocabulary is read from the file; merging is done by ``tiktoken``, which
    gives the same ids several times faster.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in _byte_alphabet().items()}
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(to_byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self._special = special
        # the pre-tokenising pattern of byte-level BPE files without one of their own
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._bpe = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._cache: dict[str, bytes] = {}
        assert sys.byteorder == "little" and array("I").itemsize == 4

    def _encode(self, text: str) -> bytes:
        ids = self._bpe.encode(text, allowed_special="all") if any(s in text for s in self._special) else self._bpe.encode_ordinary(text)
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word with what stands before it: a space or a line break."""
        x = self._cache.get(word)
        if x is None:
            if word[-1] in ",." and word[1:-1].isalpha():  # letters and punctuation are never one pre-token
                x = self._word(word[:-1]) + self._word(word[-1])
            else:
                x = array("I", self._bpe.encode_ordinary(word)).tobytes()
            if len(self._cache) < CACHE_WORDS and len(word) < 64:
                self._cache[word] = x
        return x

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if not text:
            return b""
        if _SPACES.search(text) or "\n\n" in text or any(s in text for s in self._special):
            return self._encode(text)
        get, word = self._cache.get, self._word
        # a marked text: every word begins with its own white space
        words = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        if len(words) == 1:
            return self._encode(text)
        return b"".join([get(w) or word(w) for w in words if w])


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE files write every byte as a printable character: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, (head if s < head else capacity)) for s in starts]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, ids (null unless asked for), part, nth.

    (part, nth) number the pieces of one length within a partition.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema[id_col].dataType
    plain = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, part = encoder(tokenizer_path), {}, TaskContext.get().partitionId()
        for batch in batches:
            ids_in, rows = batch.column(0), ([], [], [], [], [], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = bpe.ids(text) + end
                for k, (start, n) in enumerate(cut(len(data) // 4, capacity)):
                    own = data[4 * start : 4 * (start + n)]
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    for to, x in zip(rows, (i, k, start, n, zlib.crc32(own), own if with_ids else None, nth), strict=True):
                        to.append(x)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids_in.take(at), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5]), pa.array(rows[5], pa.binary()), pa.array([part] * len(at), pa.int32()), pa.array(rows[6], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"],
            )

    return plain.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long")


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places of all documents as runs (length, first rank, documents, first sequence, offset).

    ``counts``: documents of each length.  The documents of a run have consecutive
    ranks within their length and go to consecutive sequences at the same offset.
    """
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    tokens = sum(n * c for n, c in left.items())
    gaps: dict[int, list[tuple[int, int]]] = {}  # by size: runs (first sequence, sequences)
    out, opened = [], 0

    def place(n: int, m: int, at: int, gap: int) -> None:
        nonlocal tokens
        out.append((n, rank[n], m, at, capacity - gap))
        rank[n] += m
        left[n] -= m
        tokens -= n * m
        after.setdefault(gap - n, []).append((at, m))

    while tokens:
        after: dict[int, list[tuple[int, int]]] = {}
        stack: list[tuple[int, int, int]] = []  # gaps at least as large as the sweep's place, the smallest on top
        for size in sorted({*gaps, *(n for n in left if left[n])}, reverse=True):
            stack += [(size, at, m) for at, m in gaps.get(size, ())]
            while left.get(size) and stack:
                gap, at, m = stack.pop()
                take = min(m, left[size])
                place(size, take, at, gap)
                if take < m:
                    stack.append((gap, at + take, m - take))
        if not after:
            need = -(-tokens // capacity)
            for n in sorted((n for n in left if left[n]), reverse=True):
                take = min(need, left[n])
                if take:
                    place(n, take, opened, capacity)
                    opened += take
                    need -= take
        for gap, at, m in stack:
            after.setdefault(gap, []).append((at, m))
        gaps = {g: sorted(runs) for g, runs in after.items() if g}
    return out


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to the pieces of :func:`tokenize`."""
    pieces = checkpoint(pieces)
    each = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most one row a length, that is at most ``capacity`` rows, come to the driver
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(sorted(plan_runs(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(offsets, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part"))).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("first") + F.col("nth")).alias("rank"))
    step = 1 << 44
    keys = plan[:, 0] * step + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length * step + rank, side="right") - 1]
            seq = row[:, 3] + rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(seq), pa.array(row[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Tokenises and packs ``docs``: one row a piece with its ids and its place."""
    return pack(tokenize(docs, tokenizer_path, capacity, id_col, text_col, end_id, with_ids), capacity)
