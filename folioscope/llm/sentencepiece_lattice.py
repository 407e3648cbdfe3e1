"""SentencePiece encoding and decoding as a relational lattice.

Words are cut at *safe* places, between two characters that no piece holds side by side;
no segmentation crosses one.  The distinct segments of all texts are exploded into
substrings of bounded length (at most the longest piece that begins with the same three
characters), which are equi-joined to the piece table: the edges of each segment's
lattice.  Edges are grouped by segment and folded with the higher-order ``aggregate``:

* a unigram model by Viterbi: for every place the best sum of scores that reaches it;
* a BPE model by rank, which is how such a model is defined (a Viterbi fold over its
  scores gives other ids than the library): an edge is applied where both its ends are
  cuts and one cut lies between.  One pass in rank order gives the library's merges
  wherever each piece is reached from its own characters by merges of rising rank;
  :func:`parse` finds the few *late* pieces that are not (a long run of spaces, here).

An edge is one number (rank, start, length, id) and the cuts of a segment are the bits
of another, so a segment of the fold has at most ``FOLD_CHARS`` characters.  Longer ones
(no safe place in 62 characters: runs of one letter, mostly) and those that hold a late
piece are folded by :func:`merge` or :func:`viterbi` in Python over the same table, with the same result.

Texts never meet the dictionary word by word.  The first pass writes texts as chunks of
at most ``CHUNK_CHARS`` characters: numbers of segments, and the chunk's own distinct
segments.  Only those are joined to the folded lattice, in one exchange; their ids come back packed, in a
few rows a chunk and partition, and each chunk is then written out with them.  The piece
table is broadcast; its size is bounded by the model file and checked.

Defined results: a null or empty text has no pieces; repeated rows and null ids are
encoded like any row; an empty table gives an empty result; other columns are not read.
Characters outside the table become byte pieces; "▁" in a text decodes to a space,
as in the library.  Models with a normaliser, user-defined pieces or without byte pieces
are refused.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import remove, scratch, stored, text_or_empty

CHUNK_CHARS, FOLD_CHARS = 16 << 20, 62
#: Bits of an edge: id, length, start; the rank stands above them.  The last id marks a character outside the table.
_ID, _LEN, _START = 18, 6, 6
UNKNOWN = (1 << _ID) - 1
#: Segments of chunks in a partition of the dictionary, partitions at most, and segments packed at once.
PER_PART, MAX_PARTS, PACKED = 1 << 17, 100_000, 1 << 18
#: Segments grouped in a task without sorting; beyond them Spark sorts.
GROUPS = 1 << 15
#: Bits of a segment's number within its chunk.
_NTH = 28
#: Pieces that one pass by rank may miss, at most.
MAX_LATE = 64
_SPACE = "▁"
_WORDS = re.compile(f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n")


@dataclass
class Pieces:
    """The piece table of a model file: piece to (id, rank, score), and the bytes of every id."""

    table: dict[str, tuple[int, int, float]]
    spelled: list[bytes]
    byte_ids: list[int]
    longest: int
    pairs: frozenset[str]
    unigram: bool
    least: float
    late: tuple[str, ...] = ()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + n]
        at += n


def parse(model: bytes) -> Pieces:
    """The pieces of a serialised model."""
    rows, trainer, normalizer = [], {}, {}
    for number, value in _fields(model):
        if number == 1:
            rows.append(dict(_fields(value)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    # fixed values of the model format: types of models and pieces, flags of the normaliser
    kind = trainer.get(3, 1)
    if kind not in (1, 2):
        raise ValueError("neither a unigram nor a BPE model")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
        raise ValueError("models with a normaliser are not supported")
    if len(rows) >= UNKNOWN:
        raise ValueError("the piece table is too large to broadcast")
    names = [r[1].decode() for r in rows]
    scores = [struct.unpack("<f", r.get(2, bytes(4)))[0] for r in rows]
    order = {x: k for k, x in enumerate(sorted({-x for x in scores}))}
    table, spelled, byte_ids = {}, [], {}
    for i, (name, score, row) in enumerate(zip(names, scores, rows, strict=True)):
        what = row.get(3, 1)
        if what == 4:
            raise ValueError("models with user-defined pieces are not supported")
        spelled.append(name.replace(_SPACE, " ").encode() if what == 1 else b"")
        if what == 6:
            byte_ids[int(name[3:-1], 16)] = i
            spelled[-1] = bytes([int(name[3:-1], 16)])
        elif what == 1:
            table[name] = (i, order[-score], score)
    if len(byte_ids) < 256:
        raise ValueError("models without byte pieces are not supported")
    if any("\n" in p and len(p) > 1 or _SPACE in p.lstrip(_SPACE) for p in table):
        raise ValueError("a piece crosses words")
    pairs = frozenset(a + b for p in table for a, b in zip(p, p[1:]))
    late = tuple(p for p in table if len(p) > 1 and not _rises(p, table)) if kind == 2 else ()
    if len(late) > MAX_LATE:
        raise ValueError("too many pieces are not reached by merges of rising rank")
    return Pieces(table, spelled, [byte_ids[b] for b in range(256)], max(map(len, table)), pairs, kind == 1, min(s for _, _, s in table.values()), late)


def _rises(piece: str, table: dict) -> bool:
    """Whether one pass over the edges in rank order merges the piece's characters into it."""
    n = len(piece)
    edges = sorted((hit[1], s, e) for s in range(n) for e in range(s + 2, n + 1) if (hit := table.get(piece[s:e])))
    cuts = (2 << n) - 1
    for _, s, e in edges:
        ends, inner = 1 << s | 1 << e, (1 << e) - (2 << s)
        if cuts & ends == ends and (cuts & inner).bit_count() == 1:
            cuts &= ~inner
    return cuts == 1 << n | 1


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = parse(f.read())
    return _loaded[path]


def words_of(text: str) -> list[str]:
    return _WORDS.findall(_SPACE + text.replace(" ", _SPACE)) if text else []


def segments(word: str, pairs: frozenset[str]) -> list[str]:
    """The word cut between characters that no piece holds side by side."""
    out, a = [], 0
    for i in range(1, len(word)):
        if word[i - 1 : i + 1] not in pairs:
            out.append(word[a:i])
            a = i
    out.append(word[a:])
    return out


def merge(word: str, pieces: Pieces) -> list[int]:
    """Ids of one word by merges in rank order, with a heap."""
    table, n = pieces.table, len(word)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (hit := table.get(word[a : end[b]])):
            heapq.heappush(heap, (hit[1], a, end[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, e = heapq.heappop(heap)
        b = end[a] if alive[a] else n
        if b >= n or not alive[b] or end[b] != e:
            continue
        alive[b], end[a] = False, e
        if e < n:
            prev[e] = a
        offer(a)
        if prev[a] >= 0:
            offer(prev[a])
    out, a = [], 0
    while a < n:
        hit = table.get(word[a : end[a]])
        out += [hit[0]] if hit else [pieces.byte_ids[x] for x in word[a : end[a]].encode()]
        a = end[a]
    return out


def viterbi(word: str, pieces: Pieces) -> list[int]:
    """Ids of one word by the best sum of scores, in single precision; of equal sums the one met first."""
    n, f32 = len(word), np.float32
    best: list[tuple | None] = [(f32(0), 0, 0)] + [None] * n
    for s in range(n):
        for e in range(s + 1, min(n, s + pieces.longest) + 1):
            hit = pieces.table.get(word[s:e])
            if hit or e == s + 1:
                total = best[s][0] + f32(hit[2] if hit else pieces.least - 10)
                if best[e] is None or total > best[e][0]:
                    best[e] = (total, s, hit[0] if hit else UNKNOWN)
    out, e = [], n
    while e:
        _, s, i = best[e]
        out.append([i] if i != UNKNOWN else [pieces.byte_ids[x] for x in word[s:e].encode()])
        e = s
    return [i for x in reversed(out) for i in x]


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of the ids; the space put before the first word is taken off."""
    spelled = pieces.spelled
    text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _right(x: Column, bits: int) -> Column:
    return F.shiftright(x, bits)


def _start(x: Column) -> Column:
    return _right(x, _ID + _LEN).bitwiseAND((1 << _START) - 1).cast("int")


def _length(x: Column) -> Column:
    return _right(x, _ID).bitwiseAND((1 << _LEN) - 1).cast("int")


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _ends(x: Column) -> Column:
    return _bit(_start(x)).bitwiseOR(_bit(_start(x) + _length(x)))


def _inner(x: Column) -> Column:
    return _bit(_start(x) + _length(x)) - _bit(_start(x) + 1)


def fold_merges(edges: Column, length: Column) -> Column:
    """array<long>: the edges that a BPE segmentation uses; ``edges`` are sorted by rank and start."""
    def step(cuts: Column, x: Column) -> Column:
        fits = (cuts.bitwiseAND(_ends(x)) == _ends(x)) & (F.bit_count(cuts.bitwiseAND(_inner(x))) == 1)
        return F.when(fits, cuts.bitwiseAND(F.bitwise_not(_inner(x)))).otherwise(cuts)

    whole = F.lit((1 << 63) - 1).cast("long")
    # the cuts of a segment of n characters are the bits 0 to n
    start = F.call_function("shiftrightunsigned", whole, F.lit(62) - length)
    merges = F.filter(edges, lambda x: _length(x) > 1)
    # a list of one: its element is the fold's result, which each edge is then held against
    cuts = F.array(F.aggregate(merges, start, step))
    used = lambda c: F.filter(edges, lambda x: (c.bitwiseAND(_ends(x)) == _ends(x)) & (c.bitwiseAND(_inner(x)) == 0))
    return F.flatten(F.transform(cuts, used))


def fold_scores(edges: Column, length: Column) -> Column:
    """array<long>: the edges of the best sum of scores.  ``edges`` are structs (start, n, score, edge), sorted."""
    kind = "array<struct<total:float,edge:bigint>>"
    first = F.concat(F.array(F.struct(F.lit(0.0).cast("float").alias("total"), F.lit(None).cast("long").alias("edge"))), F.array_repeat(F.struct(F.lit(None).cast("float").alias("total"), F.lit(None).cast("long").alias("edge")), length)).cast(kind)

    def step(best: Column, x: Column) -> Column:
        total = (F.get(best, x["start"])["total"] + x["score"]).cast("float")
        now = F.get(best, x["start"] + x["n"])["total"]
        new = F.struct(total.alias("total"), x["edge"].alias("edge"))
        return F.when(now.isNull() | (total > now), F.transform(best, lambda b, i: F.when(i == x["start"] + x["n"], new).otherwise(b))).otherwise(best).cast(kind)

    def back(state: Column, _: Column) -> Column:
        edge = F.get(state["best"], state["at"])["edge"]
        return F.when(edge.isNull(), state).otherwise(F.struct(state["best"].alias("best"), _start(edge).alias("at"), F.concat(F.array(edge), state["out"]).alias("out")))

    begin = F.struct(F.aggregate(edges, first, step).alias("best"), length.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), length), begin, back, lambda s: s["out"])


def looked_up(own: DataFrame, pieces: Pieces, parts: int) -> DataFrame:
    """(key, word_ids array<int>) of every row of ``own`` (key, word).

    The distinct segments are taken from the exchange that also carries the keys: their largest key, and filters that
    stand below it, keep both sides alike, so Spark makes it once.
    """
    spark = own.sparkSession
    rows = [(p, i, rank, float(score)) for p, (i, rank, score) in pieces.table.items()]
    table = F.broadcast(spark.createDataFrame(rows, "piece string, id long, rank long, score float"))
    reach: dict[str, int] = {}
    for p in pieces.table:
        if len(p) > 2:
            reach[p[:3]] = max(reach.get(p[:3], 0), len(p))
    reaches = F.broadcast(spark.createDataFrame(sorted(reach.items()), "three string, reach int"))
    n = F.length("word")
    foldable = n <= FOLD_CHARS
    for p in pieces.late:
        foldable = foldable & ~F.contains("word", F.lit(p))
    dealt = own.where(F.col("word").isNotNull() & foldable).repartition(parts, "word")
    distinct = dealt.groupBy("word").agg(F.max("key").alias("seen")).where("seen is not null")
    starts = distinct.select("word", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    reached = starts.join(reaches, F.expr("substring(word, s, 3)") == F.col("three"), "left")
    spans = reached.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("reach", F.lit(2)), n - F.col("s") + 1))).alias("n"))
    edges = spans.join(table, F.expr("substring(word, s, n)") == F.col("piece"), "left").where("id is not null or n = 1")
    # ranks only matter where an edge spans more than a character
    rank = F.when(F.col("n") > 1, F.col("rank")).otherwise(0)
    place = F.shiftleft((F.col("s") - 1).cast("long"), _ID + _LEN).bitwiseOR(F.shiftleft(F.col("n").cast("long"), _ID)).bitwiseOR(F.coalesce("id", F.lit(UNKNOWN).cast("long")))
    edge = F.shiftleft(rank.cast("long"), _ID + _LEN + _START).bitwiseOR(place)
    if pieces.unigram:
        edge = F.struct((F.col("s") - 1).alias("start"), "n", F.coalesce("score", F.lit(pieces.least - 10).cast("float")).alias("score"), place.alias("edge"))
    lattice = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.max(F.col("id").isNull()).alias("odd"))
    used = fold_scores(F.col("edges"), n) if pieces.unigram else fold_merges(F.col("edges"), n)
    # by start, with the id in the low bits
    low = (1 << (_ID + _LEN + _START)) - 1
    chosen = lattice.select("word", "odd", F.sort_array(F.transform(used, lambda x: x.bitwiseAND(F.lit(low).cast("long")))).alias("used"))
    id_of = lambda x: x.bitwiseAND(UNKNOWN).cast("int")
    byte_ids = F.array(*map(F.lit, pieces.byte_ids))

    def spelled(x: Column) -> Column:
        hexes = F.hex(F.encode(F.substr(F.col("word"), _start(x) + 1, F.lit(1)), "UTF-8"))
        own = F.transform(F.sequence(F.lit(1), F.length(hexes), F.lit(2)), lambda k: F.get(byte_ids, F.conv(F.substr(hexes, k, F.lit(2)), 16, 10).cast("int")))
        return F.when(id_of(x) == UNKNOWN, own).otherwise(F.array(id_of(x)))

    folded = chosen.select("word", F.when(F.col("odd"), F.flatten(F.transform("used", spelled))).otherwise(F.transform("used", id_of)).alias("ids"))
    by_word = viterbi if pieces.unigram else merge

    @F.pandas_udf("array<int>")
    def long_ids(long):
        return long.map(lambda w: by_word(w, pieces))

    rest = own.where(~foldable)
    long = rest.select("word").distinct().select(F.col("word").alias("of_word"), long_ids("word").alias("word_ids"))
    known = folded.select(F.col("word").alias("of_word"), F.col("ids").alias("word_ids"))
    return dealt.join(known, F.col("word") == F.col("of_word")).unionByName(rest.join(long, F.col("word") == F.col("of_word"))).select("key", "word_ids")


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _widen(data: bytes) -> np.ndarray:
    from zstandard import ZstdDecompressor

    return np.ascontiguousarray(np.frombuffer(ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ids) to a compressed row (steps between numbers, counts, ids) of every chunk."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        key, count, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
        starts = np.concatenate(([0], np.cumsum(count)))
        order = np.argsort(key)
        chunk, nth = key[order] >> _NTH, key[order] & ((1 << _NTH) - 1)
        cuts = np.concatenate(([0], np.nonzero(np.diff(chunk))[0] + 1, [len(order)]))
        columns = ([], [], [], [])
        for a, b in zip(cuts, cuts[1:]):
            own = order[a:b]
            lengths = count[own]
            at = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            for to, x in zip(columns, (int(chunk[a]), _squeeze(np.diff(nth[a:b], prepend=0)), _squeeze(lengths), _squeeze(ids[at])), strict=True):
                to.append(x)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["chunk", "steps", "counts", "pieces"])

    for batch in batches:
        if batch.num_rows:
            lists = batch.column(1)
            held.append((batch.column(0).to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy()))
            rows += batch.num_rows
            if rows >= PACKED:
                yield flush()
                rows = 0
    if held:
        yield flush()


def _unpack(found: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts by number, counts by number, ids) of a chunk."""
    none = np.zeros(0, dtype="<u4")
    nth = np.concatenate([none, *(np.cumsum(_widen(f["steps"])) for f in found)]).astype(np.int64)
    count = np.concatenate([none, *(_widen(f["counts"]) for f in found)]).astype(np.int64)
    starts, sizes = np.zeros(len(nth), dtype=np.int64), np.zeros(len(nth), dtype=np.int64)
    starts[nth] = np.cumsum(count) - count
    sizes[nth] = count
    return starts, sizes, np.concatenate([none, *(_widen(f["pieces"]) for f in found)])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, round_trip): little-endian 32-bit piece ids of every text, and whether they decode to it."""
    pieces = load(model_path)
    return encode_with(docs, pieces, id_col, text_col)


def encode_with(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    pairs = pieces.pairs

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            a = 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars + len(texts[b]) <= CHUNK_CHARS):
                    chars += len(texts[b])
                    b += 1
                number: dict[str, int] = {}
                known: dict[str, tuple[int, ...]] = {}
                numbers, sizes = array("I"), []
                for t in texts[a:b]:
                    before = len(numbers)
                    for w in words_of(t):
                        x = known.get(w)
                        if x is None:
                            x = known[w] = tuple(number.setdefault(p, len(number)) for p in segments(w, pairs))
                        numbers.extend(x)
                    sizes.append(len(numbers) - before)
                if seq >> 15 or len(number) >> _NTH:
                    raise OverflowError("too many chunks in a partition, or segments in a text")
                # frequent segments get small numbers, which pack better
                order = np.argsort(-np.bincount(np.array(numbers, dtype=np.int64), minlength=len(number)), kind="stable")
                place = np.empty(len(number), dtype="<u4")
                place[order] = np.arange(len(number))
                names = list(number)
                # a row of numbers, and a row of segments, which is not needed any more once they are looked up
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part << 15 | seq] * 2, pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, b - a, b - a], pa.int32()), ids.slice(a, b - a)),
                        pa.array([sizes, []], pa.list_(pa.int32())),
                        pa.array([[zlib.crc32(t.encode()) for t in texts[a:b]], []], pa.list_(pa.int64())),
                        pa.array([_squeeze(place[np.array(numbers, dtype=np.int64)]), None], pa.binary()),
                        pa.array([[], [names[k] for k in order.tolist()]], pa.list_(pa.string())),
                        pa.array([0, 1], pa.int32()),
                    ],
                    ["chunk", "ids", "sizes", "crcs", "packed", "words", "kind"],
                )
                a, seq = b, seq + 1

    spark, at = docs.sparkSession, scratch(docs.sparkSession, "chunks")
    schema = f"chunk long, ids array<{kind}>, sizes array<int>, crcs array<bigint>, packed binary, words array<string>, kind int"
    plain.mapInArrow(chunk, schema).write.option("compression", "zstd").partitionBy("kind").parquet(at)
    both = spark.read.schema(schema).parquet(at)
    chunks, words = both.where("kind = 0"), both.where("kind = 1")
    total = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    parts = max(1, min(MAX_PARTS, -(-total // PER_PART)))
    key = F.shiftleft("chunk", _NTH).bitwiseOR(F.col("nth").cast("long"))
    own = words.select("chunk", F.posexplode("words").alias("nth", "word")).select(key.alias("key"), "word")
    conf, setting = spark.conf, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = conf.get(setting)
    conf.set(setting, str(GROUPS))
    try:
        blobs = stored(looked_up(own, pieces, parts).mapInArrow(_pack, "chunk long, steps binary, counts binary, pieces binary"), "pieces")
    finally:
        conf.set(setting, before)
    remove(spark, f"{at}/kind=1")
    gathered = blobs.groupBy(F.col("chunk").alias("of_chunk")).agg(F.collect_list(F.struct("steps", "counts", "pieces")).alias("blobs"))
    joined = chunks.select("chunk", "ids", "sizes", "crcs", "packed").join(gathered, F.col("chunk") == F.col("of_chunk"), "left").select("ids", "sizes", "crcs", "packed", "blobs")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, sizes, crcs, packed, blobs = (batch.column(k)[r] for k in range(5))
                starts, counts, ids = _unpack(blobs.as_py() or [])
                numbers = _widen(packed.as_py())
                out, same, at = [], [], 0
                for n, crc in zip(sizes.as_py(), crcs.as_py(), strict=True):
                    words = numbers[at : at + n]
                    at += n
                    lengths = counts[words]
                    places = np.repeat(starts[words] - np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths) + np.arange(lengths.sum())
                    own = ids[places].astype("<u4")
                    out.append(own.tobytes())
                    same.append(zlib.crc32(decode(own, pieces).encode()) == crc)
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(out, pa.binary()), pa.array(same)], ["doc_id", "ids", "round_trip"])

    return joined.mapInArrow(assemble, f"doc_id {kind}, ids binary, round_trip boolean")
