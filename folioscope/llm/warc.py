"""WARC archives: a writer with payload deduplication and a salvaging reader.

Writer: every row becomes one record, one gzip member each.  Of the rows with equal
payloads of at least ``min_bytes`` bytes the one with the largest id is a response and
the others revisit it.  Members are made and compressed where the row is read; only
they, not the texts, are moved to meet the winner of their digest.  Tasks write files
of bounded size under names of their own and report them in a manifest, which Spark
commits; a file of a failed attempt is in no manifest and is never read.

Reader: members are checked (gzip checksum, version line, header, lengths, block and
payload digests).  After a failed check the reader searches for the next place where a
valid member or version line begins, goes on there, and logs the bytes between as a
quarantined gap.

Defined results: a null html is an empty payload and a null url an empty one; null ids
are never winners over an id (in a group of null ids all are responses); repeated rows
with the largest id are each a response; an empty table gives an empty archive and no
rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of members after which a task goes on in a new file.
ROLL_BYTES = 64 << 20
#: Bytes within which a record's header must end; tasks over which the members of one digest are dealt.
HEADER_BYTES, SALTS = 1 << 16, 32
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def digest_of(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(text: str) -> str:
    return " ".join(text.split())


def record_id(source_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source_id}/{digest}')}>"


def make_record(source_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False, n: int | None = None) -> bytes:
    """One record, not compressed.  A revisit holds the HTTP headers of the response it repeats."""
    n = len(payload) if n is None else n
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(source_id, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if source_id is not None:
        head.append(f"X-Source-Id: {source_id}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Source-Id: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


class BadRecord(ValueError):
    """A check failed; the message names it."""


def parse_record(data: bytes, start: int = 0) -> tuple[dict, int]:
    """Fields of the record at ``start`` of ``data`` and the end of its bytes; raises BadRecord.  Only the record is copied."""
    if not data.startswith(_VERSION, start):
        raise BadRecord("no version line")
    end = data.find(b"\r\n\r\n", start, start + HEADER_BYTES)
    if end < 0:
        raise BadRecord("header does not end")
    named = {}
    for line in data[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise BadRecord("header line without a colon")
        named[key.strip().lower()] = value.strip()
    try:
        n = int(named["content-length"])
    except (KeyError, ValueError):
        raise BadRecord("no content length") from None
    block = data[end + 4 : end + 4 + n]
    if n < 0 or len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise BadRecord("block is cut off")
    if named.get("warc-block-digest", "").startswith("sha1:") and named["warc-block-digest"][5:] != digest_of(block):
        raise BadRecord("block digest differs")
    http, gap, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    kind = named.get("warc-type", "")
    digest = named.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = len(body)
    if kind == "revisit":
        sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, body = int(sizes[0]) if sizes and sizes[0].strip().isdigit() else None, None
    elif digest and digest != digest_of(body):
        raise BadRecord("payload digest differs")
    number = {k: int(v) if v is not None and v.lstrip("-").isdigit() else None for k, v in ((k, named.get(k)) for k in ("x-source-id", "x-refers-to-source-id"))}
    return {"record_type": kind, "record_id": named.get("warc-record-id"), "url": named.get("warc-target-uri"), "source_id": number["x-source-id"], "refers_to_id": named.get("warc-refers-to"), "refers_to": number["x-refers-to-source-id"], "payload_digest": digest, "payload_bytes": size, "payload": body}, end + 8 + n


def _at(data: bytes, start: int) -> tuple[dict, int]:
    """The record, compressed or not, at ``start``; the end of its bytes."""
    if data[start : start + 3] == _MAGIC:
        unpack, out, pos = zlib.decompressobj(31), [], start
        try:
            while not unpack.eof:
                if pos >= len(data):
                    raise BadRecord("member is cut off")
                out.append(unpack.decompress(data[pos : pos + 65536]))
                pos += 65536
        except zlib.error as e:
            raise BadRecord(f"member: {e}") from None
        found, used = parse_record(raw := b"".join(out))
        if used != len(raw):
            raise BadRecord("member holds more than a record")
        return found, min(pos, len(data)) - len(unpack.unused_data)
    if data.startswith(_VERSION, start):
        return parse_record(data, start)
    raise BadRecord("neither a member nor a version line")


def salvage(content: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, None) of every valid record and (start, end, None, reason) of every quarantined gap."""
    pos, gap, why = 0, None, ""
    while pos < len(content):
        try:
            found, end = _at(content, pos)
        except BadRecord as e:
            if gap is None:
                gap, why = pos, str(e)
            later = [x for x in (content.find(_MAGIC, pos + 1), content.find(_VERSION, pos + 1)) if x >= 0]
            pos = min(later, default=len(content))
            continue
        if gap is not None:
            yield gap, pos, None, why
            gap = None
        yield pos, end, found, None
        pos = end
    if gap is not None:
        yield gap, len(content), None, why


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``pages`` as WARC files under ``path`` (a URI that pyarrow.fs opens) and returns the manifest (file, records, bytes)."""
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    winners = own.groupBy(F.sha1("text").alias("of_sha"), F.octet_length("text").alias("of_n")).agg(F.max("id").alias("winner"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, sizes, members = [], [], []
            for i, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = text.encode()
                sha = hashlib.sha1(payload).digest()
                shas.append(sha.hex())
                sizes.append(len(payload))
                members.append(member(make_record(i, url, payload, base64.b32encode(sha).decode())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shas, pa.string()), pa.array(sizes, pa.int32()), pa.array(members, pa.binary())], ["id", "url", "sha", "n", "member"])

    made = own.mapInArrow(build, "id long, url string, sha string, n int, member binary")
    # a common payload is dealt over SALTS tasks; of the winners only small rows are repeated
    salted = winners.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    made = made.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    joined = made.join(salted, (F.col("sha") == F.col("of_sha")) & (F.col("n") == F.col("of_n")) & (F.col("salt") == F.col("of_salt"))).select("id", "url", "sha", "n", "member", "winner")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        done, out, name, records, size = [], None, "", 0, 0
        for batch in batches:
            for i, url, sha, n, data, winner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n >= min_bytes and i != winner:
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    data = member(make_record(i, url, b"", digest, winner, True, n))
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    out = done.append((name, records, size))
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    manifest = joined.mapInArrow(write, "file string, records long, bytes long")
    manifest.write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest")


_ROWS = "file string, start long, end long, gap string, record_type string, record_id string, url string, source_id long, refers_to_id string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _rows(found: list[tuple], with_payload: bool) -> pa.RecordBatch:
    named = ["record_type", "record_id", "url", "source_id", "refers_to_id", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    rows = [(f, a, b, why, *((r or {}).get(k) if k != "payload" or with_payload else None for k in named)) for f, a, b, r, why in found]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["file", "start", "end", "gap", *named])


def read_archives(files: DataFrame, path: str | None = None, with_payload: bool = True) -> DataFrame:
    """One row for every valid record and every quarantined gap (``gap`` names the failed check).

    ``files`` has the column ``file``: names below ``path`` or, without one, whole URIs;
    or it has ``path`` and ``content`` as Spark's binaryFile source gives them.  With a
    column ``records``, a file must hold so many valid records and no gap, or the job fails.
    """
    inline = "content" in files.columns
    chosen = files.select(F.col("path").alias("file"), "content") if inline else files.select("file", *(["records"] if "records" in files.columns else []))
    counted = "records" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for k, name in enumerate(batch.column(0).to_pylist()):
                if inline:
                    content = batch.column(1)[k].as_py() or b""
                else:
                    store, at = fs.FileSystem.from_uri(f"{path}/{name}" if path else name)
                    with store.open_input_stream(at, compression=None) as f:
                        content = f.read()
                held: list[tuple] = []
                valid = gaps = 0
                for x in salvage(content):
                    valid, gaps = valid + (x[2] is not None), gaps + (x[2] is None)
                    held.append((name, *x))
                    if len(held) == 512:
                        yield _rows(held, with_payload)
                        held = []
                if counted and (gaps or valid != batch.column(1)[k].as_py()):
                    raise ValueError(f"{name}: {valid} records and {gaps} gaps, but {batch.column(1)[k]} records were written")
                yield _rows(held, with_payload)

    return chosen.mapInArrow(run, _ROWS)


def round_trip(pages: DataFrame, path: str, spark: SparkSession, **options) -> DataFrame:
    """Writes the pages and reads the archives back: one row a record."""
    manifest = write_archives(pages, path, **options)
    # a task reads one file at a time; names are dealt out evenly, whatever their number
    files = manifest.select("file", "records").repartition(max(1, min(10_000, manifest.count())), "file")
    return read_archives(files, path, with_payload=False)
