"""Filings: reading zipped or plain text documents, parsing them, and the chunk store.

Archives and folders are read by Spark, one document a row; the grammar of a document
runs where the document is, and only fiscal labels need other documents of its filer.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import tables

RULE = "=" * 60
# fixed values: the items of annual and quarterly reports and words of their titles
ITEMS = {
    "10-K": {"1": "business", "1A": "risk factors", "1B": "unresolved staff comments", "1C": "cybersecurity", "2": "properties", "3": "legal proceedings", "5": "market for registrant", "7": "management's discussion", "7A": "quantitative and qualitative", "8": "financial statements", "9A": "controls and procedures", "15": "exhibits"},
    "10-Q": {"1": "financial statements", "2": "management's discussion", "3": "quantitative and qualitative", "4": "controls and procedures", "1A": "risk factors", "5": "other information", "6": "exhibits"},
}
_ITEM = re.compile(r"^[ \t]*(?:part[ \t]+(i{1,2})[ ,.:-]*)?item[ \t]+([0-9]{1,2}[abc]?)[ \t]*[.:-]*[ \t]*(.*)$", re.I | re.M)
_PART = re.compile(r"^[ \t]*part[ \t]+(i{1,2})\b", re.I | re.M)
_PAGE_REF = re.compile(r"[ .|]\s*[0-9]{1,3}\s*$")
_NOTE = re.compile(r"^[ \t]*(?:note[ \t]+)?([0-9]{1,2})[ \t]*[.:-][ \t]*([A-Z][^\n|:]{2,100})", re.I | re.M)
STUB_CHARS, MIN_PROSE = 2500, 300
SCHEMA = "file string, ticker string, cik string, company string, form string, filing_date string, period_end string, period_source string, sections array<struct<part:string,item:string,title:string,start:int,end:int,is_stub:boolean,notes:array<struct<number:int,title:string,start:int,end:int>>>>, body string"
CHUNKS = "chunk_id string, file string, ticker string, item string, note_title string, kind string, seq int, units string, units_source string, columns array<struct<index:int,label:string,period_end:string,duration:string>>, column_source string, text string, n_tokens int"


def read_zip(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """(file, raw) of every ``.txt`` member of the archives at ``path``, in name order; a subset is taken before members are unpacked."""
    wanted = frozenset(files) if files is not None else None

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".txt")):
                        if wanted is None or name.rsplit("/", 1)[-1] in wanted:
                            yield pd.DataFrame({"file": [name.rsplit("/", 1)[-1]], "raw": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "file string, raw string")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw) of every text file of a folder."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("raw"))


def parse_header(text: str) -> dict[str, str]:
    top, rule, _ = text.partition(RULE)
    if not rule:
        raise ValueError("the header has no rule")
    pairs = (line.split(":", 1) for line in top.split("\n") if ":" in line)
    return {k.strip(): v.strip() for k, v in pairs if k.strip() != "Quarter"}


def body_start(text: str) -> int:
    m = re.search(r"securities\s+and\s+exchange\s+commission", text, re.I)
    if not m:
        raise ValueError("the cover is missing")
    return m.start()


def cut_signatures(body: str) -> str:
    last = None
    for last in re.finditer(r"\bSIGNATURES?\b", body):
        pass
    return body[: last.start()] if last and last.start() >= 0.8 * len(body) else body


def period_end(header: dict, body: str) -> tuple[str, str]:
    """The period's end and where it was read: header, cover or url."""
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", header.get("Report Period", "")):
        return header["Report Period"], "header"
    m = re.search(r"(?:year|period|quarter)(?:ly period)? ended:?\s+([A-Za-z]+\s+[0-9]{1,2},?\s+[0-9]{4})", body[:20_000], re.I)
    if m:
        x = tables.read_label(m[1])
        found = tables.iso_date(x.year, x.month, x.day)
        if found:
            return found, "cover"
    m = re.search(r"(20[0-9]{2})([01][0-9])([0-3][0-9])", header.get("URL", ""))
    if m:
        return f"{m[1]}-{m[2]}-{m[3]}", "url"
    raise ValueError("no period end")


def detect_sections(body: str, form: str) -> list[dict]:
    """Items in order: headings whose title fits and that aren't lines of a table of contents; the longest of an item's spans counts."""
    titles = ITEMS.get(form, ITEMS["10-K"])
    parts = [(m.start(), m[1].upper()) for m in _PART.finditer(body)]
    marks = []
    for m in _ITEM.finditer(body):
        item, rest = m[2].upper(), m[3].strip().lower()
        if item not in titles or _PAGE_REF.search(m[0]) or not (not rest or rest.startswith(titles[item][:12]) or titles[item][:12] in rest[:60]):
            continue
        part = None
        if form == "10-Q":
            part = (m[1] or next((p for at, p in reversed(parts) if at <= m.start()), "I")).upper()
        marks.append((m.start(), part, item, m[3].strip()))
    spans = [(*x, marks[i + 1][0] if i + 1 < len(marks) else len(body)) for i, x in enumerate(marks)]
    best: dict[tuple, tuple] = {}
    for s in spans:
        key = (s[1], s[2])
        if key not in best or s[4] - s[0] > best[key][4] - best[key][0]:
            best[key] = s
    chosen = sorted(best.values())
    out = [{"part": None, "item": "COVER", "title": "Cover", "start": 0, "end": chosen[0][0] if chosen else len(body), "is_stub": False, "notes": []}]
    for i, (start, part, item, title, _) in enumerate(chosen):
        end = chosen[i + 1][0] if i + 1 < len(chosen) else len(body)
        text = body[start:end]
        stub = len(text) < STUB_CHARS and bool(re.search(r"incorporated (?:herein )?by reference|no material changes|see (?:part|item|note)|not applicable", text, re.I))
        statements = item == "8" or (part == "I" and item == "1")
        out.append({"part": part, "item": f"{part}.{item}" if part else item, "title": title, "start": start, "end": end, "is_stub": stub, "notes": detect_notes(body, start, end) if statements else []})
    return out


def detect_notes(body: str, start: int, end: int) -> list[dict]:
    """Numbered notes in an ascending chain: from 1 or 2, each one or two further."""
    chain, last = [], 0
    for m in _NOTE.finditer(body, start, end):
        n = int(m[1])
        if (last == 0 and n in (1, 2)) or (last and last < n <= last + 2):
            if not _PAGE_REF.search(m[0]):
                chain.append((n, m[2].strip(), m.start()))
                last = n
    return [{"number": n, "title": t, "start": s, "end": chain[i + 1][2] if i + 1 < len(chain) else end} for i, (n, t, s) in enumerate(chain)]


def parse_filing(file: str, raw: str) -> dict:
    """One parsed document; anything missing raises, and with it the build."""
    text = re.sub(r"[ \t]{2,}", " ", raw)
    header = parse_header(text)
    body = text[text.index(RULE) + len(RULE) :]
    body = cut_signatures(body[body_start(body) :])
    form = header["Filing Type"].split()[0]
    end, source = period_end(header, body)
    return {"file": file, "ticker": header.get("Ticker"), "cik": header.get("CIK"), "company": header.get("Company"), "form": form, "filing_date": header.get("Filing Date"), "period_end": end, "period_source": source, "sections": detect_sections(body, form), "body": body}


def parse(raw: DataFrame) -> DataFrame:
    """Parsed filings of (file, raw)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([parse_filing(f, r) for f, r in zip(pdf["file"], pdf["raw"], strict=True)], columns=[c.split(" ")[0] for c in ("file", "ticker", "cik", "company", "form", "filing_date", "period_end", "period_source", "sections", "body")])

    return raw.mapInPandas(run, SCHEMA)


def _units(text: str) -> str | None:
    m = re.search(r"\((?:[^()]*\b)?in (thousands|millions|billions)([^)]*)\)", text, re.I)
    if not m:
        return None
    beyond = m[2].strip(" ,")
    return f"USD {m[1].lower()}" + (f", {beyond}" if beyond else "")


def chunk_filing(f: dict) -> list[dict]:
    """Chunks of a filing: tables keep captions, units and columns; prose is packed by sentences; short prose goes."""
    from hashlib import sha1

    out = []
    for s in f["sections"]:
        units = None
        at = s["start"]
        blocks: list[tuple[str, int, list[str]]] = []
        for line in f["body"][s["start"] : s["end"]].split("\n"):
            kind = "table" if "|" in line else "prose"
            if not blocks or blocks[-1][0] != kind:
                blocks.append((kind, at, []))
            blocks[-1][2].append(line)
            at += len(line) + 1
        for i, (kind, start, lines) in enumerate(blocks):
            note = next((n["title"] for n in s["notes"] if n["start"] <= start < n["end"]), None)
            if kind == "table" and len(lines) >= 3:
                captions = [x for x in (blocks[i - 1][2] if i else []) if x.strip()][-tables.MAX_CAPTIONS :]
                captions = [c for c in captions if len(c) < 250]
                t = tables.read_table([*captions, *lines])
                declared = next((u for u in map(_units, [*t["headers"], *t["captions"]]) if u), None)
                units = declared or units
                texts, extra = t["chunks"], {"units": units, "units_source": "declared" if declared else "inherited" if units else None, "columns": t["columns"], "column_source": t["column_source"]}
            else:
                texts, extra = _prose("\n".join(lines)), {"units": None, "units_source": None, "columns": [], "column_source": None}
                kind = "cover" if s["item"] == "COVER" else "prose"
            for k, text in enumerate(texts):
                if kind != "table" and len(text) < MIN_PROSE:
                    continue
                key = f"{f['file']}:{start}:{k}"
                out.append({"chunk_id": sha1(key.encode()).hexdigest()[:16], "file": f["file"], "ticker": f["ticker"], "item": s["item"], "note_title": note, "kind": kind, "seq": len(out), **extra, "text": text, "n_tokens": -(-len(text) // 4)})
    return out


def _prose(text: str, soft: int = 1400) -> list[str]:
    out: list[str] = []
    for s in re.split(r"(?<=[.!?])\s+|\n", text):
        if not s.strip():
            continue
        if out and len(out[-1]) + 1 + len(s) <= soft:
            out[-1] += " " + s.strip()
        else:
            out.append(s.strip())
    return out


def chunk(parsed: DataFrame) -> DataFrame:
    """All chunks of parsed filings."""
    names = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>+", "", CHUNKS).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.to_dict("records"):
                yield pd.DataFrame(chunk_filing(f), columns=names)

    return parsed.mapInPandas(run, CHUNKS)


def fingerprint(raw: DataFrame, settings: str) -> str:
    """Digest of all documents and the settings; equal fingerprints need no rebuild."""
    each = raw.select(F.sha2(F.concat_ws("\0", "file", F.sha2("raw", 256)), 256).alias("d"))
    # digests are combined by aggregates that don't depend on order; none are collected
    parts = each.agg(F.count("*").alias("n"), *(F.bit_xor(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("long")).alias(f"x{i}") for i in range(4))).first()
    from hashlib import sha256

    return sha256(f"{settings}|{tuple(parts)}".encode()).hexdigest()


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk store, one folder a ticker."""
    chunks.write.mode("overwrite").partitionBy("ticker").parquet(path)


def read_chunks(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """The chunk store; a subset of tickers prunes folders."""
    df = spark.read.parquet(path)
    return df.where(F.col("ticker").isin(tickers)) if tickers is not None else df
