"""Table grammar: cells, units, typed header cells, column periods and packing of rows.

These are kernels over one table (a few dozen rows); they run inside the per-document
parser, where no row has to leave its task.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections import Counter
from dataclasses import dataclass

SOFT, MAX_CAPTIONS, MAX_HEADERS = 1400, 2, 4
_MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m}
_NUMBER = re.compile(r"^\(?[-$]?\s*\$?\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*\)?%?\)?$")
_DASHES = frozenset(["-", "--", "*", "n/a", "nm"])
_YEAR = re.compile(r"^(?:19|20)[0-9]{2}$")
_DATE = re.compile(rf"({'|'.join(_MONTHS)})\s*([0-9]{{1,2}})?\s*,?\s*((?:19|20)[0-9]{{2}})?", re.I)
# fixed values: spans of months by their wording
_SPANS = {"three months": "three_months", "six months": "six_months", "nine months": "nine_months", "twelve months": "twelve_months", "quarter": "three_months", "fiscal year": "fiscal_year", "year ended": "fiscal_year", "years ended": "fiscal_year"}


def format_cells(line: str) -> list[str]:
    """Cells of a pipe row: affixes join the number they belong to, empty cells go."""
    raw = [c.strip() for c in line.split("|")]
    raw = [c for c in raw if c]
    out: list[str] = []
    for i, c in enumerate(raw):
        if c in (")", "%", ")%") and out and re.search(r"[0-9]", out[-1]):
            out[-1] += c
        elif out and out[-1] in ("$", "(", "$(") and re.match(r"[(]?[0-9]", c):
            out[-1] = c if out[-1] == "$" else out[-1].lstrip("$") + c
        elif c == "$" and i + 1 < len(raw) and raw[i + 1] in _DASHES:
            continue
        else:
            out.append(c)
    return out


def is_number(cell: str) -> bool:
    return cell.lower() in _DASHES or bool(_NUMBER.match(cell)) and not _YEAR.match(cell)


@dataclass
class Label:
    """A typed header cell."""

    text: str
    kind: str
    year: int | None = None
    month: int | None = None
    day: int | None = None
    duration: str | None = None


def read_label(text: str) -> Label:
    """Year, number, duration, date, change or other, in this order of trial."""
    low = " ".join(text.lower().split())
    if _YEAR.match(low):
        return Label(text, "date", int(low))
    if is_number(text):
        return Label(text, "number")
    span = next((v for k, v in _SPANS.items() if k in low), None)
    m = _DATE.search(low)
    year = m and m[3] or (re.search(r"\b((?:19|20)[0-9]{2})\b", low) or [None, None])[1]
    if "change" in low or "increase" in low or low in ("$", "%"):
        return Label(text, "change")
    month = _MONTHS[m[1].lower()] if m and (m[2] or m[3] or span) else None
    kind = "period" if span else "date" if month or year else "other"
    return Label(text, kind, int(year) if year else None, month, int(m[2]) if m and m[2] else None, span)


def iso_date(year: int | None, month: int | None, day: int | None) -> str | None:
    """A date; without a day the month's last; none if it isn't one."""
    if not year or not month:
        return None
    try:
        return dt.date(year, month, day or calendar.monthrange(year, month)[1]).isoformat()
    except ValueError:
        return None


def spread(labels: list[Label], slots: int) -> list[Label | None]:
    """Labels over equal groups of slots; nobody gets one if the groups aren't equal."""
    if not labels or slots % len(labels):
        return [None] * slots
    group = slots // len(labels)
    return [labels[i // group] for i in range(slots)]


def shape(rows: list[list[str]]) -> int | None:
    """The usual number of value cells of labelled rows; the wider in a tie."""
    counts = Counter(sum(is_number(c) for c in r[1:]) for r in rows if r and not is_number(r[0]))
    counts.pop(0, None)
    return max(counts, key=lambda n: (counts[n], n)) if counts else None


def columns(headers: list[list[str]], rows: list[list[str]]) -> tuple[list[dict], str | None]:
    """Columns (index, label, period_end, duration) and how they were found: parsed, unverified_shape or None."""
    n = shape(rows)
    if n is None:
        return [], None
    read = [[read_label(c) for c in h] for h in headers]
    read = [[x for x in h if x.kind != "number"] for h in read]
    # a leading cell over the labels of the rows is no column; what it says of time holds for all of them
    read = [part for h in read for part in (([h[:1]] if h[0].kind in ("date", "period") else []) + [h[1:]] if len(h) == n + 1 else [h])]
    if not any(x.kind in ("date", "period") for h in read for x in h):
        return [], None
    laid = [spread(h, n) for h in read if h]
    if not any(len(h) == n for h in read) and not all(any(x) for x in laid):
        return [], "unverified_shape"
    out = []
    for i in range(n):
        own = [x[i] for x in laid if x[i]]
        change = any(x.kind == "change" for x in own)
        pick = lambda name, own=own: next((getattr(x, name) for x in reversed(own) if getattr(x, name)), None)
        out.append({"index": i, "label": " ".join(x.text for x in own), "period_end": None if change else iso_date(pick("year"), pick("month"), pick("day")), "duration": None if change else pick("duration")})
    return out, "parsed"


def pack_rows(prefix: str, rows: list[str], soft: int = SOFT) -> list[str]:
    """Rows in chunks of at most ``soft`` characters, each beginning with the captions and headers."""
    out: list[str] = []
    held: list[str] = []
    for r in rows:
        if held and len(prefix) + sum(len(x) + 1 for x in held) + len(r) + 1 > soft:
            out.append("\n".join([prefix, *held] if prefix else held))
            held = []
        held.append(r)
    if held:
        out.append("\n".join([prefix, *held] if prefix else held))
    return out


def read_table(lines: list[str]) -> dict:
    """Captions, headers, data rows, columns and chunks of one block of lines."""
    captions, headers, data = [], [], []
    for line in lines:
        cells = format_cells(line) if "|" in line else []
        if any(is_number(c) for c in cells[1:]) and not (not data and all(_YEAR.match(c) or not re.search("[0-9]", c) for c in cells)):
            data.append(line)
        elif data:
            data.append(line)
        elif len(cells) > 1 or (cells and read_label(cells[0]).kind in ("date", "period")):
            headers.append(line)
        elif line.strip():
            captions.append(line)
    captions, headers = captions[-MAX_CAPTIONS:], headers[:MAX_HEADERS]
    found, source = columns([format_cells(h) for h in headers], [format_cells(d) for d in data])
    prefix = "\n".join([*captions, *headers])
    return {"captions": captions, "headers": headers, "rows": data, "columns": found, "column_source": source, "chunks": pack_rows(prefix, data)}
