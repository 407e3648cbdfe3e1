"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: start tags, named by their path of elements with class,
id and role, and the texts of its blocks.  Over the pages of a host every token has an
occurrence vector (how often it stands on each page); tokens with one vector form an
equivalence class.  A vector is never gathered: its signature is the xor, over pages, of
a hash of page and count, which is aggregated like a sum.

A class is valid if each member stands once a page, on enough of the host's pages, and if
it has at least ``MIN_MEMBERS`` members, a tag among them.  Valid classes are nested: the
class around a member is that of the nearest tag around it that is in one, and a class
whose outermost members lie in more than one other class is no part of a template.  The nested classes are
the host's template; its texts are constants, and what remains of a page are the slots.

On every page, in articles too, constants go; of the rest, slots are main text unless the elements around them are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments, by element name or
by class, id and role.  Where a page has article or main elements, only slots inside them
are main text.

Copies are no template: pages of a host that share their longest block are counted once,
and a host needs ``MIN_PAGES`` pages that differ in it.  And where constants make up more
than half of the characters of the page's article or main elements, those are a copy with
small changes, and the constants are kept.

Templates are small (a token must stand on half of a host's pages); they are shipped to
the tasks if there are at most ``SHIPPED`` rows of them, and joined by host otherwise.

Defined results: a null or empty html gives an empty text; a null url is a host of its
own; a host with too few different pages has no template and is read by its elements
alone; cut-off pages are read to their end; a script, style, textarea or title that never
ends takes the rest of its page; repeated rows and null ids are read like any row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import checkpoint, text_or_empty

MIN_PAGES, MIN_SHARE, MIN_MEMBERS = 8, 0.5, 3
SHIPPED = 200_000
# fixed values: element names of HTML, and words of class, id and role that name what is not main text
_RAW = "script|style|textarea|title"
_DROP = frozenset("head nav header footer aside form button select option dialog menu noscript template svg math iframe object canvas audio video".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall popup promo promotion promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser teasers toolbar widget widgets complementary contentinfo".split()
)
# fixed values: words that only place or number what stands beside them in a name
_NEUTRAL = frozenset("area bar block bottom box btn button buttons center col column container first footer form global group header icon icons inner item items js last layout left line link links list main mobile outer page panel primary right row secondary section side site slot small sticky sub text title top unit wrap wrapper zone".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:(?<=/>)|.*?(?:</(?P=raw)\s*>|\Z))|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(text, 7)
    return x - (1 << 64) if x >> 63 else x


def attributes(text: str) -> dict[str, str]:
    """Lower-case names to values; values are read whole, so nothing inside one is taken for a name."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def _names_boilerplate(value: str) -> bool:
    """Whether one of the names in a class, id or role says so: all of it, but for words that only place it."""
    for token in value.lower().split():
        words = [w for w in _SPLIT.split(_DIGITS.sub("", token)) if w]
        if any(w in _WORDS for w in words) and all(w in _WORDS or w in _NEUTRAL for w in words):
            return True
    return False


def _boilerplate(name: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is not main text; a header inside an article holds its title."""
    if name in _DROP and not (name == "header" and inside):
        return True
    if not attrs or name in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return any(_names_boilerplate(attrs[k]) for k in ("class", "id", "role") if k in attrs)


class Page:
    """Tokens of a page: ``tags`` (key, parent key), and ``blocks`` (text, inside article or main, keys of the tags around it).

    ``chains`` has the keys around every tag, the nearest first; a key is made of its parent's, so it has one chain.
    """

    def __init__(self, html: str):
        self.tags: list[tuple[int, int]] = []
        self.blocks: list[tuple[str, bool, tuple[int, ...]]] = []
        self.chains: dict[int, tuple[int, ...]] = {0: ()}
        stack: list[tuple[str, bool, bool, int]] = []  # name, dropped, inside, key
        held: list[str] = []
        dropped = inside = False
        pos = 0

        def flush() -> None:
            if held:
                text = " ".join(entities.unescape("".join(held)).split())
                if text:
                    self.blocks.append((text, inside, tuple(s[3] for s in stack)))
                held.clear()

        def leave() -> None:
            nonlocal dropped, inside
            stack.pop()
            dropped, inside = stack[-1][1:3] if stack else (False, False)

        for m in _TOKEN.finditer(html):
            if not dropped and m.start() > pos:
                held.append(html[pos : m.start()])
            pos = m.end()
            name = m["name"]
            if not name:
                continue
            name = name.lower()
            if name == "br":
                held.append(" ")
                continue
            if name in _BLOCK:
                flush()
            if m["end"]:
                if any(s[0] == name for s in stack):
                    while stack[-1][0] != name:
                        leave()
                    leave()
                continue
            while stack and name in _CLOSED_BY.get(stack[-1][0], ()):
                leave()
            attrs = attributes(m["attrs"]) if m["attrs"] else {}
            own = stack[-1][3] if stack else 0
            key = own
            if name in _BLOCK or name in _DROP:
                key = _hash(f"{own}/{name} {attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}")
                self.tags.append((key, own))
                self.chains[key] = (own, *self.chains[own]) if own else ()
            if name in _VOID or m["attrs"].endswith("/"):
                continue
            if not dropped and _boilerplate(name, attrs, inside):
                flush()
                dropped = True
            inside = inside or name in ("article", "main") or attrs.get("role", "").lower() == "main"
            stack.append((name, dropped, inside, key))
        if not dropped and pos < len(html):
            held.append(html[pos:])
        flush()

    def body(self) -> int:
        """What pages that are copies share: their longest block."""
        return _hash("body " + max((t for t, _, _ in self.blocks), key=len, default=""))

    def tokens(self) -> dict[tuple[int, bool], list[int]]:
        """(key, is a text) to [count, parent key] of every token."""
        out: dict[tuple[int, bool], list[int]] = {}
        for key, parent in self.tags:
            out.setdefault((key, False), [0, parent])[0] += 1
        for text, _, around in self.blocks:
            out.setdefault((_hash("text " + text), True), [0, around[-1] if around else 0])[0] += 1
        return out

    def around(self, parent: int) -> list[int]:
        """The keys of ``parent`` and of the tags around it, the nearest first."""
        return [parent, *self.chains[parent]] if parent else []


def main_text(html: str, constants: frozenset | set = frozenset()) -> str:
    """Blocks of the main slots, joined by two line breaks; ``constants`` holds the keys of the template's texts."""
    blocks = Page(html).blocks
    some = any(inside for _, inside, _ in blocks)
    kept = [(text, bool(constants) and _hash("text " + text) in constants) for text, inside, _ in blocks if inside or not some]
    fixed = sum(len(text) for text, constant in kept if constant)
    # an article that is mostly constants is a copy of another, not a template
    if some and 2 * fixed > sum(len(text) for text, _ in kept):
        return "\n\n".join(text for text, _ in kept)
    return "\n\n".join([text for text, constant in kept if not constant] or [text for text, _ in kept])


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")).alias("host")


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, key, is_text): the tokens of every host's template."""
    row = F.xxhash64(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).alias("page")
    plain = pages.select(F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"), row).select(_host(), "html", "page")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(h).body() for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["host", "page", "body"])

    # of the pages that share a body, one row; rows that repeat it in all are one page, too
    named = plain.mapInArrow(bodies, "host string, page long, body long")
    single = checkpoint(named.groupBy("host", "body").agg(F.min("page").alias("page"), F.count("*").alias("n")))
    whole = checkpoint(single.groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("of_pages")).where(F.col("of_pages") >= MIN_PAGES))
    chosen = single.join(whole, F.col("host") == F.col("of_host"), "left_semi").select(F.col("page").alias("of_page"), "n")
    read = plain.join(chosen, F.col("page") == F.col("of_page"))
    read = read.where("n = 1").select("host", "html", "page").unionByName(read.where("n > 1").select("host", "html", "page").dropDuplicates(["page"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int, bool], list[int]] = {}
            for host, html, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read_page = Page(html)
                for (key, is_text), (n, parent) in read_page.tokens().items():
                    s = sums.get((host, key, is_text))
                    if s is None:
                        s = sums[host, key, is_text] = [0, 0, 0, parent, parent, read_page.around(parent)]
                    s[0] += 1
                    s[1] += n
                    s[2] ^= _hash(f"{page} {n}")
                    s[3], s[4] = min(s[3], parent), max(s[4], parent)
            rows = [(*k, *v) for k, v in sums.items()]
            types = (pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["host", "key", "is_text", "pages", "total", "sig", "low", "high", "chain"])

    tokens = read.mapInArrow(count, "host string, key long, is_text boolean, pages long, total long, sig long, low long, high long, chain array<bigint>")
    tokens = tokens.groupBy("host", "key", "is_text").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.bit_xor("sig").alias("sig"), F.min("low").alias("low"), F.max("high").alias("high"), F.any_value("chain").alias("chain"))
    common = tokens.join(whole, F.col("host") == F.col("of_host")).where((F.col("pages") >= MIN_SHARE * F.col("of_pages")) & (F.col("total") == F.col("pages")) & (F.col("low") == F.col("high")))
    common = checkpoint(common.select("host", "key", "is_text", "sig", "chain"))
    classes = common.groupBy("host", "sig").agg(F.count("*").alias("members"), F.count_if(~F.col("is_text")).alias("tags"))
    large = classes.where((F.col("members") >= MIN_MEMBERS) & (F.col("tags") >= 1)).select(F.col("host").alias("c_host"), F.col("sig").alias("c_sig"))
    members = common.join(large, (F.col("host") == F.col("c_host")) & (F.col("sig") == F.col("c_sig"))).select("host", "key", "is_text", "sig", "chain")
    # the class of the nearest tag around a member that is in one; 0 stands for the page itself
    above = members.where(~F.col("is_text")).select(F.col("host").alias("a_host"), F.col("key").alias("a_key"), F.col("sig").alias("a_sig"))
    steps = members.select("host", "key", "is_text", "sig", F.posexplode_outer("chain").alias("pos", "at"))
    met = steps.join(above, (F.col("host") == F.col("a_host")) & (F.col("at") == F.col("a_key")), "left")
    nearest = F.min(F.when(F.col("a_sig").isNotNull(), F.struct("pos", "a_sig")))
    placed = checkpoint(met.groupBy("host", "key", "is_text", "sig").agg(nearest.alias("near")).select("host", "key", "is_text", "sig", F.coalesce("near.a_sig", F.lit(0).cast("long")).alias("around")))
    nests = placed.where(F.col("around") != F.col("sig")).groupBy(F.col("host").alias("n_host"), F.col("sig").alias("n_sig")).agg(F.count_distinct("around").alias("places"))
    torn = nests.where("places > 1").select("n_host", "n_sig")
    return checkpoint(placed.join(torn, (F.col("host") == F.col("n_host")) & (F.col("sig") == F.col("n_sig")), "left_anti").select("host", "key", "is_text"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    found = templates(pages, id_col, url_col, html_col)
    texts = found.where("is_text")
    per_host = texts.groupBy("host").agg(F.collect_list("key").alias("constants"))
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html")).select("page_id", "url", _host(), "html")
    if texts.count() <= SHIPPED:
        shipped = {r["host"]: frozenset(r["constants"]) for r in per_host.collect()}
        plain = plain.withColumn("constants", F.lit(None).cast("array<bigint>"))
    else:
        shipped = {}
        plain = plain.join(per_host.withColumnRenamed("host", "of_host"), F.col("host") == F.col("of_host"), "left").select("page_id", "url", "host", "html", "constants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, htmls, keys = (batch.column(i).to_pylist() for i in range(2, 5))
            out = [main_text(h, frozenset(k) if k else shipped.get(host, frozenset())) for host, h, k in zip(hosts, htmls, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return plain.mapInArrow(run, f"page_id {kind}, url {url_kind}, text string")
