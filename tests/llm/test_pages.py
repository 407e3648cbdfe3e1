"""WARC round trips and main-text extraction against brute force, and their edge cases."""

import base64
import hashlib
import html as entities
import re

import pytest

from pyspark.sql import functions as F

from folioscope.llm import html_extract, queries, warc
from folioscope.llm.common import scratch

EDGE = [
    (1, None, None),
    (2, "http://a.example/x", ""),
    (3, "http://a.example/y", "<p>same</p>"),
    (4, "http://a.example/z", "<p>same</p>"),
    (4, "http://a.example/z", "<p>same</p>"),
    (None, "http://b.example/\r\nInjected: 1", "<p>same</p>"),
    (6, "http://b.example/", "<p>" + "long \U0001f600 " * 60000),
    (7, "nothing", "plain text & <b>bold"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").collect()


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_query_against_brute_force(spark, sf, pages):
    largest = {}
    for p in pages:
        largest[digest(p.html)] = max(p.page_id, largest.get(digest(p.html), -1))
    want = {(p.page_id, len(p.html.encode()), digest(p.html), "response" if largest[digest(p.html)] == p.page_id else "revisit", None if largest[digest(p.html)] == p.page_id else largest[digest(p.html)]) for p in pages}
    assert {tuple(r) for r in queries.op9_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == want


def test_warc_edges(spark, edge):
    rows = warc.round_trip(edge, scratch(spark, "edge"), spark).collect()
    assert len(rows) == len(EDGE) and all(r.gap is None for r in rows)
    kinds = sorted((r.source_id or 0, r.record_type, r.refers_to) for r in rows if r.payload_digest == digest("<p>same</p>"))
    assert kinds == [(0, "revisit", 4), (3, "revisit", 4), (4, "response", None), (4, "response", None)]
    assert warc.round_trip(edge.limit(0), scratch(spark, "none"), spark).collect() == []
    some = warc.round_trip(edge, scratch(spark, "min"), spark, min_bytes=100).collect()
    assert all(r.record_type == "response" for r in some)


def test_warc_payloads_come_back_whole(spark, edge):
    at = scratch(spark, "whole")
    manifest = warc.write_archives(edge, at, roll_bytes=200)
    rows = warc.read_archives(manifest, at).collect()
    assert {(r.source_id, bytes(r.payload).decode()) for r in rows if r.record_type == "response"} == {(i, t or "") for i, _, t in EDGE if (i, t) not in ((1, None), (3, "<p>same</p>"), (None, "<p>same</p>"))}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(at)
    assert warc.read_archives(files).count() == len(EDGE)


def test_warc_salvage_logs_every_lost_byte():
    import random

    rnd = random.Random(1)
    records = [warc.make_record(i, f"http://x/{i}", bytes(rnd.choices(b"abc<>", k=300)), "", n=300) for i in range(30)]
    records = [warc.make_record(i, f"http://x/{i}", r.split(b"\r\n\r\n")[2], warc.digest_of(r.split(b"\r\n\r\n")[2])) for i, r in enumerate(records)]
    for compress in (warc.member, lambda r: r):
        parts = [compress(r) for r in records]
        for lost in range(0, 30, 7):
            broken = bytearray(parts[lost])
            broken[len(broken) // 2] ^= 0xFF
            content = b"".join([*parts[:lost], bytes(broken), b"\x1f\x8b\x08junk", *parts[lost + 1 :]])
            found = list(warc.salvage(content))
            assert [f[2]["source_id"] for f in found if f[2]] == [i for i in range(30) if i != lost]
            assert [(f[0], f[1]) for f in found if f[3]] == [(sum(map(len, parts[:lost])), sum(map(len, parts[: lost + 1])) + 7)]
            assert found[0][0] == 0 and found[-1][1] == len(content) and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert list(warc.salvage(b"")) == []


def slow_text(html):
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
    parts = [re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:h1|h2|p|li|ul|div)\b[^>]*>", article)]
    return "\n\n".join(b for b in (" ".join(entities.unescape(p).split()) for p in parts) if b)


def test_html_query_against_brute_force(spark, sf, pages):
    rows = {r.page_id: r for r in queries.op7_html_extraction(spark, sf).collect()}
    assert {k: r.text for k, r in rows.items()} == {p.page_id: slow_text(p.html) for p in pages}
    assert all(r.n_chars == len(r.text) for r in rows.values())


def test_html_boilerplate_by_element_and_by_template(spark):
    page = "<html><body><div>Site slogan stands here</div><div class='side-menu'>Menu</div><div id='cookie-notice'>We use</div><h2>Title {0}</h2><div>Own text {0}<br>goes &lt;on&gt; &amp; <i>on</i></div><div class='comments'><p>reader {0}</p></div><form>Join</form></body></html>"
    rows = [(i, f"https://u@h.example:80/{i}", page.format(i)) for i in range(8)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Title {i}\n\nOwn text {i} goes <on> & on" for i in range(8)}


def test_html_article_parts():
    page = '<body><header><h1>Site</h1></header><main><article class="post"><header><h1>T</h1></header><p>One<p>two <script>var a="</p>";</script><a title="x>y">link</a><aside>no</aside><div class="ad">no</div></article></main><footer>f'
    assert html_extract.main_text(page) == "T\n\nOne\n\ntwo link"
    assert html_extract.main_text("") == "" and html_extract.main_text("just text") == "just text"


def test_html_edges(edge):
    rows = html_extract.extract(edge).collect()
    assert len(rows) == len(EDGE)
    by = {r.page_id: r.text for r in rows}
    assert by[1] == "" and by[3] == "same" and by[7] == "plain text & bold"
    assert html_extract.extract(edge.limit(0)).collect() == []


def test_html_names_are_read_whole():
    text = html_extract.main_text
    assert text('<article><div style="overflow:hidden"><p>Keep me') == "Keep me"
    assert text('<article><p title="hidden gems">Keep me') == "Keep me"
    assert text('<article><p data-id="share-1">Keep me') == "Keep me"
    assert text('<article><section id="reply-rates"><p>Body') == "Body"
    assert text("<article><svg/><p>After svg") == "After svg" and text("<article><iframe src=x /><p>After") == "After"
    assert text('<article class="teaser"><p>no</p></article><article><p>yes</p></article>') == "yes"
    assert text('<article><p hidden>no<p>yes<p aria-hidden="true">no<div class="x comment-list-2">no</div>') == "yes"
    assert text("<article><p>one<script>lost <p>to the end") == "one"


NOTICE = "<div class='x1'><p>Prices of this shop are in local money.</p></div>"


def host_pages(n, host, notice=True, body=None):
    page = "<html><body><div class='t'><div>Shop</div></div><article><h1>T{0}</h1>{1}<p>{2}</p></article><div class='z'>Bottom</div></body></html>"
    return [(i, f"http://{host}/{i}", page.format(i, NOTICE if notice else "", body or f"Text number {i} is about things of its own, at some length. " * 3)) for i in range(n)]


def test_html_constants_go_inside_articles_but_copies_stay(spark):
    own = "A long text that all pages share but for their title. " * 4
    rows = host_pages(9, "a") + [(100 + i, u, h) for i, u, h in host_pages(9, "b", False, own)] + [(200 + i, u, h) for i, u, h in host_pages(4, "c")]
    rows += [(300 + i, u.replace("//b", "//d"), h.replace("A long text", f"{i} A long text", 1)) for i, u, h in host_pages(12, "b", False, own)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("no")).withColumn("key", F.lit(1)).withColumn("text", F.lit("no"))
    out = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    for i in range(9):
        assert out[i] == f"T{i}\n\n" + ("Text number %d is about things of its own, at some length. " % i * 3).strip()
        assert out[100 + i] == f"T{i}\n\n{own.strip()}"
    for i in range(4):  # too few pages for a template
        assert "local money" in out[200 + i]
    for i in range(12):
        assert out[300 + i] == f"T{i}\n\n{i} {own.strip()}"


def slow_template(htmls):
    """Occurrence vectors, classes and nesting of one host, all in memory."""
    pages = [html_extract.Page(h) for h in htmls]
    tokens, vectors, parents = [p.tokens() for p in pages], {}, {}
    chains = {k: c for p in pages for k, c in p.chains.items()}
    for k in {k for t in tokens for k in t}:
        vectors[k] = tuple(t[k][0] if k in t else 0 for t in tokens)
        parents[k] = {t[k][1] for t in tokens if k in t}
    ok = {k: v for k, v in vectors.items() if max(v) == 1 and sum(v) * 2 >= len(pages) and len(parents[k]) == 1}
    valid = {v for v in ok.values() if sum(x == v for x in ok.values()) >= 3 and any(x == v and not k[1] for k, x in ok.items())}
    ok = {k: v for k, v in ok.items() if v in valid}
    above = {k: [p, *chains[p]] for k in ok for p in parents[k]}
    around = {k: next((ok[a, False] for a in above[k] if (a, False) in ok), None) for k in ok}
    torn = {v for v in valid if len({around[k] for k in ok if ok[k] == v and around[k] != v}) > 1}
    return {k for k, v in ok.items() if v not in torn}


def test_html_template_against_brute_force(spark):
    import random

    rnd = random.Random(6)
    for n in (8, 13):
        htmls = []
        for i in range(n):
            parts = [f"<div class='{c}'><ul><li>{c} {'' if rnd.random() < 0.8 else i}</li></ul><h3>{c}</h3></div>" for c in "abcd" if rnd.random() < 0.75]
            rnd.shuffle(parts)
            htmls.append(f"<body><div id=w>{''.join(parts)}<article><p>Some longer text number {i} {'x' * i} {rnd.random()}</p></article></div><table><tr><td>end</table>")
        df = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
        got = {(r.key, r.is_text) for r in html_extract.templates(df.unionByName(df)).collect()}
        assert got == slow_template(htmls) and got
