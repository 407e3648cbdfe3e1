"""Registered queries over the driver tables and their DuckDB oracles.

Every query applies operators of the library to whole tables; names follow the operator
they exercise.  Doubles are rounded in both, counts are long in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import replies
from folioscope.functions import text as T
from folioscope.operators import checks, evals, fiscal, retrieval, search, structure
from folioscope.plans import planner

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

TERMS = search.query_terms("the Apache version of public")


def annual() -> Column:
    return F.substring("o_orderpriority", 1, 1) == "1"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: the customer is the filer, the order date the period end, priority 1 the annual form."""
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority")


# ---- text --------------------------------------------------------------------------------

_SQUEEZE = "trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_FROM = "   ‘’“”–—−​­"
_NORM = f"regexp_replace(translate({{0}}, '{_FROM}', '   ''''\"\"---'), '[ \\t]{{{{2,}}}}', ' ', 'g')"


def _norm_sql(c: str) -> str:
    return _NORM.format(c).replace("{{", "{").replace("}}", "}")


@query(f"SELECT doc_id, length(n) AS n_chars, sha1(n) AS digest FROM (SELECT doc_id, {_norm_sql('text')} AS n FROM documents)")
def normalize_docs(spark, sf_dir):
    n = T.normalize_plain(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("long").alias("n_chars"), F.sha1(n).alias("digest"))


@query()
def nfkc(spark, sf_dir):
    n = T.normalize(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("long").alias("n_chars"), F.sha1(n).alias("digest"))


@query("SELECT doc_id, CAST(floor((length(text) + 3) / 4) AS BIGINT) AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens"))


_LINES = """lines AS (
  SELECT doc_id, i - 1 AS n, l[i] AS line, coalesce(list_sum(list_transform(l[1:i-1], lambda x: length(x) + 1)), 0) AS start
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)
)"""


@query(f"WITH {_LINES} SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(start AS BIGINT) AS start, length(line) AS n_chars FROM lines")
def line_offsets(spark, sf_dir):
    return structure.lines(read(spark, sf_dir, "documents")).select("doc_id", F.col("n").cast("long").alias("n"), F.col("start").cast("long").alias("start"), F.length("line").cast("long").alias("n_chars"))


@query(f"""WITH {_LINES}, m AS (
  SELECT *, contains(line, '|') AS pipe, lag(contains(line, '|')) OVER w AS before, lead(contains(line, '|')) OVER w AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), i AS (SELECT *, pipe OR (coalesce(before, false) AND coalesce(after, false) AND length(line) < 80) AS inside FROM m
), g AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM i)
SELECT doc_id, CAST(min(n) AS BIGINT) AS first_line, count(*) AS n_lines, count_if(pipe)::BIGINT AS n_rows FROM g WHERE inside GROUP BY doc_id, island HAVING count_if(pipe) >= 3""")
def table_blocks(spark, sf_dir):
    return structure.table_blocks(structure.lines(read(spark, sf_dir, "documents"))).select("doc_id", F.col("first_line").cast("long").alias("first_line"), "n_lines", "n_rows")


@query(f"""WITH {_LINES} SELECT doc_id, trim(line) AS header, count(*) AS copies, CAST(min(n) AS BIGINT) AS kept_line FROM lines
WHERE length(trim(line)) BETWEEN 1 AND 119 AND NOT regexp_matches(trim(line), '[0-9]') GROUP BY 1, 2 HAVING count(*) >= 5""")
def running_headers(spark, sf_dir):
    return structure.running_headers(structure.lines(read(spark, sf_dir, "documents"))).withColumn("kept_line", F.col("kept_line").cast("long"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest FROM s""")
def sentence_split(spark, sf_dir):
    s = structure.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.array_size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


@query("""SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda r: contains(r, '|') AND regexp_matches(regexp_replace(r, '^[^|]*[|]', ''), '[0-9]')), lambda r: trim(split_part(r, '|', 1))) AS labels FROM documents""")
def row_labels(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.row_labels(F.col("text")).alias("labels"))


@query("""SELECT doc_id, n::BIGINT AS n, substr(sha1(concat_ws(':', doc_id::VARCHAR, (n * 1400)::VARCHAR, least(length(text), (n + 1) * 1400)::VARCHAR)), 1, 16) AS chunk_id
FROM documents, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1400.0) AS BIGINT)))) AS u(n)""")
def chunk_ids(spark, sf_dir):
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 1400).cast("int"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"), F.explode(F.sequence(F.lit(0), n - 1)).alias("n"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), T.chunk_id(F.col("doc_id"), F.col("n") * 1400, F.least("size", (F.col("n") + 1) * 1400)).alias("chunk_id"))


@query(f"SELECT conv_id, turn, substr(sha1(lower({_SQUEEZE.format(_norm_sql('text'))})), 1, 16) AS question_key FROM conversations WHERE role = 'user'")
def question_keys(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.question_key(F.col("text")).alias("question_key"))


@query("""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(?:script|style|nav|footer)[^>]*>.*?</(?:script|style|nav|footer)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, length(trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS n_chars FROM t""")
def html_furniture(spark, sf_dir):
    t = F.regexp_replace(F.regexp_replace("html", "(?s)<(?:script|style|nav|footer)[^>]*>.*?</(?:script|style|nav|footer)>", " "), "<[^>]*>", " ")
    return read(spark, sf_dir, "pages").select("page_id", F.length(T.squeeze(t)).cast("long").alias("n_chars"))


@query("SELECT conv_id, turn, replace(text, '</excerpt>', '< /excerpt>') AS fenced, split_part(trim(text), chr(10), 1) AS first_line FROM conversations")
def prompt_fences(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.fence(F.col("text"), "excerpt").alias("fenced"), T.first_line(F.col("text")).alias("first_line"))


@query()
def prose_packing(spark, sf_dir):
    packed = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(retrieval.pack_prose(structure.sentences(F.col("text")))).alias("n", "chunk"))
    return packed.select("doc_id", F.col("n").cast("long").alias("n"), F.length("chunk").cast("long").alias("n_chars"), F.sha1("chunk").alias("digest"))


# ---- search ------------------------------------------------------------------------------

_BM25 = (
    f"tok AS (SELECT doc_id, lang, source, list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({', '.join(repr(w) for w in search.STOP_WORDS)})) AS toks FROM documents), tf AS (SELECT doc_id, lang, source, len(toks) AS dl, {', '.join(f'len(list_filter(toks, lambda t: t = {chr(39)}{t}{chr(39)})) AS tf{i}' for i, t in enumerate(TERMS))} FROM tok), "
    f"st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count_if(tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM tf), "
    f"bm AS (SELECT doc_id, lang, source, dl, round({' + '.join(f'ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} / (tf{i} + 1.5 * (1 - 0.75 + 0.75 * dl / greatest(1e-9, avgdl)))' for i in range(len(TERMS)))}, 6) AS score FROM tf, st)"
)


@query(f"WITH {_BM25} SELECT doc_id, score FROM bm")
def bm25_scores(spark, sf_dir):
    return search.bm25(read(spark, sf_dir, "documents"), TERMS)


@query("SELECT doc_id, 0.0::DOUBLE AS score FROM documents")
def bm25_all_stopwords(spark, sf_dir):
    return search.bm25(read(spark, sf_dir, "documents"), search.query_terms("the, of and IN"))


_COS = """cq AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0),
cs AS (SELECT vec_id AS id, label, round(list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))), 6) AS score
 FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), cq)"""


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()
    return search.cosine(vectors, first[0] if first else [])


@query(f"WITH {_COS} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= 20")
def cosine_topk(spark, sf_dir):
    return search.ranked(_cosine(spark, sf_dir), id_col="id", k=20)


_RRF = f"WITH {_BM25}, {_COS}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 60), b AS (SELECT id AS doc_id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= 60) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id"


@query(_RRF)
def rrf_fused(spark, sf_dir):
    lexical = search.ranked(search.bm25(read(spark, sf_dir, "documents"), TERMS), k=60)
    dense = search.ranked(_cosine(spark, sf_dir).withColumnRenamed("id", "doc_id"), k=60)
    return search.fuse([lexical, dense])


_WITHIN = f"""WITH {_BM25}, {_COS}, r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY bm.score DESC, doc_id) AS r1, row_number() OVER (PARTITION BY source ORDER BY cs.score DESC, doc_id) AS r2 FROM bm JOIN cs ON cs.id = bm.doc_id WHERE lang = 'en'),
f AS (SELECT source, doc_id, round(1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2), 12) AS rrf FROM r)"""


def _within_source(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    bm = search.bm25(docs, TERMS).withColumnRenamed("score", "lexical")
    cs = _cosine(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("score").alias("dense"))
    allowed = docs.where("lang = 'en'").select("doc_id", "source", T.token_estimate(F.col("text")).alias("n_tokens"))
    rows = allowed.join(bm, "doc_id").join(cs, "doc_id")
    fused = search.fuse([search.ranked(rows, "lexical", by=["source"]), search.ranked(rows, "dense", by=["source"])], by=["source"])
    top = search.top_k(fused, ["source"], [F.desc("rrf"), F.asc("doc_id")], k)
    return top.join(allowed.select("doc_id", "n_tokens"), "doc_id")


@query(f"{_WITHIN} SELECT source, doc_id, rrf, row_number() OVER (PARTITION BY source ORDER BY rrf DESC, doc_id) AS rank FROM f QUALIFY rank <= 3")
def rrf_within_source(spark, sf_dir):
    return _within_source(spark, sf_dir, 3).select("source", "doc_id", "rrf", "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents of every source, lexical and vector search fused, numbered within a token budget."""
    best = _within_source(spark, sf_dir, 3)
    kept = retrieval.greedy_budget(best.withColumn("place", F.col("rank")), "source", "place", "n_tokens", 20_000).select(F.col("source").alias("of_source"), "place")
    rows = best.join(kept, (F.col("source") == F.col("of_source")) & (F.col("rank") == F.col("place"))).select("source", "doc_id", "rrf", "rank", "n_tokens")
    return rows.withColumn("cid", F.concat(F.lit("C"), F.col("rank")))


@query("SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5")
def topk_per_group(spark, sf_dir):
    return search.top_k(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 5)


@query(f"WITH {_BM25} SELECT doc_id, round(score * CASE lang WHEN 'en' THEN 1.5 WHEN 'de' THEN 1.2 ELSE 0.6 END, 8) AS weighted FROM bm")
def weighted_fusion(spark, sf_dir):
    rows = search.bm25(read(spark, sf_dir, "documents"), TERMS).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", F.round(F.col("score") * retrieval.weight({"en": 1.5, "de": 1.2, "*": 0.6}, F.col("lang")), 8).alias("weighted"))


# ---- filings -----------------------------------------------------------------------------

_FIL = "fil AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, o_orderpriority[1:1] = '1' AS annual FROM orders), anc AS (SELECT *, CASE WHEN day(day) <= 7 THEN (day - day(day)::INTEGER)::DATE ELSE day END AS anchor FROM fil)"
_FYE = f"WITH {_FIL}, fye AS (SELECT o_custkey, month(arg_max(anchor, (day, o_orderkey)))::BIGINT AS fye FROM anc WHERE annual GROUP BY o_custkey)"


@query(f"{_FYE} SELECT * FROM fye")
def fye_by_key(spark, sf_dir):
    return fiscal.year_end_month(filings(spark, sf_dir), "o_custkey", "day", annual(), "o_orderkey")


@query(f"""{_FYE}, x AS (SELECT o_orderkey, annual, year(anchor) + CASE WHEN month(anchor) > coalesce(fye, month(anchor)) THEN 1 ELSE 0 END AS y, ((month(anchor) - coalesce(fye, month(anchor)) + 12) % 12) // 3 AS q FROM anc LEFT JOIN fye USING (o_custkey))
SELECT o_orderkey, 'FY' || y || CASE WHEN annual THEN '' ELSE ' Q' || q END AS fiscal_label FROM x""")
def fiscal_anchor_labels(spark, sf_dir):
    f = filings(spark, sf_dir)
    return fiscal.labels(f, fiscal.year_end_month(f, "o_custkey", "day", annual(), "o_orderkey"), "o_custkey", "day", annual()).select("o_orderkey", "fiscal_label")


def _base_sql(agg: str, cmp: str) -> str:
    return f"WITH {_FIL} SELECT a.o_custkey, a.o_orderkey, a.day, {agg}(b.o_orderkey, (b.day, b.o_orderkey)) AS baseline_id, {agg}(b.day, (b.day, b.o_orderkey)) AS baseline_day FROM fil a LEFT JOIN fil b ON b.o_custkey = a.o_custkey AND b.annual AND b.day {cmp} a.day WHERE NOT a.annual GROUP BY ALL"


@query(_base_sql("arg_max", "<="))
def asof_baseline(spark, sf_dir):
    return fiscal.baseline(filings(spark, sf_dir), "o_custkey", "day", "o_orderkey", annual())


@query(_base_sql("arg_min", ">"))
def forward_baseline(spark, sf_dir):
    return fiscal.baseline(filings(spark, sf_dir), "o_custkey", "day", "o_orderkey", annual(), forward=True)


@query(f"WITH {_FIL} SELECT o_custkey, y AS year FROM (SELECT DISTINCT o_custkey FROM fil), unnest(range(1995, 2002)) AS u(y) WHERE (o_custkey, y) NOT IN (SELECT o_custkey, year(day) FROM fil)")
def missing_years(spark, sf_dir):
    return fiscal.missing_years(filings(spark, sf_dir), "o_custkey", "day", 1995, 2001)


@query(f"WITH {_FIL}, n AS (SELECT o_custkey, max(day) AS day FROM fil GROUP BY 1) SELECT o_custkey, day FROM n WHERE day < ((SELECT max(day) FROM n) - INTERVAL 36 MONTH)::DATE")
def stale_keys(spark, sf_dir):
    return fiscal.stale(filings(spark, sf_dir).groupBy("o_custkey").agg(F.max("day").alias("day")), "o_custkey", "day")


@query(f"WITH {_FIL}, e AS (SELECT o_custkey, max(year(day)) FILTER (annual) AS top, max(year(day)) AS newest FROM fil GROUP BY 1) SELECT o_custkey, y AS year FROM e, unnest(range(top - 2, newest + 1)) AS u(y) WHERE top IS NOT NULL")
def window_years(spark, sf_dir):
    return fiscal.window_years(filings(spark, sf_dir), "o_custkey", "day", annual(), 3)


@query(f"WITH {_FIL} SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS rank FROM fil QUALIFY rank <= 2")
def lead_chunks(spark, sf_dir):
    return search.top_k(filings(spark, sf_dir).select("o_custkey", "o_orderkey", "day"), ["o_custkey"], [F.asc("day"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank")


@query(f"WITH {_FIL}, y AS (SELECT DISTINCT o_custkey, year(day) AS y FROM fil) SELECT o_custkey, string_agg(y::VARCHAR, ', ' ORDER BY y) AS years FROM y GROUP BY o_custkey")
def coverage_listing(spark, sf_dir):
    years = filings(spark, sf_dir).select("o_custkey", F.year("day").alias("y")).distinct()
    return years.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("y")), lambda y: y.cast("string")), ", ").alias("years"))


@query("SELECT n_regionkey, count(*) AS n_quotas, greatest(6, least(24, 20000 // (count(*) * 400)))::BIGINT AS chunks FROM nation GROUP BY 1")
def quotas(spark, sf_dir):
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n_quotas")).select("n_regionkey", "n_quotas", retrieval.quota_chunks(20_000, F.col("n_quotas")).alias("chunks"))


# ---- events as marks ---------------------------------------------------------------------

_SECOND = "date_diff('second', TIMESTAMP '1970-01-01', ts)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))


@query(f"SELECT event_id, coalesce(lead({_SECOND}) OVER (PARTITION BY user_id ORDER BY {_SECOND}, event_id), {_SECOND} + 60)::BIGINT AS span_end FROM events")
def section_spans(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    return events(spark, sf_dir).select("event_id", F.coalesce(F.lead("at").over(w), F.col("at") + 60).alias("span_end"))


@query(f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inherited FROM events")
def unit_forward_fill(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return structure.fill_forward(rows, "user_id", "o", F.when(F.col("event_type") == "purchase", F.col("value"))).select("event_id", "inherited")


_NOTES = f"p AS (SELECT event_id, user_id, {_SECOND} AS sec FROM events), d AS (SELECT DISTINCT user_id, (sec // 86400) * 86400 AS s FROM p WHERE (sec // 86400) % 2 = 0)"


@query(f"WITH {_NOTES} SELECT event_id, p.user_id, sec AS \"at\", s AS note_start FROM p JOIN d ON p.user_id = d.user_id AND sec >= s AND sec < s + 43200")
def note_range_join(spark, sf_dir):
    points = events(spark, sf_dir).select("event_id", "user_id", "at")
    notes = points.select("user_id", F.floor(F.col("at") / 86400).alias("day")).where("day % 2 = 0").distinct().select("user_id", (F.col("day") * 86400).alias("note_start"), (F.col("day") * 86400 + 43200).alias("note_end"))
    return structure.containing(points, notes, "user_id", "at", "note_start", "note_end").select("event_id", "user_id", "at", "note_start")


@query(f"SELECT event_id, k AS kinds FROM (SELECT event_id, len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY {_SECOND} RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING)))::BIGINT AS k FROM events) WHERE k >= 2")
def toc_density(spark, sf_dir):
    return structure.density(events(spark, sf_dir), "user_id", F.col("at"), "event_type", 86400, 2).select("event_id", F.col("kinds").cast("long").alias("kinds"))


@query("WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, arg_max(l_linenumber, (c, l_linenumber))::BIGINT AS shape FROM c GROUP BY 1")
def mode_shape(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("c"))
    return c.groupBy("l_suppkey").agg(F.max(F.struct("c", "l_linenumber")).alias("x")).select("l_suppkey", F.col("x.l_linenumber").cast("long").alias("shape"))


@query("SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events WHERE value IS NOT NULL GROUP BY 1")
def upper_median(spark, sf_dir):
    return evals.upper_median(read(spark, sf_dir, "events").where("value is not null"), ["event_type"], "value")


@query("SELECT event_type, round(sum(round((event_id % 9000 * 5.0 + event_id % 700 * 25.0 + event_id % 50 * 5.0 * 1.25 + event_id % 90 * 5.0 * 0.10) / 1e6, 6)), 4) AS dollars FROM events GROUP BY 1")
def cost_rollup(spark, sf_dir):
    part = lambda m: F.col("event_id") % m
    c = evals.cost(part(9000), part(700), part(50), part(90), 5.0, 25.0)
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(c), 4).alias("dollars"))


# ---- planner -----------------------------------------------------------------------------


@query("""WITH w AS (SELECT conv_id, turn, i.item, max(i.w) AS weight FROM conversations, (VALUES ('the', '1A', 1.5), ('the', '7', 1.2), ('of', '7', 1.5), ('in', '8', 1.4)) AS i(word, item, w)
WHERE role = 'user' AND regexp_matches(lower(text), '\\b' || i.word || '\\b') GROUP BY ALL) SELECT conv_id, turn, item, weight::DOUBLE AS weight FROM w""")
def intent_weights(spark, sf_dir):
    asked = read(spark, sf_dir, "conversations").where("role = 'user'")
    return planner.intent_weights(asked, ["conv_id", "turn"], "text", [("the", {"1A": 1.5, "7": 1.2}), ("of", {"7": 1.5}), ("in", {"8": 1.4})])


@query("""SELECT conv_id, turn, m.ticker, min(strpos(' ' || regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' ', ' ' || m.alias || ' '))::BIGINT AS place FROM conversations, (VALUES ('the', 'AAA'), ('that', 'BBB'), ('thing', 'CCC'), ('this', 'AAA')) AS m(alias, ticker)
WHERE contains(' ' || regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' ', ' ' || m.alias || ' ') GROUP BY ALL""")
def entity_mentions(spark, sf_dir):
    return planner.mentions(read(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", {"the": "AAA", "that": "BBB", "thing": "CCC", "this": "AAA"})


@query("""WITH n AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS name FROM conversations) SELECT conv_id, turn, name FROM n WHERE lower(name) NOT IN ('the', 'that', 'thing', 'this')""")
def unresolved_names(spark, sf_dir):
    return planner.unresolved(read(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", ["the", "that", "thing", "this"])


# ---- evidence ----------------------------------------------------------------------------

_CANON = "lower(trim(regexp_replace(replace({0}, '|', ' '), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


@query(f"""WITH q AS (SELECT item_id, {_CANON.format('text')} AS q FROM benchmark), d AS (SELECT doc_id, {_CANON.format('text')} AS t FROM documents)
SELECT item_id AS quote_id, doc_id AS source_id, strpos(t, q)::BIGINT AS place FROM q JOIN d ON contains(t, q) WHERE length(q) >= 24 AND (strpos(t, q) = 1 OR t[strpos(t, q) - 1] = ' ')""")
def quote_locate_exact(spark, sf_dir):
    return checks.locate_exact(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


@query("SELECT conv_id, turn, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY lead(turn) OVER w = turn + 1")
def quote_next_chunk(spark, sf_dir):
    return checks.with_next(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text").where("next_text is not null").select("conv_id", "turn", "next_text")


@query("SELECT doc_id, regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?%?') AS figures FROM documents")
def figures_extract(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.figures(F.col("text")).alias("figures"))


_FIGS = "f AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice / l_quantity) AS BIGINT) AS figure, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT p_partkey, CAST(round(p_retailprice) AS BIGINT) AS figure FROM part)"


def _figure_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("figure")).groupBy("l_orderkey", "l_linenumber", "l_partkey", "figure").agg(F.count("*").alias("n"))
    sources = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.round("p_retailprice").cast("long").alias("figure"), F.col("p_partkey").alias("o"))
    return checks.first_match(rows, sources, "l_partkey", "figure", "figure", "o")


@query(f"WITH {_FIGS} SELECT l_orderkey, l_linenumber, l_partkey, f.figure, n, CASE WHEN s.p_partkey IS NULL THEN 'flagged' ELSE 'matched' END AS outcome FROM f LEFT JOIN s ON s.p_partkey = f.l_partkey AND s.figure = f.figure")
def figure_match(spark, sf_dir):
    return _figure_hits(spark, sf_dir).drop("place")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, (CAST(round(l_extendedprice / l_quantity) AS BIGINT) + 50) // 100 AS tenths FROM lineitem GROUP BY ALL),
d AS (SELECT *, (tenths // 10) || '.' || (tenths % 10) AS digits FROM f), g AS (SELECT *, greatest(1, length(ltrim(replace(digits, '.', ''), '0'))) AS sig FROM d),
s AS (SELECT p_partkey, CAST(round(p_retailprice) AS BIGINT) AS p FROM part WHERE p_retailprice >= 1), v AS (SELECT l_orderkey, l_linenumber, l_partkey, digits, digits::DOUBLE AS x, p / 1000 AS y, pow(10, floor(log10(p / 1000)) + 1 - sig) AS unit FROM g LEFT JOIN s ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, digits, CASE WHEN abs(round_even(y / unit, 0) * unit - x) < 0.0000005 THEN 'matched' ELSE 'flagged' END AS outcome FROM v""")
def figure_rescaled(spark, sf_dir):
    """Prices a unit, told in millions at a tenth, against part prices as printed in thousands."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("(cast(round(l_extendedprice / l_quantity) as bigint) + 50) div 100").alias("tenths")).distinct()
    rows = rows.withColumn("digits", F.expr("concat(tenths div 10, '.', tenths % 10)"))
    sig = F.greatest(F.lit(1), F.length(F.ltrim(F.replace("digits", F.lit(".")), F.lit("0"))))
    rows = rows.select("*", sig.alias("sig"), F.lit(False).alias("percent"), F.lit(False).alias("dollar"), F.lit("million").alias("scale"))
    printed = read(spark, sf_dir, "part").where("p_retailprice >= 1").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("place"), F.round("p_retailprice").cast("long").cast("string").alias("digits"), F.lit(False).alias("percent"), F.lit("thousand").alias("scale"))
    return checks.match_figures(rows, printed, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "digits", "outcome")


_PAIRS = "pairs AS (SELECT conv_id, turn, text, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY lead(turn) OVER w = turn + 1)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one that follows it: the excerpt and what is said of it."""
    return checks.with_next(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text").where("next_text is not null")


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, list_filter(string_split({_CANON.format('text')}, ' '), lambda x: x <> '') AS have, list_filter(string_split({_CANON.format('next_text')}, ' '), lambda x: x <> '') AS said FROM pairs WHERE next_text IS NOT NULL),
d AS (SELECT *, list_distinct(said) AS wanted FROM w WHERE len(said) >= 3), n AS (SELECT *, least(len(wanted), len(have)) AS width FROM d)
SELECT conv_id, turn, round(list_max(list_transform(range(0, len(have) - width + 1), lambda i: len(list_intersect(have[i + 1 : i + width], wanted)))) / len(wanted), 6) AS share FROM n""")
def quote_token_share(spark, sf_dir):
    said = _turns(spark, sf_dir).where(F.size(checks.tokens(F.col("next_text"))) >= checks.MIN_TOKENS)
    return said.select("conv_id", "turn", F.round(checks.token_share(F.col("next_text"), F.col("text")), 6).alias("share"))


@query(f"""WITH {_PAIRS}, n AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9]+') AS held, list_concat(list_filter(regexp_extract_all(next_text, '[0-9-]+'), lambda x: regexp_full_match(x, '(19|20)[0-9][0-9]')), list_filter(regexp_extract_all(next_text, '\\b[A-Z]{{2,5}}\\b'), lambda x: x IN ('AI', 'API', 'EU', 'UK', 'US'))) AS named FROM pairs WHERE next_text IS NOT NULL)
SELECT conv_id, turn, list_filter(named, lambda x: NOT list_contains(held, x)) AS named FROM n""")
def gap_grounding(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", checks.ungrounded(F.col("next_text"), F.col("text"), ["AI", "API", "EU", "UK", "US"]).alias("named"))


@query("SELECT conv_id, turn, array_to_string(list_slice(regexp_split_to_array(regexp_replace(trim(text, chr(32)), '', ''), '[ \\t\\n\\x0B\\f\\r]+'), 1, 12), ' ') AS quote, false AS replayed, NULL::VARCHAR AS error FROM conversations WHERE text IS NOT NULL")
def reply_parsing(spark, sf_dir):
    """Each turn as an excerpt: the canned reply about it, fenced, is parsed, and its claim's quote is what the excerpt begins with."""
    turns = read(spark, sf_dir, "conversations").where("text is not null").withColumn("question_key", T.question_key(F.col("text")))
    none = turns.select("question_key", F.col("text").alias("raw_text")).where("false")
    raw = replies.replayed(turns, none, "text").withColumn("raw_text", F.concat(F.lit("Here it is:\n```json\n"), "raw_text", F.lit("\n```")))
    return replies.answers(raw, "raw_text").select("conv_id", "turn", F.get("answer.claims", F.lit(0))["quote"].alias("quote"), "replayed", "error")


@query("SELECT o_orderkey, round(round(o_totalprice / 1000, 1) * 1000, 1) = round(o_totalprice, 1) AS exact, CAST(round(o_totalprice / 1000) AS BIGINT) AS thousands FROM orders")
def unit_rescale(spark, sf_dir):
    x = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.round(F.round(x / 1000, 1) * 1000, 1) == F.round(x, 1)).alias("exact"), F.round(x / 1000).cast("long").alias("thousands"))


@query("WITH k AS (SELECT l_orderkey, max(l_linenumber) AS width, count(*) AS cells FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN cells = width THEN 'matched' ELSE 'unchecked' END AS outcome FROM k")
def column_position(spark, sf_dir):
    k = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("width"), F.count("*").alias("cells"))
    return k.select("l_orderkey", F.when(F.col("cells") == F.col("width"), "matched").otherwise("unchecked").alias("outcome"))


@query("WITH x AS (SELECT l_returnflag, CASE WHEN l_discount > 0.08 THEN 'flagged' WHEN l_tax > 0.06 THEN 'unchecked' ELSE 'matched' END AS o FROM lineitem) SELECT l_returnflag, count_if(o = 'matched')::BIGINT AS matched, count_if(o <> 'unchecked')::BIGINT AS checkable, count_if(o = 'unchecked')::BIGINT AS unchecked FROM x GROUP BY 1")
def findings_rollup(spark, sf_dir):
    o = F.when(F.col("l_discount") > 0.08, "flagged").when(F.col("l_tax") > 0.06, "unchecked").otherwise("matched")
    return checks.rollup(read(spark, sf_dir, "lineitem").select("l_returnflag", o.alias("outcome")), ["l_returnflag"])


@query("SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND (conv_id, turn - 1) NOT IN (SELECT conv_id, turn FROM conversations WHERE role = 'user')")
def links_check(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    uses = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return checks.unlinked(uses, c.where("role = 'user'"), ["conv_id", "turn"]).select("conv_id", (F.col("turn") + 1).alias("turn"))


@query("SELECT o_orderkey, d AS claim, last_day(d) = d AS month_end, (d = date_trunc('month', d)::DATE + 25) OR (d = last_day(d)) AS agrees FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def period_agreement(spark, sf_dir):
    d = F.col("d")
    column_end = F.date_add(F.trunc(d, "MM"), 25)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).select("o_orderkey", d.alias("claim"), (F.last_day(d) == d).alias("month_end"), checks.period_agrees(column_end, d).alias("agrees"))


# ---- sets, reports, evaluation -----------------------------------------------------------


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha1(text) ORDER BY source, doc_id) = 1")
def near_dup_keep_first(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha1("text").alias("k"))
    best = rows.groupBy("k").agg(F.min(F.struct("source", "doc_id")).alias("x"))  # partial aggregation: a hot text is no hot task
    return best.select("x.doc_id", "x.source")


@query("""WITH a AS (SELECT doc_id, 0 AS priority, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50), b AS (SELECT doc_id, 1 AS priority, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents QUALIFY rank <= 80),
c AS (SELECT doc_id, 2 AS priority, doc_id + 1 AS rank FROM documents), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT doc_id, min((priority, rank))[1]::BIGINT AS priority, min((priority, rank))[2]::BIGINT AS rank FROM u GROUP BY 1""")
def priority_union(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    a = search.ranked(docs, "n_chars", k=50)
    b = search.ranked(docs.withColumn("n", -F.col("n_chars")), "n", k=80)
    c = docs.withColumn("rank", F.col("doc_id") + 1)
    return retrieval.priority_union([(0, a), (1, b), (2, c)], [], "doc_id")


@query("SELECT lang, count(*) AS n, count_if(quality = 1)::BIGINT AS good, count_if(toxic = 1)::BIGINT AS toxic, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def report_rates(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.avg("quality"), 6).alias("rate"))


@query("SELECT source, count_if(quality = 1 AND toxic = 0)::BIGINT AS hits, count_if(quality = 1)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def hit_rates(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    return evals.pairs(rows, ["source"], F.col("toxic") == 0, F.col("quality") == 1)


@query("""WITH r AS (SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)), f AS (SELECT source, min(rank) FILTER (quality = 0) AS rank FROM r GROUP BY 1)
SELECT 'all' AS set, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, count_if(rank IS NULL)::BIGINT AS never_found, count_if(rank = 1)::BIGINT AS first_place FROM f""")
def mrr(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    found = search.ranked(rows, "n_chars", by=["source"]).groupBy("source").agg(F.min(F.when(F.col("quality") == 0, F.col("rank"))).alias("rank"))
    return evals.reciprocal_rank(found.withColumn("set", F.lit("all")), ["set"])


@query("""WITH a AS (SELECT lang AS metric, round(avg(quality), 6) AS value FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY 1), b AS (SELECT lang AS metric, round(avg(quality), 6) AS value FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1)
SELECT coalesce(a.metric, b.metric) AS metric, a.value AS before, b.value AS after, round(b.value - a.value, 6) AS delta FROM a FULL JOIN b ON a.metric = b.metric""")
def metric_delta(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    part = lambda cond: rows.where(cond).groupBy(F.col("lang").alias("metric")).agg(F.round(F.avg("quality"), 6).alias("value"))
    return evals.deltas(part("toxic = 0"), part("toxic = 1"))


@query()
def token_budget_greedy(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", T.token_estimate(F.col("text")).alias("n"))
    best = search.top_k(rows, ["source"], [F.desc("n"), F.asc("doc_id")], 100)
    return retrieval.greedy_budget(best, "source", "doc_id", "n", 20_000)


@query()
def assemble_context(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("lang = 'en'")
    top = search.top_k(docs.select("doc_id", "source", "text", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 12)
    rows = top.select(F.lit("q").alias("question"), F.substring("source", 4, 9).cast("long").alias("quota"), F.col("source").alias("file"), F.col("doc_id").alias("chunk"), "rank", T.token_estimate(F.col("text")).alias("tokens"), T.window_shingles(F.col("text")).alias("shingles"))
    return retrieval.assemble(rows, budget=30_000)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
