"""The queries opN_<name> of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import html_extract, packing, pii, quality, secrets, sentencepiece_lattice, simhash, topk, toxicity, warc
from folioscope.llm.common import scratch, table

#: Folder of the public tokenizers' files; a parameter of every operator that needs one.
TOKENIZERS = "/opt/tokenizers"


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


#: Label columns of the chain, in order; low quality is 1 - quality.
CATEGORIES = ("low_quality", "toxic")


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.Chain:
    return toxicity.train(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), CATEGORIES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity_chain(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", *(F.col("probabilities")[i].alias(f"p_{c}") for i, c in enumerate(CATEGORIES)), toxicity.is_positive(chain, "toxic").alias("toxic"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(k, F.col("base")).alias(f"n_{k}") for k in pii.KINDS]
    written = pii.written(F.col("spans")).alias("spans")
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), written, pii.count_of("id", F.col("spans")).alias("n_id"), F.size("spans").cast("long").alias("n_spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.example_findings())
    found = secrets.scan(table(spark, sf_dir, "documents"), forest)
    return found.select("doc_id", "start", "end", "score", F.sha2("secret", 256).alias("secret_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"), scratch(spark, "warc"), spark, min_bytes=0)
    return records.select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", capacity=2048, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_toxicity": op2_toxicity,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_pii": op4_pii,
        "op5_secret_scan": op5_secret_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_html_extraction": op7_html_extraction,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_warc": op9_warc,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL}
