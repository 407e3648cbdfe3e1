"""A training-data pipeline over the document table, in five stages.

Every stage takes the documents its predecessor kept and returns them with the columns
of ``documents`` (the last returns packed sequences).  Stages are written as Parquet and
read again, so a lost executor never reaches back beyond one stage.

1. quality rules: documents that the rules reject go.
2. toxicity: documents called toxic go.
3. SimHash near-dedup: of every group of near-duplicates one document stays, the one with
   the smallest id (null ids last; of rows that repeat that id, the smallest SHA-1 of the
   text).  Candidates come from blocks of SimHash fingerprints and, for what these miss, from
   shared shingles; near-duplicates are linked by pairs whose sets of five-word shingles have a
   similarity of at least 0.8, taken exactly; rows that share an id but no text both stay.
4. secret scans: secrets are replaced in the text; all documents stay.
5. best-fit packing: documents become pieces of sequences of at most 2048 tokens.

Null texts are empty; rows with a null id are judged like any row.  An empty table goes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import packing, quality, secrets, simhash, toxicity
from folioscope.llm.common import scratch, table
from folioscope.llm.queries import TOKENIZERS, toxicity_chain


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity_chain(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=5, least=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs, secrets.train(secrets.example_findings()))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json", capacity=2048, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Toxicity models, shingle groups and tokens can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against slow versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        at = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
