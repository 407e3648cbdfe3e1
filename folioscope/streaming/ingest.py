"""Incremental ingestion: new documents are parsed and chunked as their files arrive.

Every micro-batch replaces the chunks of the files it holds, so a batch that runs again
after a failure leaves the same store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.sources import filings


def stream_folder(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (file, raw) of the text files of a folder."""
    whole = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_batch).load(path)
    return whole.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("raw"))


def ingest(stream: DataFrame, store: str, state: str, once: bool = True) -> StreamingQuery:
    """Writes chunks under ``store``, one folder a batch; :func:`latest` reads the newest version of every file."""
    def put(batch: DataFrame, number: int) -> None:
        filings.chunk(filings.parse(batch)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{store}/batch={number:09d}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, store: str) -> DataFrame:
    """Chunks of the newest batch of every file."""
    rows = spark.read.parquet(store)
    newest = rows.groupBy(F.col("file").alias("of_file")).agg(F.max("batch").alias("of_batch"))
    return rows.join(newest, (F.col("file") == F.col("of_file")) & (F.col("batch") == F.col("of_batch"))).drop("of_file", "of_batch")
