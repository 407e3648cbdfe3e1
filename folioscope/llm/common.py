"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    A folder of our own is made only where the setting is missing, which is the
    case in local tests.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", at)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(at)
    return at if "://" in at else ("file://" + at if at.startswith("/") else at)


#: Spark's setting that removes an execution's shuffle files when it has ended.
_SPENT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is planned and written out within leaves no shuffle files: its rows are read from the copy from then on."""
    before = spark.conf.get(_SPENT, "false")
    spark.conf.set(_SPENT, "true")
    try:
        yield
    finally:
        spark.conf.set(_SPENT, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, which takes up the setting


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spilled(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like :func:`checkpoint`, as compressed Parquet, smaller where rows are wide; and its folder, for :func:`remove`."""
    at = scratch(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """:func:`spilled` for what is read to the end."""
    return spilled(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own below the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
