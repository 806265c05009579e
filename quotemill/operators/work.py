"""Work tables: what several parts of a plan read is written once and read again."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _of_this_process() -> str:
    return tempfile.mkdtemp(prefix="spark-quotemill-")


def work_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it names none, a folder of this process, under a local master only: executors
    of a cluster wouldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _of_this_process()


def work_table(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: its plan runs once however often it is read, and lost executors read anew what is written."""
    path = f"{work_dir(df.sparkSession)}/quotemill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
