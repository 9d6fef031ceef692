"""Tables that a job writes for itself in the shared folder and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode without it a temporary folder, elsewhere an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="memspark-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, however often it is used, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/memspark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
