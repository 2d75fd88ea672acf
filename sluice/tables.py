"""Tables that end a lineage: written once to the folder that all executors share."""

from __future__ import annotations

import getpass
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file:///tmp/checkpoints/sluice-{getpass.getuser()}"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again, so that ids made in it stay as they are and a lost executor repeats no more."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
