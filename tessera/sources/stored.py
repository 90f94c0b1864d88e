"""Tables written to the session's shared folder: lineage ends there and sizes become known."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow keys that may be broadcast (about 16 MB); above, a sort-merge join does the same.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under spark.checkpoint.dir; only a single machine without that setting gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"tessera-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """A stored narrow table with the join hint that its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")
