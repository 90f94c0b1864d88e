"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Where the installed public vocabulary file `name` lies; every machine resolves its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under the session's spark.checkpoint.dir.

    Only where that setting is missing on a single machine (tests, a laptop) a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"tessera-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends, sizes become known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_text(docs: DataFrame, text_col: str = "text"):
    """The text column with null as the empty string."""
    return F.coalesce(docs[text_col], F.lit(""))


#: Bytes of an Arrow batch. Spark's own limits, 10,000 rows or 64 MB, are held several times over for each running task:
#: in Spark's buffers outside the heap, as an Arrow batch and as Python strings, and so for what comes back.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hands texts to Python tasks in batches of about BATCH_BYTES, unless the session has a limit of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":
        spark.conf.set(name, f"{BATCH_BYTES}b")


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of narrow keys that may be broadcast (about 16 MB); above, a sort-merge join does the same.
BROADCAST_ROWS = 400_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored narrow table with the join hint that its counted size allows."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def columns_of(docs: DataFrame, *names: str) -> str:
    """The schema string of some columns."""
    return ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with the table's own."""
    have = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def integer_vectors(table: DataFrame, scale: int, vector_col: str, *keys: str, dims: int | None = None) -> DataFrame:
    """(keys, v): the vectors whose components are all finite, each component x as the integer floor(scale * x).

    Null vectors, vectors of other than `dims` components and those with a null, infinite or NaN component are left
    out; so are those with an integer beyond +-2^26, whose squared distances need not fit a long.
    """
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**26 / scale))
    found = table.filter(v.isNotNull() & whole & (F.size(v) == dims if dims is not None else F.lit(True)))
    return found.select(*keys, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("int")).alias("v"))


def rows_of(column, width: int):
    """An Arrow column of lists of `width` integers as an (n, width) array of int64."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
