"""Writers that check what they write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predictions(df: DataFrame, path: str, rows: int | None = None, expected: dict[str, float] | None = None, tolerance: float = 0.005, method_col: str = "method", value_col: str = "value", truth_col: str = "truth") -> DataFrame:
    """Write allocations as Parquet by method and return their provenance: (method, rows, mean, least, most, expected, metric).

    An error before anything is written: a wrong row count, a value that is null or not finite, a method whose root
    mean square error against truth_col differs from the expected one by more than the tolerance, or an expected
    method that is not there.
    """
    bad = F.col(value_col).isNull() | F.isnan(value_col) | (F.abs(value_col) == float("inf"))
    state = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).first()
    if state["bad"] or rows is not None and state["n"] != rows:
        raise ValueError(f"{state['n']} rows, {state['bad']} without a finite value")
    metric = {}
    if expected:
        error = F.sqrt(F.avg((F.col(value_col) - F.col(truth_col)) ** 2))
        metric = {r[0]: r[1] for r in df.groupBy(method_col).agg(error.alias("e")).collect()}  # a row for each method
        off = {m: (metric.get(m), e) for m, e in expected.items() if metric.get(m) is None or abs(metric[m] - e) > tolerance}
        if off:
            raise ValueError(f"metrics and expected values differ by more than {tolerance}: {off}")
    df.write.mode("overwrite").partitionBy(method_col).parquet(path)
    found = df.sparkSession.read.parquet(path).groupBy(method_col).agg(F.count(F.lit(1)).alias("rows"), F.avg(value_col).alias("mean"), F.min(value_col).alias("least"), F.max(value_col).alias("most"))
    of = lambda known: F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[F.col(method_col)] if known else F.lit(None).cast("double")
    return found.withColumns({"expected": of(expected or {}), "metric": of(metric)})


def append_new(trials: DataFrame, path: str, keys: list[str]) -> None:
    """Append the trials whose keys the Parquet ledger at path does not hold yet."""
    spark = trials.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        trials = trials.join(spark.read.parquet(path).select(*keys).distinct().hint("merge"), keys, "left_anti")
    trials.dropDuplicates(keys).write.mode("append").parquet(path)


def results(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table as CSV with a header under path, and their row counts and means as one JSON table.

    Returns (name, rows, columns), counted from what was written.
    """
    out = None
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        back = df.sparkSession.read.option("header", True).schema(df.schema).csv(f"{path}/{name}")
        part = back.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = part if out is None else out.unionByName(part)
    out.write.mode("overwrite").json(f"{path}/summary.json")
    return out.sparkSession.read.schema(out.schema).json(f"{path}/summary.json")
