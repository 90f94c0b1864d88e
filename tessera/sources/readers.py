"""Typed readers: explicit schemas, keys as strings, sentinels as nulls, optional columns as typed nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINEL = -999.0


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each missing column as a null of its type."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c.lower() not in have})


def cleaned(df: DataFrame) -> DataFrame:
    """The sentinel and NaN become null in every double column."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(F.isnan(c) | (F.col(c) == SENTINEL), None).otherwise(F.col(c)) for c in doubles})


def area_attributes(spark: SparkSession, path: str, schema: str, county: str | None = None, county_col: str = "COUNTY") -> DataFrame:
    """A delimited attribute table; keys keep their leading zeros. A county that selects nothing is an error."""
    df = cleaned(spark.read.csv(path, header=True, schema=schema))
    if county is None:
        return df
    df = df.filter(F.lower(F.trim(county_col)) == county.strip().lower())
    if df.isEmpty():
        raise ValueError(f"no rows for county {county}")
    return df


def external_target(spark: SparkSession, path: str, points: DataFrame, key: str = "address_id", value: str = "target_value") -> DataFrame:
    """Points with the first value that the (possibly compressed) file holds for each; none at all is an error."""
    rows = spark.read.csv(path, header=True, schema=f"{key} string, {value} double").withColumn("_n", F.monotonically_increasing_id())
    first = rows.groupBy(F.col(key).cast(points.schema[key].dataType).alias(key)).agg(F.min_by(value, "_n").alias(value))
    out = points.join(first.hint("merge"), key, "left")
    if out.filter(F.col(value).isNotNull()).isEmpty():
        raise ValueError("no target matches a point")
    return out


def access_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log with nested metadata."""
    return spark.read.schema("timestamp timestamp, operation string, cache_type string, key string, hit boolean, metadata map<string,string>").json(path)


def ledger(spark: SparkSession, path: str, first_year: int, last_year: int) -> DataFrame:
    """(parcel, years): distinct bill years in a range for each composite key."""
    rows = spark.read.csv(path, header=True, schema="Map string, `Group` string, Parcel string, `Bill Year` string")
    part = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    year = F.expr("try_cast(`Bill Year` AS int)")
    return rows.withColumn("year", year).filter(F.col("year").between(first_year, last_year)).groupBy(F.concat_ws("|", part("Map"), part("Group"), part("Parcel")).alias("parcel")).agg(F.countDistinct("year").alias("years"))
