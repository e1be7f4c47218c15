"""Quantiles from a sketch that is stored, merged and read: counts in buckets whose width grows with the value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A quantile read from a sketch is off by at most this share of itself.
ERROR = 0.01


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """Number of the bucket (gamma^(i-1), gamma^i] that a positive value lies in; null for what is not above 0, which
    the sketch counts as 0."""
    return F.when(value > 0, F.ceil(F.log(value.cast("double")) / F.lit(math.log(_gamma(error)))).cast("int"))


def sketched(rows: DataFrame, by: list[str], value: str, error: float = ERROR) -> DataFrame:
    """by, bucket, n: a sketch per group as rows. Groups are summed before the shuffle, and a group has about as many
    rows as its values span steps of two ``error``, however many values there are. Null and NaN values do not count."""
    v = F.col(f"`{value}`").cast("double")
    return rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, bucket(v, error).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of coarser groups, or of several sketches together: counts add up, and no error is added."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").cast("long").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], shares: dict[str, float], error: float = ERROR) -> DataFrame:
    """by, n and a column per share: the value whose rank is floor(1 + share (n - 1)), within ``error`` of itself.
    The window runs over the buckets of a group, of which there are few."""
    run = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    g = _gamma(error)
    d = sketches.withColumns({"_run": F.sum("n").over(run), "_n": F.sum("n").over(whole)})
    d = d.withColumn("_value", F.coalesce(F.lit(2.0) * F.pow(F.lit(g), F.col("bucket")) / F.lit(g + 1), F.lit(0.0)))
    rank = lambda q: F.floor(F.lit(1.0) + F.lit(float(q)) * (F.col("_n") - 1))
    return d.groupBy(*by).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_run") >= rank(q), F.col("_value"))).alias(name) for name, q in shares.items()])
