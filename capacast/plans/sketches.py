"""Distinct counts over any range of days, from one small sketch a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

# 2**14 registers: a standard error of about 0.8 %, and at most 16 KB a sketch.
PRECISION = 14


def daily_sketches(df: DataFrame, column: str, time: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    """(by, day, sketch): the distinct values of each day, mergeable.  Rows without time or value count for nothing.

    Sketches are built in each task before the shuffle, so a day with a third of all rows sends one for each task.
    """
    return df.dropna(subset=[column, time]).groupBy(*by, F.to_date(time).alias("day")).agg(
        F.hll_sketch_agg(column, F.lit(PRECISION)).alias("sketch"))


def store(sketches: DataFrame, path: str) -> None:
    """Put the sketches in the place of those of their days; other days stay as they are."""
    tables.replace_days(sketches.hint("rebalance", "day"), path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def distinct_between(sketches: DataFrame, first: str, last: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of distinct values from one day to another, both included; reads the sketches of these days only."""
    days = sketches.where(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    return days.groupBy(*by).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias(out))


def rolling_distinct(sketches: DataFrame, days: int, out: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, day, count) for every day that has a sketch: distinct values of the ``days`` days that end with it."""
    return _over_days(sketches, days, by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(out))


def rolling_distinct_exact(df: DataFrame, column: str, days: int, out: str, time: str = "timestamp",
                           by: Sequence[str] = ()) -> DataFrame:
    """``rolling_distinct`` without sketches, from the distinct values of each day."""
    daily = df.dropna(subset=[column, time]).select(*by, column, F.to_date(time).alias("day")).distinct()
    return _over_days(daily, days, by).agg(F.count_distinct(column).alias(out))


def _over_days(daily: DataFrame, days: int, by: Sequence[str]):
    """Rows of a day under each day whose range holds it, grouped; only days that have rows are asked for."""
    spread = daily.withColumn("_own", F.col("day")).withColumn(
        "day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda n: F.date_add("_own", n))))
    asked = daily.select(*by, "day").distinct()
    keys = [*by, "day"]
    renamed = asked.withColumnsRenamed({k: f"_asked_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_asked_{k}"))
    return spread.join(renamed, same, "left_semi").groupBy(*keys)
