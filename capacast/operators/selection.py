"""Exact, repeatable choice of rows per group, without sorting a group in one task.

Each row gets a position from the MD5 of its key.  A histogram of the first hex
digits (a fixed number of buckets) tells how many chosen rows each bucket holds,
so rows are ranked only within a bucket, and buckets fill evenly however the
groups are distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_null_safe

HEX_DIGITS = 4
BUCKETS = 16 ** HEX_DIGITS


def _positioned(df: DataFrame, keys: Sequence[str], salt: str) -> DataFrame:
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(salt))
    return df.withColumn("_hash", F.md5(text)).withColumn(
        "_bucket", F.conv(F.substring("_hash", 1, HEX_DIGITS), 16, 10).cast("int"))


def mark_lowest(df: DataFrame, group: Sequence[str], keys: Sequence[str], quota: Column,
                out: str = "chosen", salt: str = "") -> DataFrame:
    """Add ``out``: true for the ``quota`` rows of each group with the lowest hash.

    ``quota`` is a column expression over ``_n``, the size of the group.
    ``keys`` must identify a row.
    """
    rows = _positioned(df, keys, salt)
    group = list(group)
    histogram = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
    # At most BUCKETS rows per group from here on, whatever the data size.
    running = Window.partitionBy(*group).orderBy("_bucket")
    whole = Window.partitionBy(*group)
    counted = (
        histogram
        .withColumn("_upto", F.sum("_in_bucket").over(running))
        .withColumn("_n", F.sum("_in_bucket").over(whole))
        .withColumn("_quota", quota)
        .withColumn("_left", F.col("_quota") - (F.col("_upto") - F.col("_in_bucket")))
        .select(*group, "_bucket", "_left")
    )
    ranked = Window.partitionBy(*group, "_bucket").orderBy("_hash", *keys)
    return (
        join_null_safe(rows, counted, [*group, "_bucket"])
        .withColumn(out, F.row_number().over(ranked) <= F.col("_left"))
        .drop("_hash", "_bucket", "_left")
    )


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(share * n)`` rows of each label."""
    quota = F.ceil(F.col("_n") * F.lit(test_share))
    return mark_lowest(df, [label], keys, quota, "is_test", f"split{seed}")


def oversample(df: DataFrame, label: str, keys: Sequence[str], factor: int = 5, seed: int = 42) -> DataFrame:
    """Repeat positive rows until there are ``min(negatives, factor * positives)`` of them.

    Each positive row is repeated equally often; the remainder goes to the rows
    with the lowest hash.  ``copy`` numbers the repeats.  When a class is
    missing, the rows are returned as they are.
    """
    counts = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    wanted = F.when(F.col("neg") == 0, F.col("pos")).otherwise(F.least("neg", F.col("pos") * factor))
    # One row; its values enter the plan as scalar subqueries.
    share = counts.select(F.try_divide(wanted, "pos").cast("bigint")).scalar()
    extra = counts.select(wanted - F.try_divide(wanted, "pos").cast("bigint") * F.col("pos")).scalar()

    positives = mark_lowest(df.where(F.col(label) == 1), [label], keys, extra, "_extra", f"over{seed}")
    repeated = (
        positives.withColumn("_times", share + F.col("_extra").cast("bigint"))
        .where("_times > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
        .drop("_times", "_extra")
    )
    others = df.where(~F.col(label).eqNullSafe(1)).withColumn("copy", F.lit(1))
    return others.unionByName(repeated)
