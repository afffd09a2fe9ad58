"""Top row per key, top-k, and change against the previous row of a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import time_bucket


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order.

    Spark keeps one row per key and task before the shuffle (window group
    limit), so a key holding a large share of all rows sends only a few of them.
    End ``order`` with a unique column, otherwise ties are arbitrary.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key; equal times are settled by ``tiebreak``, then by the other columns in their order."""
    rest = [c for c in df.columns if c not in (*keys, time, *tiebreak)]
    return top_per_key(df, keys, [F.desc(time), *[F.asc(c) for c in (*tiebreak, *rest)]])


def newest_values(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of the newest row of each key, as a plain aggregate.

    Each task sends one row per key.  All columns come from the same row; of rows
    that share the newest time it is the greatest in the order of the columns, so
    the result does not depend on the order of the rows.
    """
    newest = F.max(F.struct(time, *columns)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in (time, *columns)])


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows; each task keeps k rows and only those are merged."""
    return df.orderBy(*order).limit(k)


def change_from_previous(df: DataFrame, keys: Sequence[str], time: str,
                         changes: Mapping[str, tuple[str, int]], steps: int = 1,
                         chunk_seconds: int | None = None) -> DataFrame:
    """Add ``out = value - value of the row ``steps`` earlier``; first rows get 0.

    ``changes`` maps the new column to (value column, digits).  A key should have
    one row per time, so combine copies first.  Gaps in time are ignored.  Without ``chunk_seconds`` all rows of a key are sorted in one
    task, which suits windowed features: a key has at most one row per window.
    With it, a key's history is cut into time chunks that are processed apart,
    and the last ``steps`` rows before a chunk are carried into it, so that a key
    holding a large part of all rows is spread over many tasks.  Rows and values
    are the same in both forms; rows without a time come first.
    """
    if chunk_seconds is None:
        by_key = Window.partitionBy(*keys).orderBy(time)
        previous = {out: F.lag(value, steps).over(by_key) for out, (value, _) in changes.items()}
        return _subtract(df, previous, changes)
    return _chunked_change(df, keys, time, changes, steps, chunk_seconds)


def _subtract(df, previous, changes):
    columns = {
        out: F.round(F.coalesce(F.col(value) - previous[out], F.lit(0.0)), digits)
        for out, (value, digits) in changes.items()
    }
    return df.withColumns(columns)


def _chunked_change(df, keys, time, changes, steps, chunk_seconds):
    part = [*keys, "_chunk"]
    values = sorted({value for value, _ in changes.values()})
    chunked = df.withColumn("_chunk", time_bucket(F.col(time), chunk_seconds))

    # The last rows of every chunk; of those, the ones directly before a chunk are
    # repeated in it, where they only serve as previous rows.
    newest_first = Window.partitionBy(*part).orderBy(F.desc(time))
    tails = chunked.select(*part, time, *values, F.row_number().over(newest_first).alias("_back")).where(
        F.col("_back") <= steps)
    in_order = Window.partitionBy(*keys).orderBy("_chunk", F.desc("_back"))
    first = F.coalesce(~F.lag("_chunk").over(in_order).eqNullSafe(F.col("_chunk")), F.lit(True)) | (
        F.row_number().over(in_order) == 1)
    next_chunks = F.collect_list(F.when(F.col("_first"), F.struct("_chunk"))).over(in_order.rowsBetween(1, steps))
    carried = tails.withColumn("_first", first).withColumn("_next", next_chunks).withColumn("_next", F.explode("_next")).withColumn(
        "_chunk", F.col("_next._chunk")).drop("_next", "_first", "_back")

    rows = chunked.withColumn("_carried", F.lit(False)).unionByName(
        carried.withColumn("_carried", F.lit(True)), allowMissingColumns=True)
    inside = Window.partitionBy(*part).orderBy(time)
    previous = {out: F.lag(value, steps).over(inside) for out, (value, _) in changes.items()}
    return _subtract(rows, previous, changes).where(~F.col("_carried")).drop("_chunk", "_carried")
