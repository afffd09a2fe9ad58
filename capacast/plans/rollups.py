"""Replay steps from rollups of several widths, with raw readings for the seconds at the edges only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import WIDE, odd
from ..sources import tables
from .serving import REPLAY_FLAG, STEPS, replay_columns

WIDTHS = (60, 3600, 86400)
MEANS = ("bandwidth_utilization_pct", "latency_ms")
PEAKS = ("active_connections",)


def _states(second: Column) -> dict[str, Column]:
    """What a single reading adds to a rollup."""
    found = {"first_second": second, "last_second": second}
    for c in MEANS:
        value = F.col(c)
        found[f"{c}_sum"] = F.when(~odd(value), value).cast(WIDE)
        found[f"{c}_odd"] = F.when(odd(value), value.cast("double"))
        found[f"{c}_count"] = F.when(value.isNotNull(), 1).otherwise(0).cast("bigint")
    return found | {f"{c}_peak": F.col(c) for c in PEAKS}


def _merged(columns: Sequence[str]) -> list[Column]:
    """How the states of several rows make one; the same for readings and for rollups."""
    how = {"first_second": F.min, "last_second": F.max}
    return [how.get(c, F.max if c.endswith("_peak") else F.sum)(c).alias(c) for c in columns]


def _slots(states: DataFrame, width: int) -> DataFrame:
    columns = [c for c in states.columns if c not in ("tower_id", "slot", "day")]
    slot = F.floor(F.col("first_second") / width).cast("bigint")
    return states.groupBy("tower_id", slot.alias("slot")).agg(*_merged(columns))


def write_rollups(telemetry: DataFrame, folder: str) -> None:
    """Raw readings by day, and a table for each width that is derived from the next finer one.

    Whole days go in and take the place of what the days had.  Sums are kept as decimals and merge without a change of
    result; NaN and infinity are kept beside them.  Readings without a time take no part.
    """
    spark = telemetry.sparkSession
    timed = telemetry.where("timestamp is not null").select("tower_id", "timestamp", *MEANS, *PEAKS)
    tables.write_history(timed, f"{folder}/raw", "timestamp", ["tower_id"], replace_days=True)
    days = timed.select(F.to_date("timestamp").alias("day")).distinct()
    finer = timed.select("tower_id", *[c.alias(n) for n, c in _states(F.unix_timestamp("timestamp")).items()])
    for width in WIDTHS:
        slots = _slots(finer, width).withColumn("day", F.to_date(F.timestamp_seconds(F.col("slot") * width)))
        path = f"{folder}/width={width}"
        tables.replace_days(slots.hint("rebalance", "day").sortWithinPartitions("day", "slot"), path)
        finer = spark.read.schema(slots.schema).parquet(path).join(days, "day", "left_semi")


def pieces(low: int, high: int) -> list[tuple[int, int, int]]:
    """(width, from, to) that make up [low, high): the widest slots that fit, finer ones at both ends, and width 0
    for the seconds that must come from raw readings (less than a minute at each end)."""
    found = []
    inner: list[tuple[int, int]] = [(low, high)]
    for width in reversed(WIDTHS):
        rest = []
        for a, b in inner:
            first, last = -(-a // width) * width, b // width * width
            if first < last:
                found.append((width, first, last))
                rest += [(a, first), (last, b)]
            else:
                rest.append((a, b))
        inner = [(a, b) for a, b in rest if a < b]
    return found + [(0, a, b) for a, b in inner]


def _within(df: DataFrame, low: int, high: int, slot: Column) -> DataFrame:
    """Rows of slots in the range; the days go into the partition filter of the scan."""
    day = [F.to_date(F.timestamp_seconds(F.lit(s))) for s in (low, high - 1)]
    return df.where(F.col("day").between(*day) & (slot >= low) & (slot < high))


def replay_step(spark: SparkSession, folder: str, step: int, steps: int = STEPS, flag_above: float = REPLAY_FLAG,
                prefix: str | None = None) -> DataFrame:
    """One step of ``serving.time_steps``, at the cost of the step's slots instead of its readings.

    The covered time comes from the rollup of the greatest width.  A step outside 0 to ``steps`` - 1, or an empty
    table, gives no rows.
    """
    widest = spark.read.parquet(f"{folder}/width={WIDTHS[-1]}")
    low, high = widest.agg(F.min("first_second"), F.max("last_second")).first()
    ranges = []
    if low is not None and 0 <= step < steps:
        length = (high - low) / steps
        ranges = pieces(math.floor(low + step * length), math.floor(low + (step + 1) * length))
    parts = []
    for width, a, b in ranges:
        if width:
            rows = _within(spark.read.parquet(f"{folder}/width={width}"), a, b, F.col("slot") * width)
            parts.append(rows.drop("slot", "day"))
        else:
            raw = spark.read.parquet(f"{folder}/raw")
            kind = raw.schema["timestamp"].dataType
            edges = [F.timestamp_seconds(F.lit(s)).cast(kind) for s in (a, b)]
            day = [F.to_date(e) for e in (edges[0], F.timestamp_seconds(F.lit(b - 1)).cast(kind))]
            rows = raw.where(F.col("day").between(*day) & (F.col("timestamp") >= edges[0]) & (F.col("timestamp") < edges[1]))
            parts.append(rows.select("tower_id", *[
                c.alias(n) for n, c in _states(F.unix_timestamp("timestamp")).items()]))
    joined = reduce(DataFrame.unionByName, parts) if parts else widest.drop("slot", "day").limit(0)
    shown = joined if prefix is None else joined.where(F.col("tower_id").startswith(prefix))
    columns = [c for c in shown.columns if c != "tower_id"]
    merged = shown.groupBy("tower_id").agg(*_merged(columns))

    def mean(c: str) -> Column:
        total = F.coalesce(F.col(f"{c}_odd"), F.col(f"{c}_sum").cast("double"))
        return F.try_divide(total, F.col(f"{c}_count")).alias(c)

    return replay_columns(merged.select(
        F.lit(step).cast("bigint").alias("step"), "tower_id", mean(MEANS[0]),
        *[F.col(f"{c}_peak").alias(c) for c in PEAKS], mean(MEANS[1])), flag_above)
