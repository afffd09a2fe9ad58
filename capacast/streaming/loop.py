"""Closed loop from landed windows to provisioned slices, at a cost of what is new.

The progress table has one row for each site: the end of the newest window that the loop has taken in, and the newest
flagged window with its trend.  A step reads only windows that end after what has been taken in, merges them into the
progress, provisions, and then makes the new progress the current one.  A step that breaks off leaves the old progress in
place, so the next step reads the same windows again, and the guard on slice ids keeps it from adding a slice twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import latest_per_key
from ..operators.rows import conform
from ..plans import campaign, layers
from ..session import materialise
from ..sources import schemas, tables


def unread(windows: DataFrame, progress: DataFrame) -> DataFrame:
    """Windows that end after all that the progress has taken in.

    Windows are landed when the watermark passes their end, so none lands later with an earlier end.  The bound is one value
    and is put into the scan as a literal; with it goes the day, by which windows may be laid out.
    """
    floor = progress.agg(F.max("taken_until")).first()[0]
    if floor is None:
        return windows
    fresh = windows.where(F.col("window_end") > F.lit(floor))
    return fresh.where(F.col("day") >= F.date_sub(F.lit(floor.date()), 1)) if "day" in windows.columns else fresh


def advanced(progress: DataFrame, fresh: DataFrame, score_cut: float = layers.FLAGGED_SCORE) -> DataFrame:
    """The progress with new windows (that carry their trends) taken in."""
    taken = fresh.groupBy("tower_id").agg(F.max("window_end").alias("taken_until"))
    until = progress.select("tower_id", "taken_until").union(taken).groupBy("tower_id").agg(
        F.max("taken_until").alias("taken_until"))
    bare = fresh.drop("day")
    flagged = layers.latest_flagged_window(
        layers.with_flags(bare, bare.select("tower_id").limit(0)), score_cut).select("tower_id", "window_start")
    newest = bare.join(flagged, ["tower_id", "window_start"], "left_semi")
    before = progress.where("window_start is not null").select(*bare.columns)
    current = latest_per_key(before.union(newest), ["tower_id"], "window_start")
    return until.join(current, "tower_id", "left")


def step(windows: DataFrame, folder: str, near_sites: DataFrame, accounts: DataFrame, slices: DataFrame, slices_path: str,
         as_of: Column, score_cut: float = layers.FLAGGED_SCORE) -> DataFrame:
    """One turn of the loop; returns the opportunities, after slices for the targets among them were appended.

    ``windows`` are landed windows with trends, ``folder`` holds the versions of the progress, ``slices`` are the slices that
    accounts have now, and new ones go to ``slices_path``.
    """
    spark = windows.sparkSession
    kinds = windows.drop("day").schema
    schema = type(kinds)([kinds["tower_id"], type(kinds["tower_id"])("taken_until", kinds["window_end"].dataType),
                          *[f for f in kinds.fields if f.name != "tower_id"]])
    progress = tables.current_version(spark, folder, schema)
    moved = materialise(advanced(progress, unread(windows, progress), score_cut).select(*schema.fieldNames()), "progress")
    flagged = layers.with_flags(moved.where("window_start is not null").drop("taken_until"), near_sites)
    found = materialise(layers.account_opportunities(accounts, slices, flagged, as_of, score_cut), "opportunities")
    bursts = campaign.burst_slices(campaign.select_targets(found), as_of)
    tables.append_new(conform(bursts, slices.schema), slices_path, ["slice_id"])
    tables.add_version(moved, folder)
    return found
