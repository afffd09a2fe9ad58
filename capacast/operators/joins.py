"""Joins that stay equality joins on well spread keys.

None of them broadcasts by hint: adaptive execution turns a shuffle join into a
broadcast join only after it has measured the side, and keeps the shuffle join
otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import materialise
from .ranking import top_per_key
from .rows import require_not_null
from .running import running

SALTS = 16


def join_unique(left: DataFrame, right: DataFrame, key: str, salt_by: Sequence[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join many left rows to a right side that has one row per key.

    Left rows of one key are spread over ``salts`` sub-keys by a hash of
    ``salt_by``, and the right row is repeated once per sub-key, so a key that
    holds a third of the left rows does not end up in one task.
    """
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def flag_keys(df: DataFrame, keys: DataFrame, key: str, out: str,
              salt_by: Sequence[str] = (), salts: int = SALTS) -> DataFrame:
    """1 for rows whose key occurs in ``keys``, else 0; never repeats a row.

    Name ``salt_by`` columns when a single key may hold a large share of ``df``.
    Without them the join can reuse a partitioning by the key that ``df`` has.
    """
    marked = keys.select(key).distinct().withColumn("_hit", F.lit(1))
    flagged = join_unique(df, marked, key, salt_by, "left", salts) if salt_by else df.join(marked, key, "left")
    return flagged.withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_hit")


def merged_spans(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, _a, _b) of whole slots, both ends included, united where they overlap or touch.

    A span opens a new stretch if it begins behind all that began before it; a stretch's number is a running count.
    """
    seen = running(spans.distinct(), [key], ["_a", "_b"], {"_reach": ("max", "_b")}, inclusive=False)
    opens = F.coalesce(F.col("_a") > F.col("_reach") + 1, F.lit(True)).cast("bigint")
    counted = running(seen.withColumn("opens", opens), [key], ["_a", "_b"], {"stretch": ("sum", "opens")})
    return counted.groupBy(key, "stretch").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).drop("stretch")


def dyadic_blocks(spans: DataFrame, key: str) -> DataFrame:
    """(key, _level, _block): spans of slots as blocks of 2**level slots that begin at multiples of their length.

    A level gives the blocks that lie within the span but not within a longer one that does: at most one at each end, so a
    span of n slots has no more than 2 log2(n) + 2 of them.
    """
    levels = spans.withColumn("_level", F.explode(F.expr("sequence(0, length(bin(_b - _a + 1)))")))
    inside = levels.withColumns({
        "_low": F.expr("-shiftright(-_a, _level)"), "_high": F.expr("shiftright(_b + 1, _level) - 1")}).where("_low <= _high")
    ends = F.array(F.when(F.pmod("_low", F.lit(2)) == 1, F.col("_low")), F.when(F.pmod("_high", F.lit(2)) == 0, F.col("_high")))
    return inside.select(key, "_level", F.explode(F.array_compact(ends)).alias("_block")).distinct()


def flag_windows_inside(df: DataFrame, spans: DataFrame, key: str, window_seconds: int, out: str,
                        start: str = "event_start_time", end: str = "event_end_time",
                        window_start: str = "window_start") -> DataFrame:
    """1 for windows of a key that lie inside one of the key's time spans, else 0.

    Windows start at multiples of their length.  Spans are united and cut into dyadic blocks of windows, and a window looks
    up the blocks that could hold it, one for each length in use, so the test is an equality join at a cost that grows with
    the logarithm of a span's length.  Only keys that have spans are looked up.
    """
    length = F.lit(window_seconds)
    first = F.ceil(F.unix_micros(F.col(start).cast("timestamp")) / F.lit(1e6) / length).cast("bigint")
    last = F.floor(F.unix_micros(F.col(end).cast("timestamp")) / F.lit(1e6) / length).cast("bigint") - 1
    whole = spans.select(key, first.alias("_a"), last.alias("_b")).where(f"_a <= _b and `{key}` is not null")
    blocks = materialise(dyadic_blocks(merged_spans(whole, key), key), "blocks")
    levels = sorted(r[0] for r in blocks.select("_level").distinct().collect())  # 63 at most
    slot = F.floor(F.unix_micros(F.col(window_start).cast("timestamp")) / F.lit(1e6) / length).cast("bigint")
    slotted = df.withColumn("_slot", slot)
    asked = slotted.select(key, "_slot").distinct().join(blocks.select(key).distinct(), key, "left_semi")
    above = asked.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.expr("array(0)"))).withColumn(
        "_block", F.expr("shiftright(_slot, _level)"))
    hits = above.join(blocks, [key, "_level", "_block"], "left_semi").select(key, "_slot").distinct().withColumn("_hit", F.lit(1))
    joined = slotted.join(hits, [key, "_slot"], "left")
    return joined.withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_slot", "_hit")


def distinct_sites(telemetry: DataFrame, site: str = "tower_id", lat: str = "latitude",
                   lon: str = "longitude") -> DataFrame:
    """The site dimension found in the facts; a site seen at two places gives two rows."""
    return require_not_null(telemetry.select(site, lat, lon), [lat, lon]).distinct()


def _venue_cells(venues: DataFrame, radius_miles: float, size: float) -> DataFrame:
    north, east = geo.reach_degrees(F.col("venue_latitude"), radius_miles)
    return (
        require_not_null(venues, ["venue_latitude", "venue_longitude"])
        .withColumn("_row", F.explode(geo.cells_around(F.col("venue_latitude"), north, size)))
        .withColumn("_col", F.explode(geo.cells_around(F.col("venue_longitude"), east, size)))
    )


def _site_cells(sites: DataFrame, size: float) -> DataFrame:
    return sites.withColumns({
        "_row": geo.cell(F.col("latitude"), size),
        "_col": geo.cell(F.col("longitude"), size),
    })


def _distance() -> Column:
    return geo.distance_miles(
        F.col("venue_latitude"), F.col("venue_longitude"), F.col("latitude"), F.col("longitude"))


def _spread(near: DataFrame, located: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Split each cell with more than ``crowd`` sites into as many parts as its count asks for; others stay whole.

    There are at most (sites / crowd) such cells, so what is joined to find them is small next to the sites.
    """
    cell = ["_row", "_col"]
    crowded = located.groupBy(*cell).agg(F.count(F.lit(1)).alias("_sites")).where(F.col("_sites") > crowd).select(
        F.struct(*cell).alias("_cell"), F.ceil(F.col("_sites") / crowd).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    place = ["tower_id", "latitude", "longitude"]
    sites = join_unique(located.withColumn("_cell", F.struct(*cell)), crowded, "_cell", place, "left")
    venues = near.withColumn("_cell", F.struct(*cell)).join(crowded, "_cell", "left")
    return (
        venues.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_cell", "_parts"),
        sites.withColumn("_part", F.pmod(F.xxhash64(*place), parts).cast("int")).drop("_cell", "_parts"),
    )


CROWD = 4096


def proximity_join(events: DataFrame, sites: DataFrame, radius_miles: float = 5.0,
                   digits: int | None = 3, crowd: int = CROWD) -> DataFrame:
    """Every (event, site) pair within the radius, with its distance.

    A site lies in one grid cell and an event lists the cells around it, so a
    pair meets at most once.  Cells with many sites are split by their count.
    The radius is tested on the unrounded distance.

    Pairs are as many as places are dense, so their files outgrow everything else.  The sites of a cell's part, of
    which there are about ``crowd``, are one list in the order of their places, and each event goes through it: an
    event's columns, and those of a place, are runs that a file holds as one value.  Events of a cell are salted.
    """
    size = radius_miles / geo.MILES_PER_DEGREE
    near, located = _spread(_venue_cells(events, radius_miles, size), _site_cells(sites, size), crowd)
    cell = ["_row", "_col", "_part"]
    ordered = F.sort_array(F.collect_list(F.struct("latitude", "longitude", *[
        c for c in located.columns if c not in ("latitude", "longitude", *cell)])))
    listed = require_not_null(located, cell).groupBy(F.struct(*cell).alias("_cell")).agg(ordered.alias("_listed"))
    salt_by = [c for c, kind in near.dtypes if "map<" not in kind]  # maps have no hash
    pairs = (
        join_unique(near.withColumn("_cell", F.struct(*cell)), listed, "_cell", salt_by, salts=8)
        .select(*[c for c in near.columns if c not in cell], F.inline("_listed"))
        .select(*[c for c in (*located.columns, *near.columns) if c not in cell], _distance().alias("distance_miles"))
        .where(F.col("distance_miles") <= radius_miles)
    )
    return pairs if digits is None else pairs.withColumn("distance_miles", F.round("distance_miles", digits))


def sites_near(events: DataFrame, sites: DataFrame, radius_miles: float = 5.0, crowd: int = CROWD) -> DataFrame:
    """Sites with at least one event within the radius, without listing the pairs.

    Only distinct venue places matter, and the semi join stops at the first hit.
    """
    size = radius_miles / geo.MILES_PER_DEGREE
    places = events.select("venue_latitude", "venue_longitude").distinct()
    # The cell is an aggregate result, so the optimizer keeps the semi join above
    # the aggregate; pushed below, it would test every telemetry row.
    unique = sites.groupBy("tower_id", "latitude", "longitude").agg(
        F.max(geo.cell(F.col("latitude"), size)).alias("_row"),
        F.max(geo.cell(F.col("longitude"), size)).alias("_col"))
    near, located = _spread(_venue_cells(places, radius_miles, size), unique, crowd)
    hit = geo.distance_miles(near["venue_latitude"], near["venue_longitude"],
                             located["latitude"], located["longitude"]) <= radius_miles
    for column in ("_row", "_col", "_part"):
        hit = hit & (located[column] == near[column])
    return located.join(near, hit, "left_semi").select("tower_id").distinct()


def backfill(dimension: DataFrame, facts: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """Every key of the dimension with its facts, or the defaults when it has none."""
    joined = dimension.select(key).distinct().join(facts, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def new_rows_only(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in ``existing`` yet, one per key.

    Of rows with equal keys the first in the order of all their columns stays, so
    a rerun takes the same one.  ``existing`` may be far larger than ``rows``: it
    is first reduced to the keys in question, which needs no shuffle of it when
    those are few.
    """
    keys = list(keys)
    fresh = top_per_key(rows, keys, [F.asc(c) for c in rows.columns])
    known = existing.select(*keys).join(fresh.select(*keys), keys, "left_semi").distinct()
    return fresh.join(known, keys, "left_anti")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_of_{k}" for k in keys])
