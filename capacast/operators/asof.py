"""As-of joins and validity intervals, for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def known_values(df: DataFrame, key: str, time: str, values: Sequence[str]) -> DataFrame:
    """One row for each key and time at which all values are known; of several at one time the greatest."""
    known = df.dropna(subset=[key, time, *values])
    return known.groupBy(key, time).agg(F.max(F.struct(*values)).alias("_now")).select(key, time, "_now.*")


def changes(df: DataFrame, key: str, time: str, values: Sequence[str]) -> DataFrame:
    """(key, time, values): the times at which a key's known values differ from those known before.

    Rows with a null among key, time and values say nothing.  A key's history may lie in many partitions.
    """
    now = known_values(df, key, time, values)
    seen = running(now, [key], [time], {"_before": ("max", F.struct(time, *values))}, inclusive=False)
    same = [F.col(v).eqNullSafe(F.col(f"_before.{v}")) for v in values]
    kept = F.col("_before").isNull() | ~_all(same)
    return seen.where(kept).select(key, time, *values)


def validity(changed: DataFrame, key: str, time: str, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Turn the rows of ``changes`` into intervals: from its time up to the key's next one, which is null for the newest."""
    ahead = running(changed, [key], [F.desc(time)], {end: ("min", time)}, inclusive=False)
    return ahead.withColumnRenamed(time, start)


def join_as_of(facts: DataFrame, changed: DataFrame, key: str, time: str, values: Sequence[str],
               prefix: str = "known_") -> DataFrame:
    """Each row with the values of its key that were the newest at its time, in columns with the prefix.

    ``changed`` holds one row for a key and time at most and bears the same column names; a value counts from its own time
    on.  Both tables are put in one order and the newest values are carried along it, from range to range, so a key with a
    third of all rows lies in many partitions and no row meets all changes of its key.  A row without key or time, or before
    the first change, gets nulls; rows are neither lost nor repeated.  Columns that begin with an underscore are reserved.
    """
    kinds = {f.name: f.dataType for f in changed.schema.fields}
    noted = changed.select(key, time, F.struct(time, *values).alias("_new"), F.lit(0).alias("_fact"))
    asked = facts.withColumn("_fact", F.lit(1))
    both = asked.unionByName(noted, allowMissingColumns=True)
    carried = running(both, [key], [time, "_fact"], {"_newest": ("max", "_new")}).where("_fact = 1")
    usable = F.col(key).isNotNull() & F.col(time).isNotNull()
    return carried.select(*facts.columns, *[
        F.when(usable, F.col(f"_newest.{v}")).cast(kinds[v]).alias(prefix + v) for v in values])


def _all(conditions: Sequence[Column]) -> Column:
    return F.forall(F.array(*conditions), lambda same: same)
