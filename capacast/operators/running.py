"""Running totals in order, over keys of any size and over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions.aggregates import WIDE

_COMBINE = {"sum": lambda before, here: before + here, "min": F.least, "max": F.greatest}
_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
            values: Mapping[str, tuple[str, str | Column]], inclusive: bool = True) -> DataFrame:
    """Add the sum, smallest or greatest value of a key's rows up to each row, in the given order.

    ``values`` maps a new column to ("sum" | "min" | "max", column).  Rows are dealt out by ranges of keys and order, so a
    key that holds a large share of all rows (or all of them, without keys) lies in many partitions; each partition adds up
    its own rows, and the totals of a key's partitions before it, one row for each, are added to them.  Nulls count as
    nothing: a sum starts at 0, a smallest or greatest value is null as long as there is none.  Floating-point
    numbers are summed as decimals, so sums do not depend on where ranges end.  ``inclusive=False`` leaves the row itself out.
    End ``order`` with a unique column, otherwise rows that tie share their values in any order.  A null key is a key of its
    own; an empty table gives no rows.  Columns that begin with an
    underscore are reserved.
    """
    keys, order = list(keys), [F.col(o) if isinstance(o, str) else o for o in order]
    floats = set()
    inputs, kinds = {}, {}
    for i, (name, (kind, column)) in enumerate(values.items()):
        column = F.col(column) if isinstance(column, str) else column
        if kind == "sum" and df.select(column).schema[0].dataType.typeName() in ("double", "float"):
            floats.add(name)
            column = column.cast(WIDE)
        inputs[f"_value{i}"], kinds[f"_value{i}"] = column, kind
    ranged = df.withColumns(inputs).repartitionByRange(*keys, *order) if keys or order else df.withColumns(inputs)
    # Ranges are sampled, so another run could cut elsewhere: what is added up later must be written with its range.
    rows = session.materialise(ranged.withColumn("_part", F.spark_partition_id()), "ranges")

    totals = rows.groupBy(*keys, "_part").agg(*[_AGGREGATE[k](v).alias(v) for v, k in kinds.items()])
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("_part", *[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)],
                          *[_AGGREGATE[k](v).over(earlier).alias(f"{v}_before") for v, k in kinds.items()])
    same = F.col("_part") == F.col("_in_part")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_of{i}"))
    here = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    summed = rows.withColumns({f"{v}_here": _AGGREGATE[k](v).over(here) for v, k in kinds.items()})
    joined = summed.join(ahead.withColumnRenamed("_part", "_in_part"), same)
    results = {}
    for name, (v, kind) in zip(values, kinds.items()):
        before, inside = F.col(f"{v}_before"), F.col(f"{v}_here")
        if kind == "sum":
            before, inside = F.coalesce(before, F.lit(0)), F.coalesce(inside, F.lit(0))
        both = _COMBINE[kind](before, inside)
        results[name] = both.cast("double") if name in floats else both
    return joined.select(*df.columns, *[c.alias(n) for n, c in results.items()])
