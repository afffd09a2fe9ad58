"""Telling rows apart where document ids are missing or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capacast import session


def plain(docs: DataFrame, id_column: str = "doc_id") -> bool:
    """Whether every row has an id of its own."""
    ids = docs.select(F.col(id_column).alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty()


def numbered(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(number, row): the rows as structs, numbered in the order of their ids, rows without one last; written, so that the
    numbers stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    ordered = docs.select(row.alias("row")).orderBy(F.col("row").getField(id_column).asc_nulls_last(), F.xxhash64("row"))
    return session.materialise(ordered.select(F.monotonically_increasing_id().alias("number"), "row"), "numbered")
