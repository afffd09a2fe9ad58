"""Row-level operators; all but ``union_evolving`` also run unchanged on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Plain ``IS NOT NULL`` tests, which reach the Parquet scan (``dropna`` does not)."""
    for column in columns:
        df = df.where(F.col(column).isNotNull())
    return df


def ingest(df: DataFrame, columns: Sequence[str], stamp: bool = True) -> DataFrame:
    """Explicit column list plus an audit time (constant within a batch)."""
    out = df.select(*columns)
    return out.withColumn("ingested_at", F.current_timestamp()) if stamp else out


def union_evolving(*frames: DataFrame) -> DataFrame:
    """Append by name; columns a frame lacks are filled with nulls."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def status_as_of(df: DataFrame, as_of: Column, expires: str = "expires_timestamp",
                 out: str = "status") -> DataFrame:
    """``active`` while the expiry lies after the reference time."""
    return df.withColumn(out, F.when(F.col(expires) > as_of, "active").otherwise("terminated"))


def conform(df: DataFrame, schema) -> DataFrame:
    """Order and cast the columns to a declared schema; unreadable values fail the job."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
