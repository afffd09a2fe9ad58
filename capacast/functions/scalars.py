"""Small reusable column expressions."""

from __future__ import annotations

import string
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Keep values in ``[low, high]``.

    ``greatest`` and ``least`` skip nulls, so a null becomes the bound.
    """
    if low is not None:
        column = F.greatest(F.lit(low), column)
    if high is not None:
        column = F.least(F.lit(high), column)
    return column


def in_range_or_null(column: Column, low: float, high: float) -> Column:
    """The value when inside the closed range, else null."""
    return F.when(column.between(low, high), column)


def weighted_sum(terms: Iterable[tuple[Column, float]], digits: int | None = None) -> Column:
    """Sum of column times weight, left to right, optionally rounded."""
    total = None
    for column, weight in terms:
        part = column * F.lit(weight)
        total = part if total is None else total + part
    return total if digits is None else F.round(total, digits)


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose condition is true; null conditions fall through."""
    (condition, value), *rest = rules
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def ladder(column: Column, steps: Sequence[tuple[float, str]], default: str,
           inclusive: bool = True) -> Column:
    """Label by descending thresholds, ``>=`` or strictly ``>``."""
    return first_match(
        [(column >= limit if inclusive else column > limit, label) for limit, label in steps],
        default,
    )


def lookup(column: Column, table: Mapping[str, object], default: object) -> Column:
    """Code to value by a small fixed table; unknown and null codes give the default."""
    return first_match([(column == code, value) for code, value in table.items()], default)


def number_or(column: Column, default: float = 0.0, kind: str = "double") -> Column:
    """Read a value as a number; nulls and unreadable text give the default."""
    return F.coalesce(column.try_cast(kind), F.lit(default).cast(kind))


def ratio_pct(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """``part`` in percent of ``whole``; null when the divisor is zero."""
    share = F.try_divide(part, whole) * F.lit(100.0)
    return share if digits is None else F.round(share, digits)


def hash_int(column: Column, salt: str = "") -> Column:
    """First 32 bits of the MD5 of the text, as a BIGINT in ``[0, 2^32)``."""
    text = column.cast("string")
    if salt:
        text = F.concat(text, F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_unit(column: Column, salt: str = "") -> Column:
    """A repeatable uniform draw in ``[0, 1)`` for a key."""
    return hash_int(column, salt) / F.lit(4294967296.0)


def time_bucket(column: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket holding the time; keeps the time type, null stays null."""
    inside = F.pmod(F.unix_micros(column.cast("timestamp")), F.lit(seconds * 1_000_000))
    return column - F.make_dt_interval(secs=(inside / F.lit(1_000_000).cast("decimal(18,6)")).cast("decimal(18,6)"))


def with_prefix(column: Column, prefix: str) -> Column:
    return column.startswith(prefix)


def burst_suffix(column: Column, strict: bool = False) -> Column:
    """Types that end in ``_burst``.

    By default ``_`` is the LIKE wildcard, so any character may stand before
    ``burst``; ``strict`` asks for a literal underscore.
    """
    return column.endswith("_burst") if strict else column.like("%_burst")


def since(column: Column, as_of: Column, minutes: int) -> Column:
    """True for times not older than ``minutes`` before ``as_of``."""
    return column >= F.timestamp_add("MINUTE", F.lit(-minutes), as_of)


def in_slice(column: Column, start: Column, end: Column) -> Column:
    """Half-open time slice ``[start, end)``."""
    return (column >= start) & (column < end)


def fill(template: str, **columns: Column) -> Column:
    """Text with ``{name}`` places filled by columns; null when any of them is null."""
    pieces = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name:
            pieces.append(columns[name].cast("string"))
    return F.concat(*pieces)
