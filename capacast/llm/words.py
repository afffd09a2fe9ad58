"""Words of whole texts as numpy arrays, for use inside tasks.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return.  Texts are handled
in pieces of bounded size, so that memory depends on the longest single text and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
PIECE = 1 << 18
ROWS = 256
_IS_SPACE = np.isin(np.arange(256), list(SEPARATORS))
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_U64 = 1 << 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_BASE))


def _powers(base: int, count: int) -> np.ndarray:
    """base**0 to base**count modulo 2**64; not kept, as each task has globals of its own that only a full garbage
    collection frees."""
    factors = np.full(count + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """Hash of every run values[start:end] from one running sum."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values))[:-1], out=sums[1:])
    back = _powers(pow(base, -1, _U64), len(values))[starts]
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * back + lengths * np.uint64(_BYTE_BASE))


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offset of every word."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, for texts of any length."""
    found = []
    data = np.frombuffer(raw, np.uint8)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        low, high = starts[first], ends[last - 1]
        found.append(run_hashes(
            _BYTE_VALUE[data[low:high]], starts[first:last] - low, ends[first:last] - low, _BYTE_BASE))
        first = last
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every window of ``size`` consecutive words."""
    starts = np.arange(max(0, len(hashes) - size + 1))
    return run_hashes(hashes, starts, starts + size)


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``limit`` bytes of text and ``ROWS`` rows, one row at least; a null text is empty.

    Texts become Python objects slice by slice, so a task holds few of them however many rows a batch has.
    """
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            raw = [x or b"" for x in texts(part.column(column))]
            first, held = 0, 0
            for row, text in enumerate(raw):
                if row > first and held + len(text) > limit:
                    yield part.slice(first, row - first), raw[first:row]
                    first, held = row, 0
                held += len(text)
            yield part.slice(first), raw[first:]
