"""Fill-in-middle transformation by a wavelet matrix over character classes.

A text's units are runs of ASCII letters and single other characters.  The classes of a piece of text, one for every UTF-8
byte, go into a wavelet matrix: one bit vector for each bit of the class, each with counts by word.  A class's rank is one
pass through the levels; units and characters before a place are sums of ranks, and a cut after k units is found by bisection
on them, for all texts of a piece at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capacast.llm import words

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
# The classes of bytes.  A letter that follows a letter and a further byte of a character do not begin a unit.
OTHER, FIRST_LETTER, LATER_LETTER, TAIL = range(4)
LEVELS = 2


class Bits:
    """A bit vector with the number of ones before every word of 64 bits."""

    def __init__(self, ones: np.ndarray):
        packed = np.packbits(ones, bitorder="little")
        self.words = np.zeros(len(ones) // 64 + 1, "<u8")
        self.words.view(np.uint8)[:len(packed)] = packed
        self.counts = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.counts[1:])

    def before(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, rest = places >> 6, (places & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank queries over a sequence of small numbers."""

    def __init__(self, values: np.ndarray, levels: int = LEVELS):
        self.levels = []
        for level in reversed(range(levels)):
            ones = (values >> level & 1).astype(bool)
            self.levels.append((level, Bits(ones), len(values) - int(np.count_nonzero(ones))))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value: int, places: np.ndarray) -> np.ndarray:
        """How often ``value`` occurs before each place."""
        low, high = np.zeros_like(places), places
        for level, bits, zeros in self.levels:
            if value >> level & 1:
                low, high = zeros + bits.before(low), zeros + bits.before(high)
            else:
                low, high = low - bits.before(low), high - bits.before(high)
        return high - low


def classes(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The class of every byte of texts that begin at ``starts``."""
    data = np.frombuffer(raw, np.uint8)
    lower = data | 0x20
    letter = (lower >= ord("a")) & (lower <= ord("z")) & (data < 0x80)
    follows = np.zeros(len(data), bool)
    follows[1:] = letter[:-1]
    follows[starts[starts < len(data)]] = False
    found = np.full(len(data), OTHER, np.uint8)
    found[letter] = FIRST_LETTER
    found[letter & follows] = LATER_LETTER
    found[(data & 0xC0) == 0x80] = TAIL
    return found


class Units:
    """Counts of units and characters in a piece of texts, and the places of cuts."""

    def __init__(self, texts: list[bytes]):
        edges = np.cumsum([0, *map(len, texts)])
        self.starts, self.ends = edges[:-1], edges[1:]
        self.matrix = WaveletMatrix(classes(b"".join(texts), self.starts))
        self.totals = self.before(self.ends) - self.before(self.starts)

    def before(self, places: np.ndarray) -> np.ndarray:
        """Units that begin before each place."""
        return self.matrix.rank(OTHER, places) + self.matrix.rank(FIRST_LETTER, places)

    def characters(self, places: np.ndarray) -> np.ndarray:
        return places - self.matrix.rank(TAIL, places)

    def cuts(self, counts: np.ndarray) -> np.ndarray:
        """The place behind the first ``counts`` units of each text: the last one with no more units before it."""
        wanted = self.before(self.starts) + counts
        low, high = self.starts.copy(), self.ends.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.before(middle) <= wanted
            low, high = np.where(fits, middle, low), np.where(fits, high, np.maximum(middle - 1, low))
        return low


def _transformed(texts: list[bytes], draws: np.ndarray, plain_share: int, spm_share: int) -> list[list]:
    """Columns n, form, prefix_chars, middle_chars and output for a piece of texts; ``draws`` has four numbers a text."""
    units = Units(texts)
    one, two = draws[0] % (units.totals + 1), draws[1] % (units.totals + 1)
    first, second = units.cuts(np.minimum(one, two)), units.cuts(np.maximum(one, two))
    at_start, at_first, at_second = map(units.characters, (units.starts, first, second))
    columns: list[list] = [[], [], [], [], []]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    shapes = (units.starts, first, second, at_first - at_start, at_second - at_first, draws[2] % 100, draws[3] % 100)
    for text, n, *rest in zip(texts, units.totals.tolist(), *(s.tolist() for s in shapes)):
        start, a, b, prefix_chars, middle_chars, leave, turn = rest
        if not text or leave >= 100 - plain_share or any(m in text for m in marks):
            row = (n, PLAIN, None, None, text)
        else:
            prefix, middle, suffix = text[:a - start], text[a - start:b - start], text[b - start:]
            if turn < spm_share:
                form, listed = SPM, (marks[1], suffix, marks[0], prefix, marks[2], middle)
            else:
                form, listed = PSM, (marks[0], prefix, marks[1], suffix, marks[2], middle)
            row = (n, form, prefix_chars, middle_chars, b"".join(listed))
        for column, value in zip(columns, row):
            column.append(value)
    return columns


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_share: int = 10, spm_share: int = 20,
                   id_column: str = "doc_id") -> DataFrame:
    """Every text cut at two random places between its units and put in the order of a fill-in-middle sample.

    Returns one row for each row of ``docs``: the id, n (units), form, prefix_chars and middle_chars (characters, null if
    plain) and output.  Draws are the first four groups of eight hex digits of the SHA-256 of "seed:id": the first two set
    the cuts, the third leaves ``plain_share`` per cent of the texts as they are, the fourth puts the suffix in front for
    ``spm_share`` per cent of the others.  Empty and null texts, and texts that hold one of the marks, stay as they are (a
    null text gives an empty output).  A null id is drawn for as an empty one; rows with equal ids get the same draws;
    other columns are ignored; an empty table gives no rows.  A task holds one text at a time, or a
    megabyte of shorter ones, with some bytes for each of its bytes; the ranks themselves take half a byte.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i}") for i in range(4)]
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col("text"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for piece, texts in words.pieces(batches):
            drawn = np.stack([piece.column(f"h{i}").to_numpy() for i in range(4)])
            found = _transformed(texts, drawn, plain_share, spm_share)
            output = pa.array(found[4], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *[pa.array(c, t) for c, t in zip(found, types)], output], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.

    The cut texts hold no mark, and no mark begins within another, so the first of each mark is the one that was put there.
    """
    def between(front: str, back: str) -> Column:
        inner = F.substr(output, F.lit(len(front) + 1))
        return F.substring_index(inner, back, 1)

    middle = F.substr(output, F.locate(MIDDLE, output) + len(MIDDLE))
    parts = {
        PSM: (between(PREFIX, SUFFIX), F.substring_index(F.substr(output, F.locate(SUFFIX, output) + len(SUFFIX)), MIDDLE, 1)),
        SPM: (F.substring_index(F.substr(output, F.locate(PREFIX, output) + len(PREFIX)), MIDDLE, 1), between(SUFFIX, PREFIX)),
    }
    built = {name: F.concat(prefix, middle, suffix) for name, (prefix, suffix) in parts.items()}
    return F.when(form == PSM, built[PSM]).when(form == SPM, built[SPM]).otherwise(output)


def oracle_sql() -> str:
    """DuckDB form of the query: units as a list by a regular expression, parts as slices of it."""
    return """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS digest,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
cut AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || digest[1:8])::BIGINT % (len(units) + 1) AS a,
         ('0x' || digest[9:16])::BIGINT % (len(units) + 1) AS b, ('0x' || digest[17:24])::BIGINT % 100 AS leave,
         ('0x' || digest[25:32])::BIGINT % 100 AS turn FROM drawn),
parts AS (
  SELECT doc_id, text, n, array_to_string(units[1:least(a, b)], '') AS prefix,
         array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(units[greatest(a, b) + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR leave >= 90
              THEN 'plain' WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
