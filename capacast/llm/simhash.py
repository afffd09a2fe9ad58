"""SimHash near-duplicates by an inverted index over byte positions.

Fingerprints that differ in at most three bits agree in at least five of their eight bytes.  The index posts every
distinct fingerprint under 14 sets of four byte positions.  The sets are those whose positions have an exclusive-or of
zero; any five positions contain exactly one of them, so a pair with five equal bytes meets at least once, while posting
lists are as short as lists over 32 bits can be.  Pairs that meet are tallied by the number of positional bytes they share,
those below the guaranteed minimum are dropped, and the rest verified on all 64 bits.

Joins are merge joins by hint: each side grows with the number of documents, packed far below the size at which Spark
stops broadcasting, and the driver would build the tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capacast import session
from capacast.llm.components import components
from capacast.llm.words import pieces

SEED = 42
MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
LONG_LIST = 64
QUADS = [q for q in combinations(range(8), 4) if reduce(int.__xor__, q) == 0]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _byte_mask(positions) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def fingerprint(raw: bytes, size: int = 3) -> int:
    """64-bit SimHash of a text's shingles of ``size`` words; 0 without words."""
    tokens = raw.lower().split()
    if not tokens:
        return 0
    text = b" ".join(tokens)
    if len(tokens) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    else:
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        starts = np.concatenate([[0], blanks + 1])[: 1 - size].tolist()
        ends = np.concatenate([blanks, [len(text)]])[size - 1:].tolist()
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        block = hashes[first:first + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; lower case of A-Z only, a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], ["doc_id", "fp"])

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, fp bigint")


def _shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    differing = a.bitwiseXOR(b)
    return reduce(Column.__add__, [
        (differing.bitwiseAND(F.lit(_signed(_byte_mask([p])))) == 0).cast("int") for p in range(8)])


def _posted(fps: DataFrame, extra: int) -> DataFrame:
    """Postings (place, value, fp) under every quad, with ``extra`` further byte positions each."""
    masks = [_signed(_byte_mask((*q, *more))) for q in QUADS
             for more in combinations([p for p in range(8) if p not in q], extra)]
    entries = F.array(*[F.struct(F.lit(i).alias("place"), F.col("fp").bitwiseAND(F.lit(m)).alias("value"))
                        for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(entries).alias("p")).select("p.place", "p.value", "fp")


def _lists(postings: DataFrame) -> DataFrame:
    """Postings of lists with two entries or more, with the list's length."""
    length = postings.groupBy("place", "value").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    return postings.join(length.hint("merge"), ["place", "value"])


def _met(lists: DataFrame, limit: int) -> DataFrame:
    """Candidate pairs from lists of at most ``limit`` entries."""
    short = lists.where(F.col("length") <= limit)
    left = short.select("place", "value", F.col("fp").alias("a"))
    right = short.select("place", "value", F.col("fp").alias("b"))
    return left.join(right.hint("merge"), ["place", "value"]).where("a > b").select("a", "b")


def _verified(met: DataFrame) -> DataFrame:
    """Pairs with enough shared positional bytes that are within three bits indeed."""
    tallied = met.distinct().where(_shared_bytes(F.col("a"), F.col("b")) >= MIN_BYTES)
    return tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)


def _list(items) -> str:
    return f"array({', '.join(map(str, items))})"


def _stars(lists: DataFrame) -> DataFrame:
    """Links within long lists, without pairs.

    Entries share five bytes.  Each is posted again under its value with any three of the other 24 bits cleared.  Entries
    with an equal key differ in those three bits at most, so all of them link to the smallest; entries that differ in up
    to three bits have such a key in common.
    """
    quint = [(*q, more) for q in QUADS for more in range(8) if more not in q]
    # Parsed as one text each: as thousands of literals they took the driver longer than their tasks the search.
    free = _list(_list(8 * p + bit for p in range(8) if p not in q for bit in range(8)) for q in quint)
    triples = _list(sum(bit << (5 * i) for i, bit in enumerate(t)) for t in combinations(range(24), MAX_BITS))
    spread = lists.select("place", "fp", F.explode(F.expr(triples)).alias("t"))
    cleared = [F.expr(f"shiftleft(1L, get(get({free}, place), shiftright(t, {5 * i}) & 31))") for i in range(MAX_BITS)]
    keyed = spread.select(
        "place", "t", "fp",
        F.col("fp").bitwiseAND(F.bitwise_not(reduce(Column.bitwiseOR, cleared))).alias("value"))
    lowest = keyed.groupBy("place", "t", "value").agg(F.min("fp").alias("b"), F.max("fp").alias("top"))
    return keyed.join(lowest.where("top > b").hint("merge"), ["place", "t", "value"]).where("fp > b").select(
        F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within three bits.

    Lists of up to ``long_list`` entries give their pairs.  Longer ones are split by a fifth byte position, in which a
    pair within three bits must agree as well somewhere; what is long still goes through ``_stars``.  No entry is
    dropped, and no list gives more than ``long_list`` pairs an entry.
    """
    lists = session.materialise(_lists(_posted(fps, 0)), "quads")
    crowded = lists.where(F.col("length") > long_list).select("fp").distinct()
    if crowded.isEmpty():
        return _verified(_met(lists, long_list))
    finer = session.materialise(_lists(_posted(crowded, 1)), "quints")
    met = _met(lists, long_list).union(_met(finer, long_list))
    return _verified(met).union(_stars(finer.where(F.col("length") > long_list)))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    long_list: int = LONG_LIST) -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    component_id is the smallest doc_id reachable over links of fingerprints within three bits, the row's own included.
    Empty and null texts have fingerprint 0 and link like any other.  A row without a doc_id takes part through its text
    and gets a null doc_id back; component_id is null if no member has an id.  Repeated rows come back as often as they
    are given; other columns are ignored; an empty table gives no rows.
    """
    fps = session.materialise(fingerprints(docs, id_column, text_column), "fingerprints")
    classes = session.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    linked = components(links(classes.select("fp"), long_list))
    rooted = classes.join(linked.hint("merge"), classes.fp == linked.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(first.hint("merge"), "root").select("fp", "component_id")
    return fps.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")
