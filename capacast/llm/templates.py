"""Benchmark decontamination by question templates.

Texts become sequences of tokens in which numbers, names and units are typed placeholders.  Windows of such tokens are
looked up among those of the benchmark by hash.  Where a document meets an item along one alignment, the values behind the
placeholders are compared: the same value of the item has to be replaced by the same value each time.  So a question is
found with other numbers and names too, and text that merely has the same frame is not.

Whether the first word of a sentence is a name cannot be seen from its capital, so texts are read in two forms: one in
which such a word is a literal, and one in which it is a name.  Templates of few literals would meet by chance, so a third
form has all tokens as they are; it finds items made of numbers, names and units where they are copied.  Each form is
judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capacast import session
from capacast.llm.words import gram_hashes, pieces, word_hashes
from capacast.operators.joins import join_null_safe

WINDOW = 8
SHORTEST = 3
LITERAL_SHARE = 0.5
NEEDED_SHARE = 0.5
NEEDED_WINDOWS = 8
COMMON = 4
INDEX_LIMIT = 4_000_000
INSIDE, ANYWHERE, VERBATIM = FORMS = range(3)

# Units that may follow a number.
UNITS = ("mm cm m km in inch inches ft feet foot yd yards mi mile miles mg g kg lb lbs oz t ton tons ml l liter liters "
         "litre litres gal s sec second seconds min minute minutes h hr hour hours day days week weeks month months year "
         "years hz khz mhz ghz b kb mb gb tb w kw mw kwh v a k c f usd eur gbp dollar dollars cent cents euro euros "
         "pound pounds percent degree degrees mph kmh m2 m3").split()

LETTER, DIGIT = 1, 2
_CODE = np.zeros(256, np.uint8)
_CODE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
_CODE[48:58] = DIGIT
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_JOINS = np.isin(np.arange(256), list(b".,"))
_ENDS = np.isin(np.arange(256), list(b".!?:;|()\"\n"))
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (11, 13, 17))
_SALT = np.arange(len(FORMS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_KINDS = np.array([0, _NUMBER, _NAME, _UNIT], np.uint64)


def _hashed(listed: list[str]) -> np.ndarray:
    raw = " ".join(listed).encode()
    ends = np.cumsum([len(w) + 1 for w in listed]) - 1
    return word_hashes(raw, ends - [len(w) for w in listed], ends)


_UNIT_HASHES = _hashed(UNITS)


@dataclass
class Tokens:
    """Tokens of several texts: canonical value, kind (0 literal), and the bytes that each stands for."""

    raw: bytes
    text: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def slots(self, at: int, size: int) -> list[str]:
        return [self.raw[self.start[i]:self.end[i]].decode(errors="replace")
                for i in range(at, at + size) if self.kind[i]]


def canonical(texts: list[bytes], form: int = INSIDE) -> Tokens:
    """Tokens are runs of letters (any byte from 128 on counts) or of digits with points or commas in between.

    A capitalised token inside a sentence (in form ``ANYWHERE`` also at its start) is a name, a token of ``UNITS`` behind a number a unit.  Neighbouring numbers
    and neighbouring names are one placeholder.  Literals compare without case of A-Z.
    In form ``VERBATIM`` all tokens are literals.
    """
    raw = b"\n".join(texts)
    data = np.frombuffer(raw, np.uint8)
    code = np.zeros(len(data) + 2, np.uint8)
    code[1:-1] = _CODE[data]
    joins = np.flatnonzero(_JOINS[data]) + 1
    joins = joins[(code[joins - 1] == DIGIT) & (code[joins + 1] == DIGIT)]
    code[joins] = DIGIT
    edges = np.flatnonzero(code[1:] != code[:-1])
    begins = code[edges + 1] > 0
    start = edges[begins]
    end = edges[np.flatnonzero(begins) + 1]
    stops = np.zeros(len(data) + 1, np.int32)
    is_stop = _ENDS[data]
    is_stop[joins - 1] = False
    np.cumsum(is_stop, out=stops[1:])
    same_sentence = np.zeros(len(start), bool)
    same_sentence[1:] = stops[start[1:]] == stops[end[:-1]]
    value = word_hashes(raw.lower(), start, end)
    number = code[start + 1] == DIGIT
    kind = np.where(number, 1, np.where(_UPPER[data[start]] & (same_sentence | (form == ANYWHERE)), 2, 0)).astype(
        np.uint8) if len(start) else np.zeros(0, np.uint8)
    behind = np.flatnonzero(number[:-1] & same_sentence[1:]) + 1
    kind[behind[np.isin(value[behind], _UNIT_HASHES)]] = 3
    if form == VERBATIM:
        kind[:] = 0
    value = np.where(kind > 0, _KINDS[kind], value)
    more = np.zeros(len(start), bool)
    more[1:] = (kind[1:] == kind[:-1]) & np.isin(kind[1:], (1, 2)) & same_sentence[1:]
    kept = np.flatnonzero(~more)
    last = np.append(kept[1:], len(start)) - 1
    begin_of_text = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.searchsorted(begin_of_text, start[kept], "right") - 1
    return Tokens(raw, text, value[kept], kind[kept], start[kept], end[last] if len(kept) else end[:0])


def _windows(tokens: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows within one text that hold enough literals."""
    hashes = gram_hashes(tokens.value, size)
    literals = np.concatenate([[0], np.cumsum(tokens.kind == 0)])
    count = len(hashes)
    enough = literals[size:size + count] - literals[:count] >= max(2, size * LITERAL_SHARE)
    at = np.flatnonzero(enough & (tokens.text[:count] == tokens.text[size - 1:size - 1 + count]))
    return at, hashes[at]


class Lookup:
    """Which hashes belong to a sorted set; a small bitmap answers for most."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes.astype(np.uint64))
        bits = min(24, max(10, len(self.sorted).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.sorted >> self.shift).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.searchsorted(self.sorted, hashes[maybe])
        return maybe[self.sorted[np.minimum(at, len(self.sorted) - 1)] == hashes[maybe]]


def _lists(batch: pa.RecordBatch, texts: list[bytes], sizes: list[int], lookup: Lookup | None,
           shorter_than: int) -> pa.RecordBatch:
    rows, forms, hashes, positions, slots = [], [], [], [], []
    for form in FORMS:
        tokens = canonical(texts, form)
        first = np.searchsorted(tokens.text, np.arange(len(texts)))
        counts = np.diff(np.append(first, len(tokens.text)))
        for size in sizes:
            at, found = _windows(tokens, size)
            found = found ^ _SALT[form]
            if lookup is not None:
                hit = lookup.hits(found)
                at, found = at[hit], found[hit]
            text = tokens.text[at]
            if size < shorter_than:  # an item shorter than a window is one window
                whole = counts[text] == size
                at, found, text = at[whole], found[whole], text[whole]
            rows.append(text)
            forms.append(np.full(len(at), form, np.int32))
            hashes.append(found)
            positions.append(at - first[text])
            slots += [tokens.slots(i, size) for i in at]
    rows = pa.array(np.concatenate(rows))
    fixed = [batch.column(i).take(rows) for i in range(1, batch.num_columns)]
    return pa.RecordBatch.from_arrays(
        [*fixed, pa.array(np.concatenate(forms)), pa.array(np.concatenate(hashes).view(np.int64)),
         pa.array(np.concatenate(positions).astype(np.int32)), pa.array(slots, pa.list_(pa.string()))],
        [*batch.schema.names[1:], "form", "hash", "at", "slots"])


def windows(table: DataFrame, sizes: list[int], wanted=None, shorter_than: int = 0) -> DataFrame:
    """Template windows (form, hash, at, slots) of ``table`` (column text and others, which are carried along).

    All of them, or those whose hash is in the broadcast array ``wanted``.  Sizes below ``shorter_than``, the window of
    items, count only where they are the whole text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(wanted.value) if wanted is not None else None
        for part, texts in pieces(batches):
            yield _lists(part, texts, sizes, lookup, shorter_than)

    carried = [c for c in table.columns if c != "text"]
    picked = table.select("text", *carried)
    fixed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(run, f"{fixed}, form int, hash bigint, at int, slots array<string>")


def _item_sizes(items: DataFrame, window: int) -> list[int]:
    """Window lengths in use: the full one, and those of the items that are shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            counts = np.concatenate([np.bincount(canonical(texts, f).text, minlength=len(texts)) for f in FORMS])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(counts).astype(np.int32))], ["n"])

    short = items.select("text").mapInArrow(run, "n int").where(f"n >= {SHORTEST} and n < {window}").distinct()
    return sorted(r.n for r in short.collect()) + [window]


def _classes(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of items that the same documents hold, and their members.

    In one form, items of one template whose values are equal at the same places are held by the same documents, and
    differ in ``n_changed`` only.  (form, pattern) is such a class, with its windows in order, whose slots are numbers of
    values; each member has its values by number.  ``item_class`` stands for the set of items, whatever the form.
    """
    of_item = ["item_id", "item_hash", "form"]
    listed = F.array_sort(F.collect_list(F.struct("item_at", "hash", "item_slots")))
    described = index.groupBy(*of_item).agg(listed.alias("listed")).withColumn(
        "values", F.array_distinct(F.flatten("listed.item_slots")))
    windows = F.transform("listed", lambda w: F.struct(w["item_at"].alias("item_at"), w["hash"].alias("hash"), F.transform(
        w["item_slots"], lambda v: F.array_position("values", v).cast("int")).alias("item_slots")))
    described = described.withColumn("windows", windows).select(
        *of_item, "values", "windows", F.xxhash64("listed.item_at", "listed.hash").alias("template"),
        F.xxhash64("windows").alias("pattern"))
    described = session.materialise(described, "described")
    item = F.struct("item_id", "item_hash")
    classes = described.groupBy("form", "pattern").agg(
        F.any_value("template").alias("template"), F.any_value("windows").alias("windows"),
        F.count(F.lit(1)).alias("n_items"), F.min(item).alias("first"), F.bit_xor(F.xxhash64(item)).alias("mixed"))
    classes = session.materialise(classes.withColumn("item_class", F.xxhash64("first", "n_items", "mixed")), "classes")
    members = described.select("form", "pattern", "item_id", "item_hash", "values").join(
        classes.select("form", "pattern", "item_class", "n_items", "first"), ["form", "pattern"])
    members = members.select("item_class", "form", "item_id", "item_hash", "values", "n_items",
                             item.eqNullSafe(F.col("first")).alias("stands"))
    return classes, session.materialise(members, "members")


def _catalogue(classes: DataFrame) -> DataFrame:
    """The classes' windows with ``own``: whether items of the class are looked up by the window.

    A window of more than ``COMMON`` templates (an instruction that items share) is nobody's own, and an item without any of
    its own is looked up by all of its rarest windows.
    """
    of_class = ["form", "pattern"]
    rows = classes.select(*of_class, "template", F.explode("windows").alias("w")).select(*of_class, "template", "w.*")
    shared = rows.select("hash", "template").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_templates"))
    rows = session.materialise(rows.join(shared, "hash"), "shared")
    rarest = rows.groupBy(*of_class).agg(F.min("n_templates").alias("rarest"))
    own = F.col("n_templates") <= F.greatest(F.lit(COMMON), "rarest")
    return rows.join(rarest, of_class).select(*of_class, "hash", "item_at", "item_slots", own.alias("own"))


def _needed(count: str):
    return F.least(F.lit(NEEDED_WINDOWS), F.ceil(F.col(count) * NEEDED_SHARE))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index_limit: int = INDEX_LIMIT,
          id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
          item_text_column: str = "text", every_item: bool = False) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_matched, n_changed, item_class, n_items) for each document that holds an item.

    The numbers are those of the first form in which the item is held.
    An item counts as held if half of its windows match consistently, or ``NEEDED_WINDOWS`` of them, and if the same is
    true of the windows of its own, those of ``COMMON`` templates at most, or its rarest; a window counts as
    often as both the document and the item have it.  Documents meet items on the items' own windows only, so an
    instruction that many items share neither makes a document hold them nor brings it together with them.

    Items that the same documents hold are a class: they have one template, and equal values at the same places.  The
    members of a class of ``COMMON`` items at most are each listed with every document.  A larger class, of ``n_items``, is
    listed with every document by its smallest item; with ``every_item`` its other items are listed once, with the
    smallest of its documents.  So rows of one ``item_class`` give all pairs of its documents and items, and the table has
    no more rows than documents' classes and items have.

    An item with fewer
    tokens than a window is one window by itself; below ``SHORTEST`` tokens it cannot be recognised, and with less than
    half literals in every window only where it is copied with its values.  n_changed counts the item's placeholder values that the document replaces.
    Null and empty texts hold nothing; rows with equal id and text are one finding;
    a row without an id is reported without one; other columns are ignored; empty tables give no rows.

    The index of the benchmark goes to all tasks if it has ``index_limit`` hashes at most (8 bytes each, so 32 MB), and
    otherwise the windows of all documents are joined to it by a shuffle on the hash.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_text_column).alias("text"), F.col(item_column).alias("item_id"),
                             F.xxhash64(item_text_column).alias("item_hash")).dropDuplicates(["item_id", "item_hash"])
    sizes = _item_sizes(items, window)
    raw = session.materialise(windows(items, sizes, shorter_than=window).select(
        "item_id", "item_hash", "form", "hash", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")), "templates")
    classes, members = _classes(raw)
    index = session.materialise(_catalogue(classes), "index")
    hashes = index.select("hash").distinct()
    small = hashes.count() <= index_limit
    sent = F.broadcast if small else lambda df: df
    wanted = None
    if small:
        listed = np.fromiter((r.hash for r in hashes.toLocalIterator()), np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(listed)
    rows = docs.select(F.col(text_column).alias("text"), F.col(id_column).alias("doc_id"),
                       F.xxhash64(text_column).alias("text_hash"))
    found = windows(rows, sizes, wanted).drop("form")  # the hash tells
    found = session.materialise(found if small else found.join(hashes, "hash", "left_semi"), "hits")

    doc, of_class = ["doc_id", "text_hash"], ["form", "pattern"]
    counts = session.materialise(index.groupBy(*of_class).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if("own").alias("n_own")), "counts")
    # How often both have each of the class's own windows: at least as often as they match along any alignments.
    own = index.where("own").groupBy(*of_class, "hash").agg(F.count(F.lit(1)).alias("in_item"))
    seen = found.groupBy(*doc, "hash").agg(F.countDistinct("at").alias("in_doc"))
    shared = seen.join(sent(own), "hash").groupBy(*doc, *of_class).agg(F.sum(F.least("in_item", "in_doc")).alias("n_shared"))
    candidates = session.materialise(shared.join(sent(counts), of_class).where(
        F.col("n_shared") >= _needed("n_own")).select(*doc, *of_class), "candidates")

    expected = candidates.join(sent(index), of_class)
    met = join_null_safe(expected, found, [*doc, "hash"])
    pairs = F.arrays_zip(F.col("item_slots").alias("old"), F.col("slots").alias("new"))
    key = [*doc, *of_class]
    aligned = met.groupBy(*key, (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.struct("hash", "own", "item_at", "at", pairs.alias("pairs"))).alias("held"))
    # In order, an old value with two new ones is next to itself.
    aligned = aligned.withColumn("values", F.array_sort(F.array_distinct(F.flatten(F.transform(
        "held", lambda w: w["pairs"])))))
    torn = F.array_distinct(F.transform(F.filter("values", lambda p, i: (i > 0) & (
        p["old"] == F.get("values", i - 1)["old"])), lambda p: p["old"]))
    steady = aligned.withColumn("torn", torn).withColumn("held", F.filter(
        "held", lambda w: ~F.exists(w["pairs"], lambda p: F.array_contains("torn", p["old"]))))
    replaced = F.filter("values", lambda p: ~F.array_contains("torn", p["old"]))
    # A window that the document or the item repeats meets along many alignments; it counts as often as both have it.
    by_window = steady.select(*key, replaced.alias("replaced"), F.explode_outer("held").alias("w")).groupBy(
        *key, F.col("w.hash").alias("hash"), F.col("w.own").alias("own")).agg(
        F.least(F.size(F.collect_set("w.item_at")), F.size(F.collect_set("w.at"))).alias("held"),
        F.array_distinct(F.flatten(F.collect_set("replaced"))).alias("replaced"))
    matched = by_window.groupBy(*key).agg(
        F.sum("held").alias("n_matched"), F.sum(F.when(F.col("own"), F.col("held")).otherwise(0)).alias("own_matched"),
        F.array_distinct(F.flatten(F.collect_set("replaced"))).alias("replaced"))
    judged = matched.join(sent(counts), of_class)
    held = judged.where((F.col("n_matched") >= _needed("n_windows")) & (F.col("own_matched") >= _needed("n_own")))
    named = held.join(sent(classes.select(*of_class, "item_class", "n_items")), of_class)
    best = session.materialise(named.groupBy(*doc, "item_class", "n_items").agg(
        F.min(F.struct("form", "n_windows", "n_matched", "replaced")).alias("best")).select(
        *doc, "item_class", "n_items", "best.*"), "held")

    listed = best.join(members.where(f"n_items <= {COMMON} or stands").drop("n_items"), ["item_class", "form"])
    if every_item:
        smallest = best.where(f"n_items > {COMMON}").groupBy("item_class", "n_items").agg(
            F.min(F.struct(*doc, "form", "n_windows", "n_matched", "replaced")).alias("first"))
        rest = smallest.select("item_class", "n_items", "first.*").join(
            members.where(f"n_items > {COMMON} and not stands").drop("n_items"), ["item_class", "form"])
        listed = listed.unionByName(rest)
    changed = F.array_distinct(F.transform(F.filter(
        "replaced", lambda p: p["new"] != F.get("values", p["old"] - 1)), lambda p: p["old"]))
    # An item of several small classes, by form, is listed once.
    of_large = F.when(F.col("n_items") > COMMON, F.col("item_class")).alias("of_large")
    once = listed.withColumn("n_changed", F.size(changed)).groupBy(*doc, "item_id", "item_hash", of_large).agg(
        F.min(F.struct("form", "n_windows", "n_matched", "n_changed", "item_class", "n_items")).alias("row"))
    return once.select("doc_id", "text_hash", "item_id", "row.n_windows", "row.n_matched", "row.n_changed",
                       "row.item_class", "row.n_items")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   **options) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; rows are told apart by id and text.

    Columns of ``docs`` may have any names: the given row travels as one value.
    """
    held = leaks(docs, benchmark, id_column=id_column, text_column=text_column, **options)
    held = session.materialise(held.select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash"))
                               .distinct(), "leaks")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = F.col("row")
    kept = given.join(held, row.getField(id_column).eqNullSafe(F.col("leak_id"))
                      & (F.xxhash64(row.getField(text_column)) == F.col("leak_hash")), "left_anti")
    return kept.select(*[row.getField(c).alias(c) for c in docs.columns])
