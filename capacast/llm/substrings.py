"""Removal of passages that occur earlier, by seed and extend.

Seeds.  Every run of ``length`` words holds one winnowed anchor: the word gram with the smallest hash in it.  Equal runs
choose the same anchor at the same offset, so runs have to be compared under equal anchors only.  Neighbouring runs with
the same anchor form one seed, which carries the hash of all words that it spans.

Extend.  Seeds are joined on their anchor.  A seed whose whole span occurs earlier is a repeat from end to end.  Where one
anchor has different spans, the match ends somewhere within: one seed of each such span is extended to both sides run by
run, and every run is looked up by its own hash.

Maximal repeats.  The repeated runs of a document are merged into maximal stretches and cut out.

Equality of words is that of 128 bits of hashes (anchor and run).  Rows that a task itself can tell to be repeats leave the
comparison at once, so a passage in a third of all documents gives the shuffle one row for each batch of documents.  An
anchor with many spans is spread by the span; which anchors have several is counted with partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capacast import session
from capacast.llm import ids
from capacast.llm.words import gram_hashes, pieces, run_hashes, spans, word_hashes

LENGTH = 20
GRAM = 6
NO_ID = (1 << 63) - 1
FLUSH = 500_000

_SEED_TYPES = [("anchor", np.uint64), ("span", np.uint64), ("place", np.int64), ("tag", np.int64),
               ("start", np.int64), ("runs", np.int64), ("known", np.bool_)]
_SEED_SCHEMA = "anchor bigint, span bigint, place bigint, tag bigint, start int, runs int, known boolean"


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of every window of ``width`` values."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    best, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(values[left] <= values[right], left, right)
        size += step
    return best[:count]


def seeds_of(hashes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Seeds of one text from its words' hashes: anchor, span, start of the first run, number of runs."""
    gram = min(gram, length)
    grams = gram_hashes(hashes, gram)
    chosen = _sliding_argmin(grams, length - gram + 1)
    start = np.flatnonzero(np.diff(chosen, prepend=-1))
    stop = np.append(start[1:], len(chosen))
    return {"anchor": grams[chosen[start]], "start": start, "runs": stop - start,
            "span": run_hashes(hashes, start, stop - 1 + length)}


def _combined(rows: dict[str, np.ndarray], keys: list[str]) -> dict[str, np.ndarray]:
    """Mark rows that have an equal and earlier row at hand; their place serves as key from then on."""
    order = np.lexsort((rows["start"], rows["tag"], rows["place"], *[rows[k] for k in reversed(keys)], rows["known"]))
    rows = {k: v[order] for k, v in rows.items()}
    same = np.ones(max(0, len(order) - 1), bool)
    for k in (*keys, "known"):
        same &= rows[k][1:] == rows[k][:-1]
    later = np.concatenate([np.zeros(min(1, len(order)), bool), same]) & ~rows["known"]
    rows["known"] = rows["known"] | later
    rows["anchor"] = np.where(rows["known"], rows["place"].view(np.uint64), rows["anchor"])
    rows["span"] = np.where(rows["known"], np.uint64(0), rows["span"])
    return rows


def _emitted(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    rows = {name: np.concatenate([h[name] for h in held]).astype(kind, copy=False) for name, kind in _SEED_TYPES}
    rows = _combined(rows, ["anchor", "span"])
    return pa.RecordBatch.from_arrays(
        [pa.array(rows["anchor"].view(np.int64)), pa.array(rows["span"].view(np.int64)), pa.array(rows["place"]),
         pa.array(rows["tag"]), *[pa.array(rows[k].astype(np.int32)) for k in ("start", "runs")], pa.array(rows["known"])],
        [name for name, _ in _SEED_TYPES])


def _hashes(text: bytes) -> np.ndarray:
    return word_hashes(text, *spans(text))


def _placed(found: dict[str, np.ndarray], place: int, tag: int) -> dict[str, np.ndarray]:
    count = len(found["start"])
    return {"known": np.zeros(count, bool)} | found | {
        "place": np.full(count, place, np.int64), "tag": np.full(count, tag, np.int64)}


def _seeds(docs: DataFrame, length: int) -> DataFrame:
    """Seeds of documents, whose text is in ``text`` or compressed in ``packed``."""
    column = "packed" if "packed" in docs.columns else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part, texts in pieces(batches, column):
            if column == "packed":
                texts = map(zstandard.decompress, texts)
            for text, place, tag in zip(texts, part.column("place").to_pylist(), part.column("tag").to_pylist()):
                hashes = _hashes(text)
                if len(hashes) >= length:
                    held.append(_placed(seeds_of(hashes, length), place, tag))
                    size += len(held[-1]["start"])
            if size >= FLUSH:
                yield _emitted(held)
                held, size = [], 0
        if held:
            yield _emitted(held)

    return docs.select(column, "place", "tag").mapInArrow(run, _SEED_SCHEMA)


def _open_runs(docs: DataFrame, length: int) -> DataFrame:
    """Every run of the seeds that are left open, as a seed of one run; documents carry them as a list ``open``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("packed", "place", "tag", "open")]
            for packed, place, tag, opened in zip(*columns):
                hashes = _hashes(zstandard.decompress(packed))
                found = seeds_of(hashes, length)
                at = np.searchsorted(found["start"], np.array(opened, np.int64))
                starts = np.concatenate([np.arange(found["start"][i], found["start"][i] + found["runs"][i])
                                         for i in at])
                held.append(_placed({
                    "anchor": np.repeat(found["anchor"][at], found["runs"][at]),
                    "span": run_hashes(hashes, starts, starts + length),
                    "start": starts, "runs": np.ones(len(starts), np.int64)}, place, tag))
                size += len(starts)
                if size >= FLUSH:
                    yield _emitted(held)
                    held, size = [], 0
        if held:
            yield _emitted(held)

    return docs.select("packed", "place", "tag", "open").mapInArrow(run, _SEED_SCHEMA)


_ORDER = ("place", "tag", "start")


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with ``known`` true for all but the first of equal ones."""
    together = rows.repartition("anchor", "span").sortWithinPartitions("anchor", "span", *_ORDER)
    rank = F.row_number().over(Window.partitionBy("anchor", "span").orderBy(*_ORDER))
    return together.withColumn("known", F.col("known") | (rank > 1))


def _packed(docs: DataFrame) -> DataFrame:
    """Documents with their text compressed, as it travels through a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for part, texts in pieces(batches):
            packed = pa.array([compressor.compress(t) for t in texts], pa.binary())
            rest = [part.column(i) for i in range(1, part.num_columns)]
            yield pa.RecordBatch.from_arrays([packed, *rest], ["packed", *part.schema.names[1:]])

    kept = docs.select("text", *[c for c in docs.columns if c != "text"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, f"packed binary, {schema}")


def located(docs: DataFrame, plain: bool) -> DataFrame:
    """Add ``place`` and ``tag``, which order documents and tell them apart.

    The place is the doc_id; rows without one come last.  Only where ids repeat or are missing the rows of one id are
    ordered by their text's hash, which is the tag; rows with the same id and the same text count as one document.
    """
    placed = docs.withColumn("place", F.coalesce("doc_id", F.lit(NO_ID)))
    return placed.withColumn("tag", F.lit(0).cast("bigint") if plain else F.xxhash64("text"))


def marked(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(place, tag, known, open) of documents with shared anchors.

    ``known`` lists seeds that are repeats from end to end, as structs of the first run's start and the number of runs;
    ``open`` lists the starts of the seeds that have to be extended.  There has to be one row for each place and tag.
    """
    seeds = session.materialise(_ranked(_seeds(docs, length)).select(
        "known", F.when(~F.col("known"), F.col("anchor")).alias("anchor"), *_ORDER,
        F.when(F.col("known"), F.col("runs")).alias("runs")), "seeds")
    # Each span has one row left that is not known, so two under an anchor are two spans.
    first = seeds.where("not known").select("anchor", *_ORDER)
    shared = session.materialise(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"),
                                 "anchors")
    opened = first.join(shared, "anchor").select("place", "tag", F.lit(None).alias("part"), F.col("start").alias("begin"))
    repeats = seeds.where("known").select("place", "tag", F.struct("start", "runs").alias("part"), F.lit(None).alias("begin"))
    return repeats.union(opened).groupBy("place", "tag").agg(
        F.collect_list("part").alias("known"), F.collect_list("begin").alias("open"))


def cut_rows(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(text, n_words, n_removed, row): ``without_repeats`` with the given columns, but for the text, in a struct."""
    payload = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_column])
    given = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text_column}`").alias("text"),
                        payload.alias("row"))
    plain = ids.plain(given)
    inner = located(given, plain)
    key = ["place", "tag"]
    # A repeated row would find its own seeds in its copy, so each document gives its seeds once.
    once = inner if plain else _packed(inner.select("text", *key)).dropDuplicates(key)
    marks = session.materialise(marked(once, length), "marks")
    waiting = marks.where(F.size("open") > 0).select(*key, "open")
    texts = _packed(inner.select("text", *key)).dropDuplicates(key)
    more = _ranked(_open_runs(texts.join(waiting, key), length)).where("known").groupBy(*key).agg(F.collect_list("start").alias("more"))
    full = _packed(inner.withColumn("missing", F.col("text").isNull()).drop("doc_id"))
    return _cut(full.join(marks.select(*key, "known"), key, "left").join(more, key, "left"), length)


def without_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeats cut out of the text, and n_words, n_removed (both bigint) added.

    A word goes if it lies in a run of ``length`` words whose words also start earlier: in a document with a smaller id or
    earlier in the same one, judged on the texts as given.  Rows with a null id count as last; rows of one id are ordered
    by a hash of their text, and equal rows are one document and share its result.  A null text stays null and has no
    words.  All other columns are returned as they are, but columns n_words and n_removed of the input are replaced; an
    empty table gives no rows.
    """
    cut = cut_rows(docs, length, id_column, text_column)
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    back = [F.col("text").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in kept]
    return cut.select(*back, "n_words", "n_removed")


def _cut(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                yield _cut_rows(batch.slice(first, 256), length)

    kind = docs.schema["row"].dataType.simpleString()
    return docs.select("packed", "missing", "known", "more", "row").mapInArrow(
        run, f"text string, n_words bigint, n_removed bigint, row {kind}")


def _cut_rows(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    texts, counts, removed = [], [], []
    columns = [batch.column(c).to_pylist() for c in ("packed", "missing", "known", "more")]
    for packed, missing, known, more in zip(*columns):
        text = zstandard.decompress(packed)
        starts, ends = spans(text)
        gone = covered(len(starts), [(k["start"], k["runs"]) for k in known or []] + [(m, 1) for m in more or []], length)
        texts.append(None if missing else without(text, starts, gone).decode())
        counts.append(len(starts))
        removed.append(int(gone.sum()))
    return pa.RecordBatch.from_arrays(
        [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), batch.column("row")],
        ["text", "n_words", "n_removed", "row"])


def covered(count: int, repeats: list[tuple[int, int]], length: int) -> np.ndarray:
    """Which of ``count`` words lie in a repeat; a repeat is its first run's start and its number of runs."""
    change = np.zeros(count + 1, np.int64)
    for start, runs in repeats:
        change[start] += 1
        change[start + runs - 1 + length] -= 1
    return np.cumsum(change)[:count] > 0


def without(text: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without some words and the separators behind them."""
    if not gone.any():
        return text
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    bounds = np.append(starts, len(text))
    kept, at = [], 0
    for low, high in zip(edges[0::2], edges[1::2]):
        kept.append(text[at:bounds[low]])
        at = bounds[high]
    return b"".join([*kept, text[at:]])
