"""Language identification by Bayesian fusion of evidence.

For every row the likelihood of its text under each language (hashed byte trigrams) is combined with how often rows of a
language declare what this row declares, and with a prior of its address.  The prior comes from counts over all rows,
grouped by host, and is smoothed towards the domain's, that towards the suffix's, and that towards the whole table's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capacast import session
from capacast.llm.words import pieces
from capacast.operators.joins import join_unique
from capacast.operators.selection import mark_lowest

SAMPLE = 1500
LEAST = 5
BITS = 14
SMOOTHING = 0.5
DISCOUNT = 0.3  # neighbouring trigrams overlap, so they are not as much evidence as independent ones
PRIOR_ROWS = 20.0
SURE = 0.6
UNKNOWN = "und"
BROADCAST_ROWS = 4_000_000

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of every trigram with two letters or more, and the text that it is in."""
    raw = b"".join(b" %b " % t for t in texts)
    folded = _FOLD[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    if len(folded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = (folded != 32).astype(np.int8)
    at = np.flatnonzero(letters[:-2] + letters[1:-1] + letters[2:] >= 2)
    code = folded[at] | folded[at + 1] << np.uint32(8) | folded[at + 2] << np.uint32(16)
    hashed = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    ends = np.cumsum([len(t) + 2 for t in texts])
    return hashed.astype(np.int64), np.searchsorted(ends, at, "right")


@dataclass
class Model:
    """Languages in alphabetical order and log probabilities of the buckets by language."""

    languages: list[str]
    table: np.ndarray

    def likelihoods(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams by text, and by text and language the sum of their log probabilities."""
        hashed, text = buckets(texts)
        counts = np.bincount(text, minlength=len(texts))
        sums = [np.bincount(text, self.table[hashed, i], minlength=len(texts)) for i in range(len(self.languages))]
        return counts, np.column_stack(sums) if sums else np.zeros((len(texts), 0))


def fit(rows: DataFrame, bound: int = SAMPLE) -> Model:
    """Train on at most ``bound`` rows for each declared language (columns id, text, declared).

    A language needs ``LEAST`` rows that declare it.  Only the counts of 2**14 buckets by language reach the driver, 128 KB
    a language.  The picked ids are broadcast if languages times ``bound`` is at most ``BROADCAST_ROWS``, and shuffled beyond.
    """
    known = rows.where("declared <> '' and id is not null").select("id", "declared").distinct()
    picked = mark_lowest(known, ["declared"], ["id"], F.least(F.lit(bound), F.col("_n")), "picked").where("picked")
    enough = picked.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    languages = sorted(r.declared for r in enough.collect())
    chosen = picked.where(F.col("declared").isin(languages)).select("id", "declared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part, texts in pieces(batches):
            hashed, text = buckets(texts)
            declared = np.array(part.column("declared").to_pylist(), object)
            for language in set(declared.tolist()):
                found = np.bincount(hashed[(declared == language)[text]], minlength=1 << BITS)
                counts[language] = counts.get(language, 0) + found
        for language, found in counts.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(used), pa.string()), pa.array(used), pa.array(found[used])],
                ["language", "bucket", "n"])

    chosen = F.broadcast(chosen) if len(languages) * bound <= BROADCAST_ROWS else chosen
    counted = rows.join(chosen, ["id", "declared"]).select("text", "declared").mapInArrow(
        run, "language string, bucket bigint, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((1 << BITS, len(languages)), SMOOTHING)
    for row in counted.toLocalIterator():
        table[row.bucket, languages.index(row.language)] += row.n
    return Model(languages, np.log(table / table.sum(0)) if languages else table)


def _arrays(counts: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n): counts by key and language (its position in ``best``, or null) as one array for each key.

    The expression is the same for any number of languages.
    """
    listed = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(
        F.when(F.col("best").isNotNull(), F.struct("best", "rows")))).alias("_rows"))
    return listed.select(key, F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_rows", i), F.lit(0)).cast("double")).alias("n"))


def _row_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """How many rows of each key look like each language."""
    return rows.groupBy(*keys, "best").agg(F.count(F.lit(1)).alias("rows"))


def _smooth() -> Column:
    """The counts ``n`` plus ``PRIOR_ROWS`` rows spread like the prior ``above``, as shares."""
    total = F.aggregate("n", F.lit(0.0), lambda a, x: a + x)
    return F.zip_with("n", "above", lambda n, p: (n + PRIOR_ROWS * p) / (total + PRIOR_ROWS))


def _below(counts: DataFrame, parents: DataFrame, parent_key: str, key: str) -> DataFrame:
    """Priors by key from counts and the priors of the next level up."""
    return counts.join(parents.withColumnRenamed("prior", "above"), parent_key).select(key, _smooth().alias("prior"))


def _domain(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]+\.[^.]+$|^[^.]*$", 0)


def _suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """(id, language, probability, declared, n_trigrams, kept) of every row of (id, text, declared, host).

    declared and host may be empty strings; null counts as empty.  Rows are kept unless no language reaches ``SURE``, the
    text has no letters, or trigrams drawn at random would explain it better than any language; their language is then
    "und".  Ties go to the language first in the alphabet.  Null and empty texts have no letters.  Repeated rows are each
    identified; an empty table, or one where no language is declared, gives "und" for all rows.
    """
    size = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            counts, sums = model.likelihoods(texts)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i) for i in range(1, 4)], pa.array(counts.astype(np.int64)),
                 pa.array(sums.tolist(), pa.list_(pa.float64()))], ["id", "declared", "host", "n", "likelihood"])

    given = rows.select("text", "id", F.coalesce("declared", F.lit("")).alias("declared"),
                        F.coalesce("host", F.lit("")).alias("host"))
    schema = f"id {given.schema['id'].dataType.simpleString()}, declared string, host string, n bigint, " \
             "likelihood array<double>"
    read = given.mapInArrow(run, schema)
    if not size:
        return read.select("id", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("probability"), "declared",
                           F.col("n").alias("n_trigrams"), F.lit(False).alias("kept"))
    best = F.array_position("likelihood", F.array_max("likelihood")).cast("int") - 1
    scored = session.materialise(read.withColumn("best", F.when(F.col("n") > 0, best)), "likelihoods")

    totals = np.zeros(size)
    for row in _row_counts(scored).where("best is not null").collect():  # a row for each language
        totals[row.best] = row.rows
    declared = session.materialise(_arrays(_row_counts(scored, "declared"), "declared", size), "declared")
    kinds = declared.count()
    said = declared.select("declared", F.zip_with(
        "n", F.lit(totals + kinds), lambda n, total: F.log((n + 1) / total)).alias("said"))
    everywhere = F.lit((totals + 1) / (totals.sum() + size))
    by_host = session.materialise(_row_counts(scored, "host"), "hosts")
    hosts = by_host.withColumn("domain", _domain(F.col("host"))).withColumn("suffix", _suffix(F.col("host")))

    def summed(key: str) -> DataFrame:
        return _arrays(hosts.groupBy(key, "best").agg(F.sum("rows").alias("rows")), key, size)

    suffixes = summed("suffix").withColumn("above", everywhere).select("suffix", _smooth().alias("prior"))
    domains = _below(summed("domain").withColumn("suffix", _suffix(F.col("domain"))), suffixes, "suffix", "domain")
    by_name = _arrays(by_host, "host", size).withColumn("domain", _domain(F.col("host")))
    priors = _below(by_name, domains, "domain", "host")

    # Rows without ids are spread by what their texts gave.
    salt = ["id", "n", "likelihood"]
    joined = join_unique(join_unique(scored, said, "declared", salt), priors, "host", salt)
    texts_and_said = F.zip_with("likelihood", "said", lambda text, given: DISCOUNT * text + given)
    votes = F.zip_with(texts_and_said, "prior", lambda vote, prior: vote + F.log(prior))
    fused = joined.withColumn("votes", votes).withColumn("top", F.array_max("votes"))
    chance = 1 / F.aggregate("votes", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    name = F.element_at(F.lit(model.languages), F.array_position("votes", F.col("top")).cast("int"))
    noise = F.col("n") * F.lit(-BITS * np.log(2.0))
    kept = (F.col("n") > 0) & (chance >= SURE) & (F.array_max("likelihood") > noise)
    return fused.select(
        "id", F.when(kept, name).otherwise(UNKNOWN).alias("language"), F.round(chance, 6).alias("probability"),
        "declared", F.col("n").alias("n_trigrams"), kept.alias("kept"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as rows for ``identify``: the source stands for the host, the table's language is the declared one."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.lower(F.col("lang")).alias("declared"),
                       F.col("source").alias("host"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Web pages as rows for ``identify``: visible text, language of the markup, host of the address."""
    hidden = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?[a-zA-Z0-9]+;"
    return pages.select(
        F.col("page_id").alias("id"), F.regexp_replace("html", hidden, " ").alias("text"),
        F.lower(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)).alias("declared"),
        F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)).alias("host"))
