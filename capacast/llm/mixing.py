"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capacast import session
from capacast.llm import ids
from capacast.operators.joins import join_unique
from capacast.operators.running import running

PIECE = 16.0
LONGEST = 80
BROADCAST_SOURCES = 10_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts."""
    digest = F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, power: float = 0.5,
          source_column: str = "source") -> DataFrame:
    """(source, rate): how often a document of the source is to be repeated on average.

    ``weights`` are the sources' target shares of the mixture, in any unit; a source without one gets none.  By default a
    share is in proportion to the source's number of documents raised to ``power``.  ``size`` is the mixture's expected
    number of documents over that of the input.  Rows without a source are a source of their own.
    """
    counts = session.materialise(
        docs.groupBy(F.col(source_column).alias("source")).agg(F.count(F.lit(1)).alias("n")), "sources")
    if weights is None:
        share = F.pow("n", F.lit(power))
    else:
        listed = reduce(lambda found, w: found.when(F.col("source") == w[0], float(w[1])), weights.items(),
                        F.when(F.lit(False), 0.0))
        share = F.coalesce(listed, F.lit(0.0))
    total, shares = counts.agg(F.sum("n"), F.sum(share)).first()
    scale = size * total / shares if shares else 0.0
    return counts.select("source", (F.lit(scale) * share / F.col("n")).alias("rate"))


def _table(rate: Column) -> tuple[Column, Column]:
    """Into how many draws a rate is split, and the cumulative distribution of each.

    A Poisson number is the sum of independent ones with a part of the mean each; means of 16 at most keep the
    distribution within ``LONGEST`` steps and exp() far from underflow.
    """
    draws = F.greatest(F.lit(1), F.ceil(rate / PIECE)).cast("int")
    mean = rate / draws
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return draws, F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST)), start, step, lambda state: state["cdf"])


def _told_apart(whole: DataFrame, key: Column) -> DataFrame:
    """Rows (column ``row``) with a ``tag``: null where the row has an id of its own, else the hash of the row and its
    number among equal rows.  Only rows whose ids are missing or repeated are sorted."""
    keyed = whole.withColumn("key", key)
    if ids.plain(keyed, "key"):
        return whole.withColumn("tag", F.lit(None).cast("string"))
    repeated = keyed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "key", F.lit(True).alias("again"))
    hashed = keyed.withColumn("hash", F.md5(F.to_json("row", {"ignoreNullFields": "false"})))
    marked = join_unique(hashed, repeated, "key", ["hash"], "left")
    shared = F.col("key").isNull() | F.coalesce("again", F.lit(False))
    plain = marked.where(~shared).select("row", F.lit(None).cast("string").alias("tag"))
    numbered = running(marked.where(shared).select("row", "hash"), ["hash"], [], {"number": ("sum", F.lit(1).cast("bigint"))})
    return plain.union(numbered.select("row", F.concat_ws("/", "hash", F.col("number").cast("string"))))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, power: float = 0.5,
                seed: str = "mix", id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """Every row as often as a Poisson number with its source's rate says, in globally shuffled order.

    Returns the columns of ``docs`` plus ``copy`` (from 1) and ``shuffle_key``; partitions, and the rows in them, are in
    the order of hashes of seed, id and copy.  Every row has a draw of its own: rows whose id is missing or repeated are told
    apart by a hash of all their columns, and equal rows by a number.  A rate of 0 leaves a source out; an empty table gives no rows.  Columns ``copy`` and ``shuffle_key`` of the input
    are replaced.

    The table of rates has a row for each source.  It is broadcast if it has ``BROADCAST_SOURCES`` rows at most
    (81 numbers each, so 7 MB), and joined by key otherwise.
    """
    draws, cdf = _table(F.col("rate"))
    table = rates(docs, weights, size, power, source_column).where("rate > 0").select(
        F.col("source").alias("mix_source"), draws.alias("draws"), cdf.alias("cdf"))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    source, key = F.col("row").getField(source_column), F.col("row").getField(id_column)

    def drawn(total: Column, k: Column) -> Column:
        u = F.when(F.col("tag").isNull(), unit(F.lit(seed), key, k)).otherwise(unit(F.lit(seed), key, F.col("tag"), k))
        return total + F.size(F.filter("cdf", lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), drawn)
    rows = _told_apart(whole, key)
    counted = rows.join(table, source.eqNullSafe(F.col("mix_source"))).select("row", "tag", count.alias("copies"))
    copied = counted.where("copies > 0").select("row", "tag", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    order = F.md5(F.concat_ws(
        "/", F.lit(seed), F.lit("order"), F.coalesce(key.cast("string"), F.lit("null")), F.col("tag"), F.col("copy")))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("copy", "shuffle_key")]
    keyed = copied.select(*kept, "copy", order.alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def oracle_sql(seed: str = "mix") -> str:
    """DuckDB form of ``poisson_mix(documents)`` with its defaults."""
    return f"""
WITH sized AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
     scale AS (SELECT sum(n) AS total, sum(pow(n, 0.5)) AS shares FROM sized),
     rated AS (SELECT source, total / shares * pow(n, 0.5) / n AS rate FROM sized, scale),
     split AS (SELECT source, greatest(1, ceil(rate / {PIECE})) AS draws, rate FROM rated),
     steps AS (
       SELECT source, k, sum(exp(-rate / draws + k * ln(rate / draws) - lgamma(k + 1)))
                OVER (PARTITION BY source ORDER BY k) AS cdf
       FROM split, (SELECT unnest(range(0, {LONGEST + 1})) AS k)),
     drawn AS (
       SELECT d.doc_id, d.source,
              ('0x' || substr(md5('{seed}/' || d.doc_id || '/' || i), 1, 13))::BIGINT / pow(2, 52) AS u
       FROM documents d JOIN split s ON d.source IS NOT DISTINCT FROM s.source,
            LATERAL (SELECT unnest(range(1, s.draws::BIGINT + 1)) AS i)),
     counted AS (
       SELECT d.doc_id, count(*) AS copies
       FROM drawn d JOIN steps c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u GROUP BY d.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c::INTEGER AS copy,
       md5('{seed}/order/' || d.doc_id || '/' || c) AS shuffle_key
FROM documents d JOIN counted USING (doc_id), LATERAL (SELECT unnest(range(1, copies + 1)) AS c)
"""
