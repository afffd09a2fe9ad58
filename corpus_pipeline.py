"""The operators as one corpus job: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capacast import session
from capacast.llm import ids, language, mixing, simhash, substrings, templates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: no letters, like no language, or no language likely enough.

    Rows are told apart by id and text; of equal ones that differ in language or source only, all go if one does.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    rows = language.from_documents(docs.withColumn("doc_id", key))
    found = language.identify(rows, language.fit(rows))
    rejected = session.materialise(
        found.where("not kept").select(F.col("id.doc_id").alias("id"), F.col("id.text_hash").alias("hash")).distinct(),
        "rejected")
    return docs.join(rejected, docs.doc_id.eqNullSafe(rejected.id) & (F.xxhash64(docs.text) == rejected.hash), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, one row of it if it is repeated.

    The kept ids are nearly as many as the documents, so they are never broadcast.
    """
    if ids.plain(docs):
        classes = simhash.near_duplicates(docs)
        return docs.join(classes.where("doc_id = component_id").select("doc_id").hint("merge"), "doc_id",
                         "left_semi").select(*docs.columns)
    rows = ids.numbered(docs)
    classes = simhash.near_duplicates(rows.select("number", "row.text"), "number")
    first = classes.where("doc_id = component_id").select(F.col("doc_id").alias("number"))
    return rows.join(first.hint("merge"), "number", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; a document that consists of nothing else goes."""
    cut = substrings.cut_rows(docs).where("n_removed = 0 or n_removed < n_words")

    def column(name: str) -> Column:
        given = F.col("text") if name == "text" else F.col("row").getField(name)
        if name == "n_chars":
            given = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(given).cast(docs.schema[name].dataType)
        return given.alias(name)

    return cut.select(*[column(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a question of the benchmark go."""
    return templates.decontaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in shuffled order."""
    return mixing.poisson_mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = session.configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = session.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
