"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capacast import session
from capacast.llm import (
    gam, infill, language, licences, linecrf, mixing, packing, roles, simhash, substrings, templates, toxicity,
    trie,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session.configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return linecrf.judge(docs, linecrf.fit(docs, table(spark, folder, "labels")))


def op2_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the items that they hold.  Rows of one item_class stand for all pairs of its doc_ids and item_ids."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return templates.leaks(docs, items, every_item=True).drop("text_hash")


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = substrings.without_repeats(docs)
    separated = F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")
    kept = F.trim(F.regexp_replace(separated, " +", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op4_language_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and pages together.  Pages have ids of their own: they appear as -1 - page_id in doc_id."""
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    rows = language.from_documents(docs).unionByName(
        language.from_pages(pages).withColumn("id", -1 - F.col("id")))
    found = language.identify(rows, language.fit(rows))
    return found.withColumnRenamed("id", "doc_id").withColumn(
        "page_id", F.when(F.col("doc_id") < 0, -1 - F.col("doc_id")))


def op5_licence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licences.recognise(table(spark, folder, "documents"))


def op6_compression_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op7_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_role_repair(spark: SparkSession, folder: str) -> DataFrame:
    return roles.repair(table(spark, folder, "conversations"))


def op9_additive_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return gam.score(docs, gam.fit(docs, table(spark, folder, "labels")))


def op10_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, folder, "documents"))


def op11_infill(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, folder, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.build(*trie.spliced(trie.ordered(table(spark, folder, "conversations"))))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_crf": op1_line_crf,
    "op2_template_leaks": op2_template_leaks,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_fusion": op4_language_fusion,
    "op5_licence_rules": op5_licence_rules,
    "op6_compression_toxicity": op6_compression_toxicity,
    "op7_simhash_components": op7_simhash_components,
    "op8_role_repair": op8_role_repair,
    "op9_additive_quality": op9_additive_quality,
    "op10_poisson_mix": op10_poisson_mix,
    "op11_infill": op11_infill,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op5_licence_rules": licences.oracle_sql(),
    "op10_poisson_mix": mixing.oracle_sql(),
    "op11_infill": infill.oracle_sql(),
    "op12_prefix_trie": trie.oracle_sql(),
}
