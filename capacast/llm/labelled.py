"""Bounded samples of labelled documents, and small fits on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capacast.operators.selection import mark_lowest


def held_out(id_column: Column, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` documents of each label that are not held out.

    Labels 0 and 1 count, of a repeated id the higher one; which documents are taken follows a hash of the id, without
    bringing the rows of a label together.  The ids are picked on ``labels`` alone and broadcast, which the bound allows;
    of documents with one id each is taken.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("label")).where(~held_out(F.col("doc_id"), modulus, remainder))
    picked = mark_lowest(usable, ["label"], ["doc_id"], F.least(F.lit(bound), F.col("_n")), "picked", label).where(
        "picked").select(F.col("doc_id").alias("labelled_id"), "label")
    return docs.select("doc_id", "text").join(
        F.broadcast(picked), F.col("doc_id") == F.col("labelled_id")).select("text", "label")


def sample_once(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, bound: int) -> DataFrame:
    """``sample`` with one row for each id, that of the smallest text hash, in the order of label and id.

    Each task passes on one row of an id, so an id that many rows share sends few of them.
    """
    taken = sample(docs.withColumn("text", F.struct(F.xxhash64("text").alias("hash"), "text", "doc_id")), labels, label,
                   modulus, remainder, bound)
    once = taken.groupBy("label", F.col("text.doc_id").alias("doc_id")).agg(F.min("text").alias("first"))
    return once.orderBy("label", "doc_id").select("first.text", "label")


def spread(text: Column, limit: int, parts: int = 8) -> Column:
    """A text of more than ``limit`` characters as that many in evenly spread parts, joined by blanks; others as they are."""
    size = limit // parts
    room = F.char_length(text).cast("bigint") - size
    cuts = [F.substr(text, (1 + room * i / (parts - 1)).cast("int"), F.lit(size)) for i in range(parts)]
    return F.when(F.char_length(text) > limit, F.concat_ws(" ", *cuts)).otherwise(text)


def logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, the last one being the intercept."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (labels - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic_score(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -30, 30)))
