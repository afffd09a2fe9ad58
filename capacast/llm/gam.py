"""Quality by a generalised additive model with pairwise interactions.

Cyclic boosting goes through the features in turn and adds a small tree on one feature at a time, then through the chosen
pairs of features.  A tree on one feature only changes that feature's lookup table, so the model is a table for each feature
and each pair, and a score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capacast.llm.labelled import held_out, sample_once
from capacast.llm.textstats import stats
from capacast.llm.words import pieces

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
SAMPLE = 6000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, RIDGE = 0.1, 1.0
FEATURES = ("log_words", "word_length", "symbols", "shouts", "upper", "digits", "marks", "distinct", "repeated",
            "dup_lines", "ended_lines", "line_length", "titles")


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` for each text; a text without words has zeros."""
    doc = stats(texts).doc
    words, chars = np.maximum(doc["n_words"], 1), np.maximum(doc["word_chars"], 1)
    lines, letters = np.maximum(doc["n_lines"], 1), np.maximum(doc["n_upper"] + doc["n_lower"], 1)
    return np.column_stack([
        np.log1p(doc["n_words"]), doc["word_chars"] / words, doc["n_symbols"] / words, doc["n_shouts"] / words,
        doc["n_upper"] / letters, doc["n_digits"] / chars, doc["n_marks"] / words, doc["n_distinct"] / words,
        doc["n_repeat_words"] / words, doc["n_dup_lines"] / lines, doc["n_ended"] / lines,
        np.log1p(doc["n_words"] / lines), doc["n_title"] / words])


@dataclass
class Model:
    """Bin edges by feature, the lookup tables of features and of pairs of (coarser) features, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    intercept: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[bins[i], bins[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl ** 2 / (hl + RIDGE) + gr ** 2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree with up to three leaves."""
    gain, cut = _best_split(g, h)
    if gain <= 1e-9:
        return np.zeros(len(g))
    left, right = _best_split(g[:cut], h[:cut]), _best_split(g[cut:], h[cut:])
    more = left[1] if left[0] >= right[0] else cut + right[1]
    bounds = sorted({0, cut, len(g), *([more] if max(left[0], right[0]) > 1e-9 else [])})
    out = np.zeros(len(g))
    for low, high in zip(bounds, bounds[1:]):
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features of a pair once."""
    best, values = 0.0, np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            parts = []
            for c in (cg, ch):
                parts.append([c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b],
                              c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b]])
            gs, hs = np.array(parts[0]), np.array(parts[1])
            gain = float((gs ** 2 / (hs + RIDGE)).sum())
            if gain > best + 1e-9:
                best, v = gain, gs / (hs + RIDGE)
                values = np.empty(g.shape)
                values[:a + 1, :b + 1], values[:a + 1, b + 1:], values[a + 1:, :b + 1], values[a + 1:, b + 1:] = v
    return best - float(g.sum() ** 2 / (h.sum() + RIDGE)), values


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables on features ``x`` and labels ``y``; without both labels the score is the share of label 1."""
    x = np.asarray(x, float).reshape(-1, len(FEATURES))
    share = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
    if not 0 < y.sum() < len(y):
        return Model([], [], [], [], [], float(np.log(share / (1 - share))))
    size = x.shape[1]
    model = Model([_edges(x[:, j], BINS) for j in range(size)], [], [_edges(x[:, j], PAIR_BINS) for j in range(size)],
                  [], [], float(np.log(share / (1 - share))))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)))
            table += step
            margin += step[bins[j]]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(size), 2), key=lambda p: -_quadrants(grid(*p, g), grid(*p, h))[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            margin += step[coarse[i], coarse[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Train on the features of at most ``bound`` documents of each label that are not held out, one row an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(features(texts).tolist(), pa.list_(pa.float64())), part.column("label")], ["x", "y"])

    rows = list(sample_once(docs, labels, "quality", FOLDS, HELD_OUT, bound).mapInArrow(
        run, "x array<double>, y int").toLocalIterator())
    rows.sort(key=lambda r: (r.y, r.x))  # the order of partitions must not matter
    return train(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, over its whole text.

    Null and empty texts have all features at zero and are scored like any other.  Repeated rows are each scored; a null id
    is held out by no fold; other columns are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(model.score(features(texts)))], ["doc_id", "score"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
