"""Quality by line labels: Viterbi decoding of a linear-chain conditional random field.

Each line with a word is labelled content or boilerplate from its own features and its neighbours' labels.  A document is
kept if enough of its words are in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capacast.llm.labelled import logistic, sample_once
from capacast.llm.textstats import Stats, stats
from capacast.llm.words import pieces

SAMPLE = 3000
CONTENT_SHARE = 0.5
ROUNDS, RUN, RUNS = 4, 128, 4
CONTENT, BOILERPLATE = 0, 1
MIN_WORDS = 10
REPEAT_PERCENT = 20
FEATURES = ("short", "long_words", "symbols", "shouts", "upper", "digits", "marks", "repeats", "again", "not_ended",
            "constant")


def line_features(found: Stats) -> np.ndarray:
    """One row of ``FEATURES`` for each line with a word, each between 0 and 1."""
    line = found.line
    words, chars = np.maximum(line["words"], 1), np.maximum(line["chars"], 1)
    letters = np.maximum(line["upper"] + line["lower"], 1)
    columns = [
        line["words"] < 5, np.minimum(chars / words, 20) / 20, np.minimum(line["symbols"] / words, 1),
        np.minimum(line["shouts"] / words, 1), np.clip(line["upper"] / letters, 0, 1), np.clip(line["digits"] / chars, 0, 1),
        np.minimum(line["marks"] / words, 1), 1 - line["distinct"] / words, line["again"], ~line["ended"],
        np.ones(len(words))]
    return np.column_stack([np.asarray(c, float) for c in columns])


@dataclass
class Model:
    """Scores of boilerplate over content by feature, and of going from one label to the next."""

    weights: np.ndarray = field(default_factory=lambda: np.array(
        [0.0, 0.0, 8.0, 8.0, 6.0, 4.0, 0.0, 6.0, 2.0, 0.5, -3.0]))
    moves: np.ndarray = field(default_factory=lambda: np.array([[1.0, -1.0], [-1.0, 1.0]]))


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of one sequence; scores are those of boilerplate, content has 0.  Ties go to content."""
    (stay, leave), (back, keep) = moves.tolist()
    content, boiler = 0.0, float(scores[0])
    origin = []
    for s in scores[1:].tolist():
        to_content = (content + stay, boiler + back)
        to_boiler = (content + leave, boiler + keep)
        origin.append((to_content[1] > to_content[0], to_boiler[1] > to_boiler[0]))
        content, boiler = max(to_content), max(to_boiler) + s
    labels = np.zeros(len(scores), np.int8)
    label = int(boiler > content)
    for i in range(len(scores) - 1, 0, -1):
        labels[i] = label
        label = int(origin[i - 1][label])
    labels[0] = label
    return labels


def decode(found: Stats, model: Model) -> np.ndarray:
    """Labels of all lines, text by text."""
    scores = line_features(found) @ model.weights
    bounds = np.flatnonzero(np.diff(found.line["doc"], prepend=-1))
    parts = [viterbi(s, model.moves) for s in np.split(scores, bounds[1:])] if len(scores) else []
    return np.concatenate(parts) if parts else np.zeros(0, np.int8)


def train(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = 150, penalty: float = 1e-3,
          start: Model | None = None) -> Model:
    """Weights of highest conditional likelihood, by gradient ascent over all sequences at once.

    Without lines of both labels the starting weights stay.
    """
    model = start or Model()
    used = [(x, y) for x, y in zip(sequences, labels) if len(x)]
    if len({int(label) for _, y in used for label in y}) < 2:
        return model
    sequences, labels = zip(*used)
    order = np.argsort([-len(x) for x in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    steps_of = [int((lengths > t).sum()) for t in range(lengths[0])]
    x = [np.array([sequences[i][t] for i in order[:n]]) for t, n in enumerate(steps_of)]
    y = [np.array([labels[i][t] for i in order[:n]]) for t, n in enumerate(steps_of)]
    total = lengths.sum()
    theta = np.concatenate([model.weights, model.moves.ravel()])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gradient = _gradient(theta, x, y, steps_of) / total - penalty * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient ** 2
        theta = theta + 0.15 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


@dataclass
class Lines:
    """A run of lines of a labelled document: features, words, whether each repeats an earlier line."""

    x: np.ndarray
    words: np.ndarray
    again: np.ndarray
    bad: bool


def bounded(labels: np.ndarray, scores: np.ndarray, lines: Lines, share: float = CONTENT_SHARE) -> np.ndarray:
    """Labels that agree with the document's own: at least ``share`` of the words of a good one are content, less of a bad
    one.  Lines change their label in the order of their scores, and only as many as it takes; repeated lines keep it."""
    labels = labels.copy()
    labels[lines.again] = BOILERPLATE
    order = np.argsort(-scores if lines.bad else scores, kind="stable")
    total = lines.words.sum()
    for i in order.tolist():
        content = lines.words[labels == CONTENT].sum()
        if (content < share * total) == lines.bad:
            break
        if not lines.again[i]:
            labels[i] = BOILERPLATE if lines.bad else CONTENT
    return labels


def learn(runs: list[Lines], rounds: int = ROUNDS) -> Model:
    """A field for lines from labels of documents, by turns of labelling and training.

    A first guess for lines of bad documents is whether a logistic model, which sees each line by itself, finds them unlike
    lines of good ones.  Then the field labels all lines, within what the documents' labels allow, and is trained on the
    result.
    """
    runs = [r for r in runs if len(r.x)]
    if len({r.bad for r in runs}) < 2:
        return Model()
    x = np.concatenate([r.x[:, :-1] for r in runs])
    from_bad = np.concatenate([np.full(len(r.x), r.bad) for r in runs]).astype(float)
    weights = logistic(x, from_bad)
    model, labels = Model(), []
    for r in runs:
        scores = r.x[:, :-1] @ weights[:-1] + weights[-1]
        labels.append(bounded((scores > 0).astype(np.int8) if r.bad else np.zeros(len(r.x), np.int8), scores, r))
    for turn in range(rounds):
        model = train([r.x for r in runs], labels, 150 if turn == 0 else 50, start=model)
        found = []
        for r in runs:
            scores = r.x @ model.weights
            found.append(bounded(viterbi(scores, model.moves), scores, r))
        if all((a == b).all() for a, b in zip(labels, found)):
            break
        labels = found
    return model


def _gradient(theta: np.ndarray, x: list[np.ndarray], y: list[np.ndarray], counts: list[int]) -> np.ndarray:
    """Observed minus expected features, by the forward and backward recursions."""
    weights, moves = theta[:-4], np.exp(theta[-4:].reshape(2, 2))
    node = [np.column_stack([np.ones(len(f)), np.exp(np.clip(f @ weights, -30, 30))]) for f in x]
    ahead = [node[0] / node[0].sum(1, keepdims=True)]
    for t in range(1, len(x)):
        step = (ahead[-1][:counts[t]] @ moves) * node[t]
        ahead.append(step / step.sum(1, keepdims=True))
    behind = np.ones((counts[-1], 2))
    slope, turns = np.zeros(len(weights)), np.zeros((2, 2))
    for t in range(len(x) - 1, -1, -1):
        chance = ahead[t] * behind
        chance /= chance.sum(1, keepdims=True)
        slope += (y[t] - chance[:, 1]) @ x[t]
        if t:
            after = node[t] * behind
            pair = ahead[t - 1][:counts[t], :, None] * moves[None] * after[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            np.add.at(turns, (y[t - 1][:counts[t]], y[t]), 1)
            turns -= pair.sum(0)
            before = after @ moves.T
            behind = np.ones((counts[t - 1], 2))
            behind[:counts[t]] = before / before.sum(1, keepdims=True)
    return np.concatenate([slope, turns.ravel()])


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, run_lines: int = RUN, runs: int = RUNS) -> Model:
    """Train on lines of at most ``bound`` documents of good and of bad quality; see ``learn``.

    One row of an id counts.  A document gives up to ``runs`` runs of ``run_lines`` lines, evenly spread over it.  Only line
    features of the sample reach the driver, at most bound * 2 * runs * run_lines rows of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            found = stats(texts)
            rows = line_features(found)
            marks = part.column("label").to_pylist()
            edges = np.searchsorted(found.line["doc"], np.arange(len(texts) + 1))
            taken = []
            for d, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                starts = np.arange(low, high, run_lines)
                for s in starts[np.unique(np.linspace(0, len(starts) - 1, min(runs, len(starts))).astype(int))].tolist():
                    taken.append((s, min(s + run_lines, high), marks[d] == 0))
            yield pa.RecordBatch.from_arrays([
                pa.array([rows[a:b].ravel().tolist() for a, b, _ in taken], pa.list_(pa.float64())),
                pa.array([found.line["words"][a:b].tolist() for a, b, _ in taken], pa.list_(pa.int64())),
                pa.array([found.line["again"][a:b].astype(bool).tolist() for a, b, _ in taken], pa.list_(pa.bool_())),
                pa.array([bad for _, _, bad in taken], pa.bool_())], ["x", "words", "again", "bad"])

    listed = []
    for row in sample_once(docs, labels, "quality", 1, -1, bound).mapInArrow(
            run, "x array<double>, words array<bigint>, again array<boolean>, bad boolean").toLocalIterator():
        listed.append(Lines(np.array(row.x).reshape(-1, len(FEATURES)), np.array(row.words, np.int64),
                            np.array(row.again, bool), row.bad))
    return learn(listed)


def judge(docs: DataFrame, model: Model, share: float = CONTENT_SHARE, with_text: bool = False,
          id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, line verdicts and decision of every row, over its whole text.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, content_share, kept,
    and with ``with_text`` the content lines as content_text.  A text fails the base rules with fewer than ``MIN_WORDS``
    words, or with more than ``REPEAT_PERCENT`` percent of them in repeated windows; others are kept if ``share`` of their
    words are in content lines.  Null and empty texts have no words and fail; their content share is 0.  Repeated rows
    are each judged; other columns are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            found = stats(texts)
            doc, line = found.doc, found.line
            good = decode(found, model) == CONTENT
            content = np.bincount(line["doc"], line["words"] * good, minlength=len(texts)).astype(np.int64)
            columns = [part.column(0), *[pa.array(doc[c]) for c in
                                         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                       pa.array(content)]
            if with_text:
                raw = b"".join(t + b"\n" for t in texts)
                lines = [[] for _ in texts]
                for d, a, b in zip(line["doc"][good], line["start"][good], line["end"][good]):
                    lines[d].append(raw[a:b].decode())
                columns.append(pa.array(["\n".join(x) for x in lines], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words"]
    names = ["doc_id", *counts, *(["content_text"] if with_text else [])]
    schema = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *[f"{c} bigint" for c in counts],
                        *(["content_text string"] if with_text else [])])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    content_share = F.when(F.col("n_words") > 0, F.col("content_words") / F.col("n_words")).otherwise(0.0)
    judged = rows.mapInArrow(run, schema).withColumn("base_failed", base).withColumn("content_share", content_share)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= share)).select(
        "doc_id", *counts[:5], "base_failed", "content_words", "content_share", "kept", *names[7:])
