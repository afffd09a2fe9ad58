"""Toxicity by compression distance.

One zstandard dictionary is trained on toxic and one on ordinary text: each is made of the byte stretches that its own class
holds often and the other hardly ever.  Every window of a text is compressed with both.  A window that gets shorter with the
toxic dictionary than with the ordinary one speaks for toxicity; how much so is calibrated on labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capacast.llm.labelled import held_out, logistic, logistic_score, sample_once, spread
from capacast.llm.words import pieces

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
SAMPLE, SAMPLE_CHARS = 4000, 1 << 14
GRAM = 6
LEAST = 8
PURITY = 25
DICTIONARY = 8192
WINDOW = 52
GAIN, LARGE_GAIN = 3, 5
FEATURES = 6
# In front of every window and in both dictionaries, so that each window has a match and is never stored as it is;
# behind it, as zstandard looks for no match in the last bytes.
FRONT, BACK = bytes(range(128, 160)), bytes(range(1, 10))


def windows(text: bytes) -> list[bytes]:
    """The text's words, lower case of A-Z, in windows of at most ``WINDOW`` bytes; a longer word is split.

    Below 64 bytes zstandard leaves all bytes without a match as they are, so lengths differ by matches only.
    """
    found, held, size = [], [], 0
    for word in text.lower().split():
        for part in [word] if len(word) <= WINDOW else [word[i:i + WINDOW] for i in range(0, len(word), WINDOW)]:
            if size + len(part) + 1 > WINDOW and held:
                found.append(b" ".join([FRONT, *held, BACK]))
                held, size = [], 0
            held.append(part)
            size += len(part) + 1
    if held:
        found.append(b" ".join([FRONT, *held, BACK]))
    return found


def _stretches(text: bytes) -> Iterator[tuple[bytes, ...]]:
    """Pieces of a text that begin and end at words of certain lengths, so that copies have the same ones."""
    held = []
    for word in text.lower().split():
        held.append(word)
        if len(word) % 4 == 0 or len(held) == 8:
            yield tuple(held)
            held = []
    if held:
        yield tuple(held)


def _grams(words: Counter) -> Counter:
    counts = Counter()
    for word, n in words.items():
        padded = b" " + word + b" "
        for i in range(len(padded) - GRAM + 1):
            counts[padded[i:i + GRAM]] += n
    return counts


def _content(words: Counter, wanted: set[bytes]) -> bytes:
    """Dictionary content: the most frequent stretches of wanted grams that add new ones, the best at the end."""
    stretches = Counter()
    for word, n in words.items():
        padded = b" " + word + b" "
        at, count = 0, len(padded) - GRAM + 1
        while at < count:
            last = at
            while last < count and padded[last:last + GRAM] in wanted:
                last += 1
            if last > at:
                stretches[padded[at:last - 1 + GRAM]] += n
            at = last + 1
    chosen, covered, size = [FRONT], set(), 0
    for stretch, _ in sorted(stretches.items(), key=lambda x: (-x[1], x[0])):
        grams = {stretch[i:i + GRAM] for i in range(len(stretch) - GRAM + 1)}
        if 2 * len(grams - covered) < len(grams):
            continue
        size += len(stretch) + 1
        if size > DICTIONARY:
            break
        covered |= grams
        chosen.append(stretch)
    return b"\0".join(reversed(chosen))


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray


class Distance:
    """Compresses windows with both dictionaries."""

    def __init__(self, model: Model):
        self.compressors = []
        for content in (model.ordinary, model.toxic):
            settings = zstandard.ZstdCompressionParameters.from_level(
                1, min_match=GRAM, strategy=zstandard.STRATEGY_LAZY, window_log=14, hash_log=13, chain_log=12,
                write_checksum=False, write_content_size=False, write_dict_id=False,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings))

    def gains(self, text: bytes) -> np.ndarray:
        """By how many bytes each window is shorter with the toxic dictionary."""
        ordinary, toxic = (c.compress for c in self.compressors)
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], np.int64)

    def features(self, text: bytes) -> list[float]:
        gains = self.gains(text)
        large = gains[gains >= GAIN]
        if not len(large):
            return [0.0] * FEATURES
        return [float(large.max()), float(np.log1p(len(large))), float(np.log1p(large.sum())),
                float(np.sqrt(len(large) / len(gains))), float(np.log1p((large >= LARGE_GAIN).sum())),
                float(np.sqrt(large.sum() / len(gains)))]


def train(texts: list[bytes], labels: list[int]) -> Model:
    """Dictionaries from the differences of the classes, then calibration on the same texts.

    Without both classes there is nothing to tell apart: the score is then the share of toxic texts (0 without any).
    """
    stretches = [set(), set()]
    for text, label in zip(texts, labels):
        stretches[label].update(_stretches(text))
    words = [Counter(), Counter()]
    for label in (0, 1):
        for stretch in stretches[label]:
            words[label].update(stretch)
    grams = [_grams(w) for w in words]
    ratio = len(stretches[1]) / max(1, len(stretches[0]))
    toxic = {g for g, n in grams[1].items() if n >= LEAST and grams[0][g] * ratio * PURITY < n}
    ordinary = {g for g, n in grams[0].items() if n * ratio >= LEAST and grams[1][g] * PURITY < n * ratio}
    model = Model(_content(words[1], toxic), _content(words[0], ordinary), np.zeros(FEATURES + 1))
    y = np.array(labels, float)
    if 0 < y.sum() < len(y):
        distance = Distance(model)
        model.weights = logistic(np.array([distance.features(t) for t in texts]), y)
    else:
        model.weights[-1] = 30.0 if y.sum() else -30.0
    return model


def training(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, label) of at most ``bound`` documents of each label that are not held out, one row an id.

    Of a text above ``chars`` characters, that many are taken from all over it; so is the size of the whole bounded.
    """
    cut = docs.select("doc_id", spread(F.coalesce("text", F.lit("")), chars).alias("text"))
    return sample_once(cut, labels, "toxic", FOLDS, HELD_OUT, bound)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Train on ``training`` rows, in their order, so that the layout of the tables does not matter."""
    texts, marks = [], []
    for row in training(docs, labels, bound, chars).toLocalIterator():
        texts.append(row.text.encode())
        marks.append(row.label)
    return train(texts, marks)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_toxic_windows) of every row, over its whole text.

    Null and empty texts have no window and get the score of a text in which no window points to toxicity.  Repeated rows
    are each scored; a null id is held out by no fold; other columns are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model)
        for part, texts in pieces(batches):
            gains = [distance.features(t) for t in texts]
            scores = logistic_score(np.array(gains), model.weights)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(scores), pa.array(np.rint(np.expm1([g[1] for g in gains])).astype(np.int64))],
                ["doc_id", "score", "n_toxic_windows"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, n_toxic_windows bigint").select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic_windows")
