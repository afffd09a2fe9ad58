"""Counts of lines and words of several texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from capacast.llm.words import gram_hashes, mix, spans, word_hashes

SYMBOLS = b"#*$%&|<>"
REPEAT = 5


def _bytes(listed: bytes | range | list[int]) -> np.ndarray:
    return np.isin(np.arange(256), list(listed))


_TAIL = _bytes(range(0x80, 0xC0))  # bytes of a character after its first
_CLASSES = {
    "symbols": _bytes(SYMBOLS),
    "upper": _bytes(range(65, 91)),
    "lower": _bytes(range(97, 123)),
    "digits": _bytes(range(48, 58)),
    "shouts": _bytes(b"!"),
    "marks": _bytes(b".,;:!?"),
}
_ENDS = _bytes(b".!?:;\"')")


def _per(group: np.ndarray, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    found = np.bincount(group, weights, minlength=count)
    return found if weights is not None else found.astype(np.int64)


def _first_seen(group: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether an element is the first with its key in its group."""
    order = np.lexsort((np.arange(len(keys)), keys, group))
    first = np.ones(len(keys), bool)
    first[order[1:]] = (group[order[1:]] != group[order[:-1]]) | (keys[order[1:]] != keys[order[:-1]])
    return first


@dataclass
class Stats:
    """By text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and counts of character classes.

    By line with a word, in order: its text, span, number of words, characters, distinct words, whether an equal line came
    earlier in the text, whether it ends a sentence, and counts of character classes.
    """

    doc: dict[str, np.ndarray]
    line: dict[str, np.ndarray]


def stats(texts: list[bytes]) -> Stats:
    raw = b"".join(t + b"\n" for t in texts)
    count = len(texts)
    data = np.frombuffer(raw, np.uint8)
    text_end = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1]) if len(line_end) else line_end
    starts, ends = spans(raw)
    word_line = np.searchsorted(line_end, starts, "right")
    used = np.unique(word_line)
    word_line = np.searchsorted(used, word_line)
    line_start, line_end = line_start[used], line_end[used]
    line_doc = np.searchsorted(text_end, line_start, "right")
    lines = len(used)
    hashes = word_hashes(raw, starts, ends)
    word_doc = line_doc[word_line]

    chars = np.concatenate([[0], np.cumsum(~_TAIL[data])])
    last_byte = np.maximum.reduceat(ends, np.searchsorted(word_line, np.arange(lines))) - 1 if lines else line_end
    line = {
        "doc": line_doc, "start": line_start, "end": line_end, "words": _per(word_line, lines),
        "chars": _per(word_line, lines, (chars[ends] - chars[starts]).astype(float)).astype(np.int64),
        "distinct": _per(word_line[_first_seen(word_line, hashes)], lines),
        "again": ~_first_seen(line_doc, word_hashes(raw, line_start, line_end)) if lines else np.zeros(0, bool),
        "ended": _ENDS[data[last_byte]],
    }
    doc = {
        "n_words": _per(word_doc, count),
        "word_chars": _per(word_doc, count, (chars[ends] - chars[starts]).astype(float)).astype(np.int64),
        "n_dup_lines": _per(line_doc[line["again"]], count),
        "n_repeat_words": _repeated(hashes, word_doc, count),
        "n_lines": _per(line_doc, count),
        "n_ended": _per(line_doc[line["ended"]], count),
        "n_distinct": _per(word_doc[_first_seen(word_doc, hashes)], count),
        "n_title": _per(word_doc[_CLASSES["upper"][data[starts]]], count),
    }
    bounds = np.concatenate([[0], text_end])
    for name, members in _CLASSES.items():
        running = np.concatenate([[0], np.cumsum(members[data])])
        line[name] = running[line_end] - running[line_start]
        doc[f"n_{name}"] = np.diff(running[bounds])
    return Stats(doc, line)


def _repeated(hashes: np.ndarray, word_doc: np.ndarray, count: int) -> np.ndarray:
    """By text: words in windows of ``REPEAT`` words that occur twice or more in the text."""
    grams = gram_hashes(hashes, REPEAT)
    at = np.flatnonzero(word_doc[:len(grams)] == word_doc[REPEAT - 1:]) if len(grams) else np.zeros(0, np.int64)
    keys = grams[at] + mix(word_doc[at].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + REPEAT, -1)
    return _per(word_doc[np.cumsum(change)[:-1] > 0], count)
