"""Token ids of whole texts by a public tokenizer file, for use inside tasks.

The tokenizer drops white space and never joins what white space parts, so the ids of a text are those of its units in
order.  A unit is a run of lower-cased letters of Latin-1, one digit or a run of other ASCII characters; a stretch between
blanks that holds anything else (other alphabets, apostrophes, the start of a special token) is one unit as it stands.  Units are
found and hashed by numpy, and only units that a task has not met before go through the tokenizer.
"""

from __future__ import annotations

import json

import numpy as np

from capacast.llm import words

# Which bytes the tokenizer's pattern tells apart.
LETTER, DIGIT, SIGN, BLANK, OTHER = range(5)
CACHED = 1 << 20


def _classes() -> np.ndarray:
    kinds = np.full(256, SIGN, np.uint8)
    kinds[0x80:] = OTHER
    kinds[list(b"'<")] = OTHER
    kinds[:0x20] = OTHER  # control characters, some of which the tokenizer takes for blanks and some not
    kinds[list(b" \t\n\r")] = BLANK
    kinds[ord("A"):ord("Z") + 1] = kinds[ord("a"):ord("z") + 1] = LETTER
    kinds[ord("0"):ord("9") + 1] = DIGIT
    return kinds


_KINDS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def units(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (lower-cased where that is all that the tokenizer does to them), start and end of every unit, and whether it is
    to be encoded as it stands."""
    data = np.frombuffer(raw, np.uint8)
    kinds, lower = _KINDS[data], _LOWER[data]
    # U+00C0 to U+00FF are 0xC3 and a second byte, and letters but for two signs.
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second != 0x97) & (second != 0xB7)]
    kinds[lead] = kinds[lead + 1] = LETTER
    lower[lead + 1] += np.where(data[lead + 1] < 0x9F, 0x20, 0).astype(np.uint8)
    blank = kinds == BLANK
    # Stretches between blanks that hold a byte of the class OTHER stay whole.
    stretch = np.cumsum(np.concatenate([[False], blank[:-1]]) | blank) if len(data) else np.zeros(0, np.int64)
    odd = np.zeros(int(stretch[-1]) + 1 if len(data) else 0, bool)
    odd[stretch[kinds == OTHER]] = True
    whole = odd[stretch] & ~blank
    kinds = np.where(whole, OTHER, kinds)
    fresh = np.ones(len(data), bool)
    fresh[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(data))
    kept = ~blank[starts]
    starts, ends = starts[kept], ends[kept]
    return np.where(whole, data, lower), starts, ends, whole[starts]


class Encoder:
    """Ids of texts, with a bounded store of the units met so far."""

    def __init__(self, text: str, cached: int = CACHED):
        """``text`` is the content of a tokenizer file."""
        from tokenizers import Tokenizer

        spec = json.loads(text)
        self.full = Tokenizer.from_str(text)
        # Units in lower-cased letters need no normalisation and no pattern, only the merges.
        self.plain = Tokenizer.from_str(json.dumps(spec | {
            "normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
                {"type": "WhitespaceSplit"},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}))
        suffix = spec["model"].get("end_of_word_suffix") or ""
        if not suffix:
            raise ValueError("the tokenizer does not mark the ends of words")
        vocabulary = spec["model"]["vocab"]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
        self.cached = cached
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, listed: list[bytes], whole: np.ndarray) -> None:
        """Encode units that are not stored yet; ``keys`` are in order."""
        counts = np.zeros(len(keys), np.int64)
        plain = np.flatnonzero(~whole)
        parts, order = [], []
        if len(plain):
            text = b" ".join([listed[i] for i in plain.tolist()]).decode()
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(plain):
                raise ValueError("the tokenizer's words are not the units of the text")
            counts[plain] = np.diff(ends, prepend=0)
            parts.append(ids)
            order.append(plain)
        odd = np.flatnonzero(whole)
        found = [e.ids for e in self.full.encode_batch_fast(
            [listed[i].decode() for i in odd.tolist()], add_special_tokens=False)]
        counts[odd] = [len(f) for f in found]
        parts.append(np.array([i for f in found for i in f], np.uint32))
        order.append(odd)
        order = np.concatenate(order)
        at = np.zeros(len(keys), np.int64)
        at[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate([self.ids, *parts])
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, at)
        self.counts = np.insert(self.counts, place, counts)

    def _piece(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of units, and how many each has."""
        low = starts[0]
        raw = data[low:ends[-1]].tobytes()
        hashes = words.word_hashes(raw, starts - low, ends - low) ^ whole.astype(np.uint64)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.cached:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if new.any():
            where = first[new]
            listed = [raw[a:b] for a, b in zip((starts[where] - low).tolist(), (ends[where] - low).tolist())]
            self._learn(keys[new], listed, whole[where])
            place = np.searchsorted(self.keys, keys)
        at, counts = self.at[place][inverse], self.counts[place][inverse]
        total = np.cumsum(counts)
        gather = np.repeat(at - (total - counts), counts) + np.arange(total[-1])
        return self.ids[gather], counts

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        raw = b"\n".join(texts)
        data, starts, ends, whole = units(raw)
        ids, counts, first = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + words.PIECE, "right")))
            found, each = self._piece(data, starts[first:last], ends[first:last], whole[first:last])
            ids.append(found)
            counts.append(each)
            first = last
        ids, total = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        edges = np.cumsum([0, *[len(t) + 1 for t in texts]])
        cuts = total[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
