"""Plain single-process versions of what the operators compute, and odd rows to feed them."""

import itertools
import re
from collections import Counter

import xxhash

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text):
    tokens = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(text)]
    if not tokens:
        return 0
    grams = [" ".join(tokens[i:i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(keys, near):
    """Smallest member reachable over pairs that are near, by member."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(keys), 2):
        if near(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def components(rows):
    """component_id by doc_id for (doc_id, text) rows."""
    prints = {}
    for doc_id, text in rows:
        prints.setdefault(simhash(text), []).append(doc_id)
    roots = groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    lowest = {}
    for p, ids in prints.items():
        lowest[roots[p]] = min([*ids, *([lowest[roots[p]]] if roots[p] in lowest else [])])
    return {d: (f"{p:016x}", lowest[roots[p]]) for p, ids in prints.items() for d in ids}


def kept_words(rows, length=20):
    """(number of words, kept words) by doc_id: words of repeated runs go unless the run is its first occurrence."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        tokens = words(text)
        gone = [False] * len(tokens)
        for i in range(len(tokens) - length + 1):
            run = tuple(tokens[i:i + length])
            if run in seen:
                gone[i:i + length] = [True] * length
            seen.add(run)
        out[doc_id] = (len(tokens), [t for t, g in zip(tokens, gone) if not g])
    return out


def base_counts(text):
    tokens = words(text)
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    grams = [tuple(tokens[i:i + 5]) for i in range(len(tokens) - 4)]
    counts, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            inside.update(range(i, i + 5))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(tokens), sum(map(len, tokens)), symbols, again, len(inside)


def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 3), (None, "Text without an id", "en", "a", 1),
        (4, "Plain words in one line.", "en", None, None), (4, "Plain words in one line.", "en", None, None),
        (5, long, "en", "b", len(long)), (5, "Another text with the same id", "de", "b", 1), (None, None, None, None, None),
        (6, "Zero width  spaces \x85 and\x1cothers", "en", "b", 1), (7, "\U0001F600 " * 40, "xx", "c", 80),
    ]
    extra = ("copy int, row string, rank int, fp string, span string, place string, tag string, known string, hash string, "
             "text_hash string, score string, label string, held_out string, copies string, mix_source string, draws int, "
             "leak_id int, leak_hash string, n_words int, n_removed string, row_number int, number int, known_too int, "
             "component_id int, missing int, packed int, n_matched int, kept int, declared int, host int, `again` int, key int")
    ddl = f"{DOCUMENTS}, {extra}"
    kinds = [c.split()[1] for c in extra.split(",")]
    filled = tuple(7 if kind == "int" else "7" for kind in kinds)
    return spark.createDataFrame([r + (filled if i else (None,) * len(kinds)) for i, r in enumerate(rows)], ddl)


def empty_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def sample_documents(spark, folder="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{folder}/documents.parquet")
