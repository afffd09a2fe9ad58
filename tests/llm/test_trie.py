import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from capacast.llm import trie
from capacast.llm.queries import ORACLE_SQL, QUERIES
from tools.compare import connect, difference

TURNS = "conv_id bigint, turn bigint, role string, text string"


def sequences(rows):
    """Turns (role, text) in order by conversation."""
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            given[conv].append((turn is not None, turn or 0, tie, role, text))
    return {c: [t[3:] for t in sorted(listed)] for c, listed in given.items()}


def spliced(given):
    out = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = given.get(base, [])[:h] + own[h:]
    return out


def nodes_of(given):
    """All nodes as rows of the result, from a dictionary of prefixes."""
    members = defaultdict(list)
    for c, turns in given.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        n = len(members[path])
        own = (n - 1) * len(path[-1][1].encode()) if path else 0
        leaves = sum(below[k][0] for k in kids[path]) if kids[path] else 1
        below[path] = leaves, own + sum(below[k][1] for k in kids[path])
    rows = []
    for path, listed in members.items():
        ends = sorted(c for c in listed if len(given[c]) == len(path))
        rows.append((min(listed), len(path), min(members[path[:-1]]) if path else None, len(listed), len(kids[path]),
                     *below[path], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["0.01"])
def test_equal_to_sql(spark, sf):
    folder, name = f"/root/testdata/sf{sf}", "op12_prefix_trie"
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE_SQL[name]) == ""


def made(seed, conversations=60, longest=14, words=2):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            rows.append((c * rng.choice([1, 1, 1]) - 7, t, rng.choice(["user", "user", None]),
                         rng.choice(["a", "bé", "", None][:words])))
    return rows


@pytest.mark.parametrize("batches, words", [(1, 2), (2, 1), (4, 2)])
def test_random_conversations(spark, batches, words):
    rows = made(batches, words=words)
    found = trie.prefix_trie(spark.createDataFrame(rows, TURNS), batches)
    assert rows_of(found) == nodes_of(sequences(rows))


def test_spliced_conversations(spark):
    rows = made(11, conversations=80)
    rows = [r for r in rows if r[0] % 10 != 0 or r[0] == 20]  # some of the conversations to begin with are absent
    rows += [(203, 0, "user", "x"), (204, 0, "user", "y"), (213, 0, "user", "x")]
    found = trie.build(*trie.spliced(trie.ordered(spark.createDataFrame(rows, TURNS))))
    expected = spliced(sequences(rows))
    assert any(not t for t in expected.values()), "one conversation should be left without turns"
    assert rows_of(found) == nodes_of(expected)


def test_chains_and_copies(spark):
    """Every conversation is the beginning of the next, each occurs several times, and one is long."""
    rows = [(10 * n + k, t, "user", f"t{t}") for n in range(1, 20) for k in range(3) for t in range(n)]
    rows += [(5000, t, "user", f"t{t}" if t < 300 else "z") for t in range(700)]
    found = trie.prefix_trie(spark.createDataFrame(rows, TURNS), 3)
    assert rows_of(found) == nodes_of(sequences(rows))


def test_fattest(spark):
    pairs = [(a, b) for b in range(1, 70) for a in range(b)] + [((1 << 40) - 3, (1 << 40) + 5)]
    found = spark.createDataFrame(pairs, "low bigint, high bigint").select("low", "high", trie.fattest("low", "high")).collect()
    for low, high, fat in found:
        if high < 100:
            assert fat == max(range(low + 1, high + 1), key=lambda x: (x & -x, 0))
        else:
            assert fat == 1 << 40


def test_odd_rows(spark):
    rows = [(None, 1, "user", "ignored"), (1, None, None, None), (1, None, None, None), (1, 3, "user", "y" * 100_000),
            (2, 1, "", ""), (2, 1, "", ""), (3, 1, "user", "same turn"), (3, 1, "assistant", "same turn")]
    plain = spark.createDataFrame(rows, TURNS)
    extra = plain.select("*", *[F.lit(1).alias(c) for c in (
        "depth", "path", "content", "bytes", "up", "handle", "known", "above", "count", "smallest", "n_convs")])
    assert rows_of(trie.prefix_trie(extra)) == nodes_of(sequences(rows))
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    turnless = trie.build(trie.ordered(spark.createDataFrame([], TURNS)), spark.range(3).select(F.col("id").alias("conv_id")))
    assert rows_of(turnless) == nodes_of({0: [], 1: [], 2: []})
