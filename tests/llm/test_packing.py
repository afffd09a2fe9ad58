import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from capacast.llm import packing, tokens
from capacast.llm.queries import QUERIES

from . import brute

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|>a b<|startoftext|> c", "it's He'S don't 'll x''s", "!'s !!'ll", "Éá áb ΑΣ ΑΣ. ß İ ﬁ", "a\x1cb \x85c d e", "", "  ",
       "1234 ab12cd 3.14", "a\x00b \x0bz\x0cq", " ́a", "\U0001F600!! –!? «x»", "<b>hi</b> a|b|c", "A.B.C", "日本語 テスト 。x",
       "0x1F ½ ²", "ÉÀ×÷ß ÞÿŸ É́a È", "Ãx à", "tab\tnew\nline\r\nend", "x" * 500, "É́ é́", " nb sp"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return tokens.Encoder(file.read())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_are_those_of_the_tokenizer(spark, tokenizer, encoder):
    texts = [r.text for r in brute.sample_documents(spark).select("text").collect()] + ODD
    found = encoder.encode([t.encode() for t in texts])
    for text, ids in zip(texts, found):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_random_texts(tokenizer, encoder):
    rng = random.Random(4)
    alphabet = "abAB 12'.,<|>ßéÉ́×Ã 日–\n\t\x1c" + "ΣşİK"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_full_store_starts_anew(tokenizer):
    with open(PATH, encoding="utf-8") as file:
        small = tokens.Encoder(file.read(), cached=50)
    texts = [f"alpha{i} beta {i} gämma{i % 7}" for i in range(400)]
    for at in range(0, 400, 40):
        for text, ids in zip(texts[at:at + 40], small.encode([t.encode() for t in texts[at:at + 40]])):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def greedy(sizes, length):
    """Gaps of all sequences by the rule itself: every choice's sum of squares is computed from scratch."""
    gaps = []
    for size in sizes:
        def cost(choice):
            after = gaps + [length] if choice == len(gaps) else list(gaps)
            after[choice] -= size
            return sum(sum(g == x for g in after) ** 2 for x in set(after) if 0 < x)
        choices = [i for i, g in enumerate(gaps) if g >= size]
        best = min([*choices, len(gaps)], key=lambda i: (cost(i), i == len(gaps), gaps[i] if i < len(gaps) else 0))
        if best == len(gaps):
            gaps.append(length)
        gaps[best] -= size
    return gaps


def test_the_rule(encoder):
    rng = random.Random(1)
    for length, count in ((10, 60), (25, 60), (6, 40)):
        sizes = [rng.randint(1, length) for _ in range(count)]
        sequences, offsets, gaps = packing.place(np.array(sizes), length)
        assert sorted(gaps.tolist()) == sorted(greedy(sizes, length))
        filled = defaultdict(int)
        for size, s, at in zip(sizes, sequences.tolist(), offsets.tolist()):
            assert at == filled[s]
            filled[s] += size


def packed_rows(spark, docs, **options):
    return packing.pack(docs, PATH, **options).collect()


def verify(rows, given, tokenizer, length):
    """Every document's ids are there once and in order, and no sequence has a hole or an overlap."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for placed in by_sequence.values():
        end = 0
        for offset, size in sorted(placed):
            assert offset == end
            end += size
        assert end <= length
    found = []
    for listed in by_doc.values():
        parts = sorted(listed, key=lambda r: r.piece)
        if [r.piece for r in parts] == list(range(len(parts))):
            assert [r.start for r in parts] == [length * i for i in range(len(parts))]
            assert all(r.length == length for r in parts[:-1])
            found.append(list(array("I", b"".join(r.ids for r in parts))))
    expected = [ids_of(tokenizer, t) for t in given]
    if len(found) == len(expected):
        assert sorted(found) == sorted(expected)
    assert sum(r.length for r in rows) == sum(map(len, expected))
    return len(by_sequence)


@pytest.mark.parametrize("length, shard", [(4096, 1 << 16), (64, 1 << 16), (64, 100), (256, 40)])
def test_whole_result(spark, tokenizer, length, shard):
    docs = brute.sample_documents(spark, "/root/testdata/sf0.001")
    rows = packed_rows(spark, docs, length=length, shard=shard)
    texts = [r.text for r in docs.collect()]
    used = verify(rows, texts, tokenizer, length)
    total = sum(len(ids_of(tokenizer, t)) for t in texts)
    assert used <= 1.1 * total / length + 4


def test_query(spark, tokenizer):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op13_packing"](spark, folder)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    total, used = found.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert used <= 1.02 * total / 4096
    crc = {r.doc_id: r.ids_crc32 for r in found.where("piece = 0 and length < 4096").collect()}
    for r in brute.sample_documents(spark).select("doc_id", "text").collect():
        if r.doc_id in crc:
            assert crc[r.doc_id] == zlib.crc32(np.array(ids_of(tokenizer, r.text), "<u4").tobytes())


def test_odd_rows(spark, tokenizer):
    docs = brute.odd_documents(spark)
    rows = packed_rows(spark, docs, length=128)
    verify(rows, [r.text for r in docs.collect()], tokenizer, 128)
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7}
    assert packed_rows(spark, brute.empty_documents(spark)) == []
    whole = spark.createDataFrame([(1, "a " * 15)], "doc_id bigint, text string")
    assert [(r.length, r.offset) for r in packed_rows(spark, whole, length=8)] == [(8, 0), (8, 0)]
    clashing = spark.createDataFrame([(1, "x", 2, 3, 4)], "doc_id bigint, text string, key int, piece int, shard int")
    assert [r.length for r in packed_rows(spark, clashing)] == [2]
