import math
from collections import Counter

import pytest

from capacast.llm import mixing
from capacast.llm.queries import ORACLE_SQL, QUERIES
from tools.compare import connect, difference

from . import brute


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equal_to_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    name = "op10_poisson_mix"
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE_SQL[name]) == ""


def big(spark, n=6000):
    return spark.range(n).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, 'hot', concat('s', id % 4)) as source")


@pytest.mark.parametrize("broadcast", [True, False])
def test_counts_follow_the_distribution(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    docs = big(spark)
    mixed = mixing.poisson_mix(docs, {"hot": 1, "s0": 3, "s1": 36}, size=2.0)
    copies = Counter(r.doc_id for r in mixed.collect())
    sources = {r.doc_id: r.source for r in docs.collect()}
    sizes = Counter(sources.values())
    for source, weight in (("hot", 1), ("s0", 3), ("s1", 36)):
        rate = 2.0 * 6000 * weight / 40 / sizes[source]
        counts = [copies[d] for d, s in sources.items() if s == source]
        mean = sum(counts) / len(counts)
        variance = sum((c - mean) ** 2 for c in counts) / len(counts)
        assert abs(mean - rate) < 5 * math.sqrt(rate / len(counts))
        assert abs(variance / rate - 1) < 0.25
    assert not any(copies[d] for d, s in sources.items() if s in ("s2", "s3"))


def test_both_joins_agree(spark, monkeypatch):
    first = sorted(map(tuple, mixing.poisson_mix(big(spark, 500)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert first == sorted(map(tuple, mixing.poisson_mix(big(spark, 500)).collect()))
    assert first != sorted(map(tuple, mixing.poisson_mix(big(spark, 500), seed="another").collect()))


def test_order_is_shuffled(spark):
    keys = [r.shuffle_key for part in mixing.poisson_mix(big(spark, 2000)).rdd.glom().collect() for r in [*part]]
    assert len(set(keys)) == len(keys)
    for part in mixing.poisson_mix(big(spark, 2000)).select("shuffle_key").rdd.glom().collect():
        assert [r[0] for r in part] == sorted(r[0] for r in part)


def test_odd_rows_and_native_plan(spark):
    docs = brute.odd_documents(spark)
    mixed = mixing.poisson_mix(docs, size=30.0)
    assert mixed.columns == [c for c in docs.columns if c != "copy"] + ["copy", "shuffle_key"]
    found = mixed.collect()
    assert {r.doc_id for r in found} == {None, 1, 2, 3, 4, 5, 6, 7} and {r.source for r in found} == {None, "a", "b", "c"}
    fours = Counter(r.copy for r in found if r.doc_id == 4)
    assert fours[1] == 2 and min(fours.values()) == 1  # equal rows draw for themselves
    assert len({r.shuffle_key for r in found}) == len(found)
    assert mixing.poisson_mix(brute.empty_documents(spark)).count() == 0
    assert mixing.poisson_mix(docs, {"nowhere": 1.0}).count() == 0
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("missing, same", [("null", "'t'"), ("null", "concat('t', id)"), ("7L", "'t'"), ("7L", "concat('t', id)")])
def test_rows_without_ids_of_their_own_keep_their_rate(spark, missing, same):
    web = spark.range(1000).selectExpr(f"{missing} as doc_id", f"{same} as text", "'web' as source")
    book = spark.range(1000).selectExpr("id + 100 as doc_id", "'t' as text", "'book' as source")
    mixed = mixing.poisson_mix(web.union(book), {"web": 1.0, "book": 9.0}, size=1.0)
    counts = Counter(r.source for r in mixed.collect())
    for source, rate in (("web", 0.2), ("book", 1.8)):
        assert abs(counts[source] - 1000 * rate) < 3 * math.sqrt(1000 * rate)
    plain = mixing.poisson_mix(book, {"book": 9.0}, size=1.8)
    assert sorted((r.doc_id, r.copy) for r in plain.collect()) == sorted(
        (r.doc_id, r.copy) for r in mixed.collect() if r.source == "book")
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fifty_rows_without_ids_stay_in_the_mixture(spark):
    docs = spark.range(50).selectExpr("null as doc_id", "concat('t', id) as text", "'web' as source").union(
        spark.range(450).selectExpr("id as doc_id", "'t' as text", "'book' as source"))
    found = Counter(r.source for r in mixing.poisson_mix(docs, {"web": 0.1, "book": 0.9}).collect())
    assert abs(found["web"] - 50) < 3 * math.sqrt(50)
