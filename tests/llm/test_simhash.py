import random

import pytest

import corpus_pipeline
from capacast import session
from capacast.llm import simhash
from capacast.llm.components import components
from capacast.llm.queries import QUERIES

from . import brute


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_quads_cover_any_five_positions_once():
    import itertools
    assert len(simhash.QUADS) == 14
    for five in itertools.combinations(range(8), 5):
        assert sum(set(q) <= set(five) for q in simhash.QUADS) == 1


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in brute.sample_documents(spark).select("doc_id", "text").collect()]
    found = {r.doc_id: (r.fingerprint, r.component_id)
             for r in QUERIES["op7_simhash_components"](spark, "/root/testdata/sf0.01").collect()}
    assert found == brute.components(rows)


@pytest.mark.parametrize("long_list", [1, 3, 64])
def test_crowded_lists_lose_no_link(spark, long_list):
    rng = random.Random(long_list)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(9):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                value ^= 1 << bit
            prints.add(value)
    prints |= {0, 1, 7, 15, (1 << 64) - 1}
    links = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp bigint"), long_list)
    for row in links.collect():
        assert (row.a ^ row.b).bit_count() <= 3 or ((row.a ^ row.b) & (1 << 64) - 1).bit_count() <= 3
    found = {r.node: r.component for r in components(links).collect()}
    wanted = brute.groups([signed(p) for p in prints], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    for p in prints:
        assert found.get(signed(p), signed(p)) == wanted[signed(p)]


def test_components_of_long_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_odd_rows(spark):
    docs = brute.odd_documents(spark)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].fp == by_id[2].fp == by_id[3].fp == 0 and by_id[3].component_id == 1
    assert by_id[4].component_id == 4 and sum(r.doc_id == 4 for r in found) == 2
    assert {r.component_id for r in found if r.doc_id is None} == {1, None}  # the null text links to the empty ones
    assert simhash.near_duplicates(brute.empty_documents(spark)).count() == 0


def test_near_copies_link_through_each_other(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest tonight " * 30
    docs = spark.createDataFrame([(9, base), (5, base + "today"), (7, "something else entirely, word by word")],
                                 "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert found == {9: 5, 5: 5, 7: 7}


def test_no_table_is_built_on_the_driver(spark, monkeypatch):
    """Broadcast tables of nodes, links and ids grew with the documents; a round held the plan of its links several times."""
    plans = {}
    written = session.materialise

    def noted(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(session, "materialise", noted)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre} | {centre ^ 1 << rng.randrange(64) for _ in range(40)} | {rng.getrandbits(64) for _ in range(40)}
    fps = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(prints)], "doc_id bigint, fp bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: fps)
    docs = spark.createDataFrame([(0, "")], "doc_id bigint, text string")
    found = simhash.near_duplicates(docs, long_list=3)
    plans["result"] = [found._jdf.queryExecution().executedPlan().toString()]
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    plans["kept"] = [kept._jdf.queryExecution().executedPlan().toString()]
    assert {"quads", "quints", "links"} <= plans.keys()
    assert not [name for name, found in plans.items() for plan in found if "Broadcast" in plan]
    assert max(plan.count("FileScan") for plan in plans["links"][1:]) <= 4
