"""As-of joins and validity intervals against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from capacast.operators import asof

START = datetime(2024, 1, 1)
DDL = "k string, t timestamp_ntz, x double, y int"


def histories(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        k = rng.choice(["hot", "hot", "a", "b", None])
        t = rng.choice([None, *[START + timedelta(seconds=rng.randrange(60)) for _ in range(9)]])
        rows.append((k, t, rng.choice([1.0, 1.0, 2.0, None]), rng.choice([1, 1, 1, 2])))
    return rows


def expected_changes(rows):
    newest = {}
    for k, t, x, y in rows:
        if None not in (k, t, x, y):
            newest[k, t] = max(newest.get((k, t), (x, y)), (x, y))
    found, before = [], {}
    for (k, t), value in sorted(newest.items()):
        if before.get(k) != value:
            found.append((k, t, *value))
        before[k] = value
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_validity_and_join_equal_brute_force(spark, seed):
    rows = histories(seed)
    df = spark.createDataFrame(rows, DDL)
    changed = asof.changes(df, "k", "t", ["x", "y"])
    wanted = expected_changes(rows)
    assert sorted(tuple(r) for r in changed.collect()) == wanted
    until = {}
    for k, t, x, y in reversed(wanted):
        until[k, t] = next((b for a, b, *_ in wanted if a == k and b > t), None)
    spans = asof.validity(changed, "k", "t").collect()
    assert {(r.k, r.valid_from): r.valid_until for r in spans} == until and len(spans) == len(wanted)
    facts = [(k, t, i) for i, (k, t, _, _) in enumerate(histories(seed + 10))]
    joined = asof.join_as_of(spark.createDataFrame(facts, "k string, t timestamp_ntz, n int"), changed, "k", "t", ["x", "y"])
    assert joined.columns == ["k", "t", "n", "known_x", "known_y"]

    def known(k, t):
        past = [w for w in wanted if None not in (k, t) and w[0] == k and w[1] <= t]
        return past[-1][2:] if past else (None, None)

    assert sorted(map(tuple, joined.collect()), key=lambda r: r[2]) == [(k, t, n, *known(k, t)) for k, t, n in facts]


def test_one_site_lies_in_many_tasks(spark):
    facts = spark.range(200_000).select(
        F.lit("hot").alias("k"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), "id")
    moves = facts.where("id % 1000 = 7").select("k", "t", F.col("id").alias("place"))
    joined = asof.join_as_of(facts, moves, "k", "t", ["place"])
    wrong = joined.where(F.coalesce("known_place", F.lit(-1)) != F.when(F.col("id") < 7, -1).otherwise(
        F.floor((F.col("id") - 7) / 1000) * 1000 + 7))
    assert joined.count() == 200_000 and wrong.count() == 0
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # The windows run within a range of rows, and over one row for each range.
    assert "_part" in plan and "CartesianProduct" not in plan


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DDL)
    facts = spark.createDataFrame([("a", START, 1)], "k string, t timestamp_ntz, n int")
    changed = asof.changes(empty, "k", "t", ["x"])
    assert changed.count() == 0
    assert [tuple(r) for r in asof.join_as_of(facts, changed, "k", "t", ["x"]).collect()] == [("a", START, 1, None)]
    assert asof.join_as_of(facts.limit(0), changed, "k", "t", ["x"]).count() == 0
