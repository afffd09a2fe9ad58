import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from capacast.operators import ranking

START = datetime(2024, 1, 1)


def readings(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for site in ("hot", "a", "b"):
        seconds = sorted(rng.sample(range(200_000), 600 if site == "hot" else 80))
        rows += [(site, START + timedelta(seconds=s), None if rng.random() < .1 else round(rng.uniform(0, 100), 2),
                  rng.randrange(1000)) for s in seconds]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, t timestamp_ntz, v double, n bigint")


@pytest.mark.parametrize("steps", [1, 2, 5])
def test_chunked_change_equals_plain_change(spark, steps):
    rows, df = readings(spark)
    rows += [("hot", None, 7.0, 1), (None, START, 1.0, 2), ("a", None, 3.0, 4)]
    df = df.union(spark.createDataFrame(rows[-3:], df.schema))
    changes = {"dv": ("v", 2), "dn": ("n", 1)}
    plain = ranking.change_from_previous(df, ["k"], "t", changes, steps)
    expected = sorted(plain.collect(), key=repr)
    for chunk in (60, 3600, 86400):
        chunked = ranking.change_from_previous(df, ["k"], "t", changes, steps, chunk_seconds=chunk)
        assert sorted(chunked.select(plain.columns).collect(), key=repr) == expected
    assert len(expected) == len(rows)


def test_first_row_is_zero_and_gaps_are_ignored(spark):
    rows = [("a", START, 10.0), ("a", START + timedelta(minutes=30), 25.5)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")
    found = ranking.change_from_previous(df, ["k"], "t", {"d": ("v", 2)}).orderBy("t").collect()
    assert [r.d for r in found] == [0.0, 15.5]


def test_newest_values_equal_latest_per_key(spark):
    _, df = readings(spark, 2)
    latest = ranking.latest_per_key(df, ["k"], "t").select("k", "t", "v", "n")
    ties = df.union(df.withColumn("v", F.lit(500.0)).withColumn("n", F.col("n") - 1))
    first = ranking.newest_values(ties, ["k"], "t", ["v", "n"]).collect()
    assert sorted(first) == sorted(ranking.newest_values(ties.repartition(5), ["k"], "t", ["v", "n"]).collect())
    assert {r.v for r in first} == {500.0}
    assert sorted(ranking.latest_per_key(ties, ["k"], "t").collect(), key=repr) == sorted(
        ranking.latest_per_key(ties.repartition(5), ["k"], "t").collect(), key=repr)
    assert sorted(latest.collect(), key=repr) == sorted(
        ranking.newest_values(df, ["k"], "t", ["v", "n"]).collect(), key=repr)


def test_top_per_key_breaks_ties(spark):
    df = spark.createDataFrame([("a", 5.0, "y"), ("a", 5.0, "x"), ("a", 4.0, "w"), ("b", None, "v")],
                               "k string, u double, i string")
    best = ranking.top_per_key(df, ["k"], [F.desc("u"), F.asc("i")])
    assert sorted((r.k, r.i) for r in best.collect()) == [("a", "x"), ("b", "v")]
