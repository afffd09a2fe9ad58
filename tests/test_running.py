import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from capacast.operators.running import running

DDL = "key string, at int, n bigint, x double"


def made(seed, count=400):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(rng.choice(keys), i if rng.random() < 0.97 else None, rng.choice([None, rng.randint(-9, 9)]),
             rng.choice([None, rng.random()])) for i in range(count)]


def expected(rows, keyed, inclusive):
    def place(r):
        return (r[0] is not None, r[0] or "") if keyed else 0

    out = {}
    for _, group in groupby(sorted(rows, key=lambda r: (place(r), r[1] is not None, r[1] or 0, r[4])), key=place):
        total, low, high = 0, None, None
        for r in group:
            before = total, low, high
            if r[2] is not None:
                total += r[2]
                low = r[2] if low is None else min(low, r[2])
            if r[3] is not None:
                high = r[3] if high is None else max(high, r[3])
            out[r[4]] = (total, low, high) if inclusive else before
    return out


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_equal_to_a_loop(spark, keyed, inclusive, partitions):
    rows = [(*r, i) for i, r in enumerate(made(3))]
    df = spark.createDataFrame(rows, DDL + ", id int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = running(df, ["key"] if keyed else [], ["at", "id"],
                        {"total": ("sum", "n"), "low": ("min", F.col("n")), "high": ("max", "x")}, inclusive).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.id: (r.total, r.low, r.high) for r in found} == expected(rows, keyed, inclusive)


def test_floats_do_not_depend_on_ranges(spark):
    rows = [(i, 0.1 * (i % 7) + 1e-9 * i) for i in range(500)]
    df = spark.createDataFrame(rows, "at int, x double")
    results = []
    for partitions in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        results.append(sorted(tuple(r) for r in running(df, [], ["at"], {"total": ("sum", "x")}).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert results[0] == results[1]
    assert abs(results[0][-1][2] - sum(x for _, x in rows)) < 1e-9


def test_windows_are_split_by_range(spark):
    df = spark.range(1000).selectExpr("1 as key", "id as at", "id as n")
    plan = running(df, ["key"], ["at"], {"total": ("sum", "n")})._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[(.*?)\], \[(.*?)\]", plan)
    assert len(windows) == 2
    # One window is over rows and split by the range, the other over one total for each range.
    over_rows = [keys for made, keys in windows if "_here" in made]
    assert len(over_rows) == 1 and "_part" in over_rows[0]


def test_empty_and_further_columns(spark):
    assert running(spark.createDataFrame([], DDL), ["key"], ["at"], {"t": ("sum", "n")}).count() == 0
    df = spark.createDataFrame([("a", 1, 2, "x"), ("a", 2, 3, "y")], "key string, at int, n bigint, part string")
    found = running(df, ["key"], ["at"], {"t": ("sum", "n")})
    assert found.columns == ["key", "at", "n", "part", "t"]
    assert sorted(r.t for r in found.collect()) == [2, 5]
