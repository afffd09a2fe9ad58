"""Windows inside spans: united spans, dyadic blocks, and the flag against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest

from capacast.operators import joins

START = datetime(2024, 1, 1)


def test_blocks_cover_a_span_exactly(spark):
    rng = random.Random(2)
    spans = [(i, a, a + rng.randint(0, 60)) for i, a in enumerate(rng.randint(-70, 70) for _ in range(120))]
    found = joins.dyadic_blocks(spark.createDataFrame(spans, "k int, _a bigint, _b bigint"), "k").collect()
    for k, a, b in spans:
        slots = sorted(s for r in found if r.k == k for s in range(r._block << r._level, (r._block + 1) << r._level))
        assert slots == list(range(a, b + 1))


def test_ten_years_of_seconds_are_few_rows(spark):
    span = spark.createDataFrame([(1, 1_700_000_003, 1_700_000_003 + 10 * 365 * 86400)], "k int, _a bigint, _b bigint")
    assert joins.dyadic_blocks(span, "k").count() < 100


def test_spans_are_united(spark):
    spans = [("a", 0, 3), ("a", 2, 9), ("a", 4, 5), ("a", 10, 12), ("a", 20, 21), ("b", 3, 4), ("a", 0, 3)]
    found = joins.merged_spans(spark.createDataFrame(spans, "k string, _a bigint, _b bigint"), "k")
    assert sorted(map(tuple, found.collect())) == [("a", 0, 12), ("a", 20, 21), ("b", 3, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_flag_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 5 + ["x", "y", None]
    spans = [(rng.choice(keys), START + timedelta(seconds=a), START + timedelta(seconds=a + rng.choice([0, 30, 61, 400, 5000])))
             for a in (rng.randint(-3000, 9000) for _ in range(25))] + [("x", None, START), ("y", START, None)]
    rows = [(rng.choice([*keys, "none"]), START + timedelta(seconds=60 * rng.randint(-40, 200)), i) for i in range(400)]
    rows.append(("x", None, 1000))
    found = joins.flag_windows_inside(
        spark.createDataFrame(rows, "site string, window_start timestamp, n int"),
        spark.createDataFrame(spans, "site string, event_start_time timestamp, event_end_time timestamp"), "site", 60, "flag")
    assert found.columns == ["site", "window_start", "n", "flag"]
    flags = {r.n: r.flag for r in found.collect()}
    assert len(flags) == len(rows)
    for site, at, n in rows:
        inside = any(k == site and site is not None and a is not None and b is not None and at is not None
                     and a <= at and at + timedelta(seconds=60) <= b for k, a, b in spans)
        assert flags[n] == int(inside), (site, at)


def test_no_spans(spark):
    rows = spark.createDataFrame([("x", START)], "site string, window_start timestamp")
    empty = spark.createDataFrame([], "site string, event_start_time timestamp, event_end_time timestamp")
    assert [r.flag for r in joins.flag_windows_inside(rows, empty, "site", 60, "flag").collect()] == [0]
