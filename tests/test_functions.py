"""Boundary rows of the scoring rules and scalar helpers."""

import hashlib
import math
from datetime import datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from capacast import session
from capacast.functions import aggregates, geo, scalars, scores

C = F.col


def test_clamp_turns_null_into_the_bound(values):
    rows = [(-1.0,), (0.0,), (55.5,), (100.0,), (150.0,), (None,), (float("nan"),)]
    assert values("x double", rows, scalars.clamp(C("x"), 0.0, 100.0)) == [0, 0, 55.5, 100, 100, 0, 100]


def test_clamp_twice_is_clamp(values):
    rows = [(-5.0,), (50.0,), (None,), (500.0,)]
    once = scalars.clamp(C("x"), 0.0, 100.0)
    assert values("x double", rows, once) == values("x double", rows, scalars.clamp(once, 0.0, 100.0))


def test_range_or_null_is_inclusive(values):
    rows = [(-121.0,), (-120.0,), (-30.0,), (-29.0,), (None,)]
    assert values("x double", rows, scalars.in_range_or_null(C("x"), -120, -30)) == [None, -120, -30, None, None]


def test_congestion_score(values):
    ddl = "bw double, loss double, lat double, err double"
    rows = [(90.0, 4.0, 120.0, 2.0), (150.0, -1.0, None, 200.0), (100.0, 100.0, 20000.0, 100.0)]
    columns = [C(c) for c in ("bw", "loss", "lat", "err")]
    assert values(ddl, rows, scores.congestion_score(*columns)) == [37.64, 50.0, 100.0]
    raw = values(ddl, rows, scores.congestion_score(*columns, clamped=False, digits=None))
    assert raw[1] is None and abs(raw[2] - 120.0) < 1e-9


def test_segment(values):
    rows = [("broadcaster",), ("team_sponsor",), ("x",), (None,)]
    assert values("t string", rows, scores.segment(C("t"))) == ["media_rights", "teams_sponsors", "other", "other"]


def test_propensity_first_rule_wins(values):
    rows = [
        (.71, 1, .95, 0), (.70, 3, .80, 0), (.10, 3, .79, 0), (.10, 6, .75, 0), (.10, 12, .90, 3),
        (.10, 12, .85, 2), (.10, 12, .70, 0), (.10, 12, .69, 0), (None, None, None, None)]
    score = scores.propensity(C("c"), C("r"), C("p"), C("t"))
    assert values("c double, r int, p double, t int", rows, score) == [
        .15, .90, .80, .80, .85, .75, .60, .40, .40]


def test_expansion_value(values):
    assert values("b double", [(500.0,), (80.0,), (10.0,)], scores.expansion_value(C("b"))) == [2000, 320, 40]


def test_breach_level(values):
    rows = [(100.0,), (99.99,), (90.0,), (89.99,), (85.0,), (84.99,), (None,)]
    assert values("u double", rows, scores.breach_level(C("u"))) == [
        "breach", "critical", "critical", "warning", "warning", "watch", "watch"]


def test_account_score(values):
    rows = [(.9, 97.0, 1), (.4, 75.0, 0), (.75, 110.0, 1), (.9, 80.0, 0)]
    score = scores.account_score(C("p"), C("u"), C("f"))
    assert values("p double, u double, f int", rows, score) == [.913, .18, .8875, .475]


def test_predicted_flag(values):
    rows = [(76.0, 10.01), (76.0, 10.0), (85.0, 0.0), (85.01, 0.0)]
    assert values("u double, t double", rows, scores.predicted_flag(C("u"), C("t"))) == [1, 0, 0, 1]


def test_severity_band_is_strict(values):
    rows = [(.71,), (.7,), (.41,), (.4,)]
    assert values("s double", rows, scores.severity_band(C("s"))) == ["high", "medium", "medium", "low"]


def test_rollout_step(values):
    key = "BC-ESPN-001"
    rows = [(key, .4), (key, .913), (key, None), (key, 7.0)]
    found = values("k string, s double", rows, scores.rollout_step(C("k"), C("s")))
    first = int(hashlib.md5(key.encode()).hexdigest()[:8], 16)
    # A null score is bounded to 0, so it is shifted by 10.
    assert found == [8, 20, 4 + (first + 10) % 18, 20]


def test_hash_unit_matches_md5(values):
    expected = int(hashlib.md5(b"abcx").hexdigest()[:8], 16) / 2 ** 32
    assert values("k string", [("abc",)], scalars.hash_unit(C("k"), "x")) == [expected]


def test_suffix_wildcard(values):
    rows = [("a_burst",), ("xburst",), ("burst",)]
    assert values("t string", rows, scalars.burst_suffix(C("t"))) == [True, True, False]
    assert values("t string", rows, scalars.burst_suffix(C("t"), strict=True)) == [True, False, False]


def test_time_bucket_bounds(values):
    rows = [(datetime(2024, 9, 15, 10, 4, 59),), (datetime(2024, 9, 15, 10, 5),), (datetime(1969, 12, 31, 23, 59),)]
    assert values("t timestamp_ntz", rows, scalars.time_bucket(C("t"), 300)) == [
        datetime(2024, 9, 15, 10), datetime(2024, 9, 15, 10, 5), datetime(1969, 12, 31, 23, 55)]


def test_number_or(values):
    rows = [("12.5",), ("abc",), (None,), ("",)]
    assert values("t string", rows, scalars.number_or(C("t"), -1)) == [12.5, -1, -1, -1]


def test_fill(values):
    rows = [("a", 94.0), (None, 1.0)]
    text = scalars.fill("{who} is at {pct}% now", who=C("w"), pct=C("p"))
    assert values("w string, p double", rows, text) == ["a is at 94.0% now", None]


def test_ratio_without_divisor(values):
    rows = [(50.0, 200.0), (1.0, 0.0), (None, 2.0)]
    assert values("a double, b double", rows, scalars.ratio_pct(C("a"), C("b"))) == [25.0, None, None]


def _aggregated(spark, rows, make, partitions=1):
    return spark.createDataFrame([(r,) for r in rows], "x double").repartition(partitions).agg(make(C("x"))).head()[0]


def test_exact_mean_ignores_order(spark):
    rows = [0.1] * 10 + [1e13, None, 4e-7]
    wanted = float((Fraction("0.1") * 10 + 10**13 + Fraction("4e-7")) / 12)
    assert {_aggregated(spark, part, aggregates.exact_mean, n) for n in (1, 3, 7) for part in (rows, rows[::-1])} == {wanted}


@pytest.mark.parametrize("rows, mean, total", [
    ([1e13, 1.0], 5000000000000.5, 1e13 + 1), ([4e-7], 4e-7, 4e-7), ([1e19, 1.0], 5e18, 1e19), ([9e12, 9e12], 9e12, 1.8e13),
    ([float("inf"), 1.0], float("inf"), float("inf")), ([-0.5, 0.25, None], -0.125, -0.25), ([None], None, None), ([], None, None)])
def test_exact_values(spark, rows, mean, total):
    assert _aggregated(spark, rows, aggregates.exact_mean) == mean
    assert _aggregated(spark, rows, aggregates.exact_sum) == total


def test_odd_values_propagate(spark):
    for rows in ([float("nan"), 1.0], [float("inf"), float("-inf")]):
        assert math.isnan(_aggregated(spark, rows, aggregates.exact_mean))
        assert math.isnan(_aggregated(spark, rows, aggregates.exact_sum))


@pytest.mark.parametrize("rows", [[1e21], [9e19, 9e19]])
def test_what_does_not_fit_fails(spark, rows):
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|ARITHMETIC_OVERFLOW|out of range|overflow"):
        _aggregated(spark, rows, aggregates.exact_sum)


def test_time_buckets_keep_rows_without_a_time(spark):
    rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-09-15 10:04:59.5'), (NULL) AS t(a)")
    found = rows.select(scalars.time_bucket(C("a"), 300).alias("x"), scalars.time_bucket(C("a"), 3600).alias("y"),
                        scalars.time_bucket(C("a").cast("timestamp"), 60).alias("z"))
    assert [t for _, t in found.dtypes] == ["timestamp_ntz", "timestamp_ntz", "timestamp"]
    assert sorted(map(tuple, found.select("x", "y").collect()), key=str) == [
        (None, None), (datetime(2024, 9, 15, 10), datetime(2024, 9, 15, 10))]


def test_distance(values):
    rows = [(47.6062, -122.3321), (47.5925, -122.3330), (47.6585, -122.3130), (47.6815, -122.2087)]
    miles = F.round(geo.distance_miles(F.lit(47.5952), F.lit(-122.3316), C("a"), C("b")), 3)
    assert values("a double, b double", rows, miles) == [.760, .198, 4.459, 8.268]


def test_sizing_grows_with_the_input(spark, tmp_path):
    small, large = session.sizing(10 << 30, 32), session.sizing(100 << 40, 4000)
    assert (small["spark.sql.shuffle.partitions"], large["spark.sql.shuffle.partitions"]) == ("64", "409600")
    assert large["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "409600"
    assert small["spark.sql.files.maxPartitionBytes"] == str(128 << 20)
    assert large["spark.sql.files.maxPartitionBytes"] == str((100 << 40) // 200_000)
    spark.range(1000).write.parquet(str(tmp_path / "t" / "u"))
    held = sum(p.stat().st_size for p in (tmp_path / "t").rglob("*") if p.is_file() and p.name[0] not in "._")
    assert session.stored_bytes(spark, str(tmp_path / "t")) == held
    keys = session.sizing(held, 4)
    before = {k: spark.conf.get(k, None) for k in keys}
    session.sized(spark, str(tmp_path / "t"))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"  # two for each of four cores
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
