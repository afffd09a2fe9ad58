import math
import random
from datetime import timedelta, timezone

from pyspark.sql import functions as F

from capacast.plans import reports, serving
from capacast.sources import schemas
from tests.fixtures import START, capacity, reading, table
from tests.test_layers import features


def test_time_steps_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [reading(f"T{i % 4}", rng.uniform(0, 500), round(rng.uniform(0, 100), 2)) for i in range(400)]
    rows += [reading("T0", 0, 1.0), reading("T1", 500, 2.0), reading("T2", 250, None)]
    found = serving.time_steps(table(spark, schemas.TELEMETRY, rows)).collect()

    def seconds(row):
        return row[1].replace(tzinfo=timezone.utc).timestamp()
    low, high = math.floor(min(map(seconds, rows))), math.floor(max(map(seconds, rows)))
    length = (high - low) / 30
    expected = {}
    for k in range(30):
        a, b = math.floor(low + k * length), math.floor(low + (k + 1) * length)
        for row in rows:
            if a <= seconds(row) < b:
                expected.setdefault((k, row[0]), []).append(row)
    assert {(r.step, r.tower_id) for r in found} == set(expected)
    for r in found:
        members = [m[5] for m in expected[r.step, r.tower_id] if m[5] is not None]
        assert abs(r.bandwidth_utilization_pct - sum(members) / len(members)) < 1e-6
    telemetry = table(spark, schemas.TELEMETRY, rows)
    for k in (0, 7, 29, 30):
        one = serving.time_steps(telemetry, step=k)
        assert sorted(one.collect()) == sorted(r for r in found if r.step == k)
    pushed = serving.time_steps(telemetry, step=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp#" in pushed and ">= 2024" in pushed.replace("TIMESTAMP_NTZ '", "").replace("TIMESTAMP '", "")
    # The newest row is in no step.
    assert sum(len(m) for m in expected.values()) == len(rows) - 1


def test_time_steps_of_one_moment(spark):
    assert serving.time_steps(table(spark, schemas.TELEMETRY, [reading("A", 0, 1.0)])).count() == 0


def test_status_and_backfill(spark):
    rows = [reading("A", 0, 10.0), reading("A", 7, 90.0), reading("B", 0, 20.0)]
    raw = table(spark, schemas.TELEMETRY, rows)
    status = serving.site_status(raw, features(spark, rows).where("tower_id = 'A'"))
    by_site = {r.tower_id: r for r in status.collect()}
    assert (by_site["A"].bandwidth_utilization_pct, by_site["A"].avg_bandwidth_util) == (90.0, 90.0)
    assert by_site["B"].avg_bandwidth_util is None
    sites = spark.createDataFrame([("A",), ("C",)], "tower_id string")
    whole = {r.tower_id: r for r in serving.complete_status(status, sites).collect()}
    assert set(whole) == {"A", "C"}
    assert (whole["C"].bandwidth_utilization_pct, whole["C"].congestion_predicted_15min,
            whole["C"].bandwidth_trend_15min) == (0.0, False, "")
    assert (whole["A"].congestion_predicted_15min, whole["A"].bandwidth_trend_15min) == (True, "80.0")


def test_kpis_of_empty_tables_are_zero(spark):
    rows = [reading("A", 0, 10.0)]
    raw, windows = table(spark, schemas.TELEMETRY, rows), features(spark, rows)
    nothing = {name: table(spark, ddl, []) for name, ddl in
               (("log", schemas.PROPOSALS), ("summary", schemas.EVENT_SUMMARY), ("slices", schemas.SLICES))}
    row = serving.kpi_bundle(nothing["log"], raw, windows, nothing["log"], nothing["summary"], nothing["slices"]).head()
    assert row.asDict() == {
        "accounts_at_risk": 0, "active_towers": 1, "towers_congested": 0, "proposals_sent": 0,
        "proposals_accepted": 0, "upsell_arr": 0.0, "arr_protected": 0.0, "burst_slices": 0}


def test_recent_summary_keeps_the_last_half_hour(spark):
    windows = features(spark, [reading("A", 0, 90.0), reading("B", 30, 10.0), reading("C", 60, 95.0)])
    as_of = F.lit(START + timedelta(minutes=60)).cast("timestamp_ntz")
    assert tuple(serving.site_summary(windows, as_of).head()) == (2, 1, 95.0)
    assert tuple(serving.site_summary(windows).head()) == (3, 2, 95.0)


def test_newest_windows(spark):
    windows = features(spark, [reading("A", 0, 90.0), reading("B", 30, 10.0), reading("A", 31, 10.0)])
    assert sorted(r.tower_id for r in serving.newest_windows(windows).collect()) == ["A", "B"]


def test_feed_is_merged_by_time(spark):
    windows = features(spark, [reading("A", 0, 90.0), reading("A", 60, 92.5)])
    log = table(spark, schemas.PROPOSALS, [
        ("P1", "C1", None, "x", "s", "t", "a", "m", START + timedelta(minutes=30), .9, 92.5, "critical", 1, .1,
         True, 2000.0, 1.0, 1.0)])
    feed = serving.activity_feed(log, windows).collect()
    assert [r.type for r in feed] == ["congestion", "accepted", "congestion"]
    assert feed[1].message == "Accepted! C1 — 92% util — +$2000/mo"
    assert feed[0].message == "Congestion predicted on A — Peak BW 92% — Burst slice provisioned"


def test_distinct_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert [serving.distinct_count(df, "k", "n", approximate=a).head()[0] for a in (False, True)] == [2, 2]


def test_burst_counts(spark):
    slices = table(spark, schemas.SLICES, [
        capacity("1", "C", "A", 60.0, slice_type="a_burst"), capacity("2", "C", "A", 60.0, slice_type="xburst"),
        capacity("3", "C", "A", 60.0, slice_type="b_burst", status="terminated")])
    assert serving.burst_count(slices).head()[0] == 2
    assert serving.burst_count(slices, strict=True).head()[0] == 1
    assert {tuple(r) for r in reports.burst_by_status(slices).collect()} == {("active", 2, 1), ("terminated", 1, 1)}
