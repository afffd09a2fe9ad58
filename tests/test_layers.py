"""Cleaning to opportunities on hand-made rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from capacast.plans import layers
from capacast.sources import schemas
from tests.fixtures import START, account, capacity, reading, table



def as_of():
    return F.lit("2024-09-15 12:00:00").cast("timestamp_ntz")


def near(spark, *sites):
    return spark.createDataFrame([(s,) for s in sites], "tower_id string")


def features(spark, rows, *near_sites):
    cleaned = layers.clean_telemetry(table(spark, schemas.TELEMETRY, rows))
    return layers.congestion_features(cleaned, near(spark, *near_sites))


def test_clean_drops_and_bounds(spark):
    rows = [reading("A", 0, None), reading(None, 0, 1.0), reading("A", 0, 1.0, timestamp=None),
            reading("A", 0, 150.0, active_connections=-5, signal_strength_dbm=-121.0, latency_ms=None,
                    packet_loss_pct=-1.0, error_rate_pct=200.0, throughput_mbps=-1.0)]
    found = layers.clean_telemetry(table(spark, schemas.TELEMETRY, rows)).collect()
    assert len(found) == 1
    row = found[0]
    assert (row.bandwidth_utilization_pct, row.active_connections, row.signal_strength_dbm, row.latency_ms,
            row.packet_loss_pct, row.error_rate_pct, row.throughput_mbps, row.congestion_score) == (
        100.0, 0, None, 0.0, 0.0, 100.0, 0.0, 50.0)


def test_features_per_window(spark):
    rows = [reading("A", 0, 60.0), reading("A", 4.99, 70.0), reading("A", 5, 76.0), reading("A", 30, 86.0),
            reading("B", 0, 85.0)]
    found = {(r.tower_id, r.window_start): r for r in features(spark, rows, "A", "A").collect()}
    assert len(found) == 4
    first, second, late = (found["A", START + timedelta(minutes=m)] for m in (0, 5, 30))
    assert (first.avg_bandwidth_util, first.peak_bandwidth_util, first.bandwidth_trend_15min) == (65.0, 70.0, 0.0)
    assert (second.bandwidth_trend_15min, second.congestion_predicted_15min) == (11.0, 1)
    # The gap between 10:05 and 10:30 is ignored.
    assert (late.bandwidth_trend_15min, late.congestion_predicted_15min) == (10.0, 1)
    assert (first.near_event_flag, found["B", START].near_event_flag) == (1, 0)
    assert found["B", START].congestion_predicted_15min == 0
    assert (first.hour_of_day, first.day_of_week) == (10, 1)  # a Sunday
    assert first.window_end == START + timedelta(minutes=5)


def test_latest_flagged_window_filters_before_ranking(spark):
    flagged = layers.latest_flagged_window(features(spark, [reading("A", 0, 90.0), reading("A", 30, 10.0)]))
    assert [r.window_start for r in flagged.collect()] == [START]


def opportunities(spark):
    accounts = [account("C1"), account("C2"), account("C3"), account("C4"), account("C5")]
    slices = [
        capacity("S1", "C1", "A", 97.0), capacity("S0", "C1", "A", 97.0), capacity("S2", "C1", "A", 50.0),
        capacity("S3", "C2", "A", 80.0),
        capacity("S4", "C3", "Q", 99.0),                        # site without a flagged window
        capacity("S5", "C4", "A", 74.99),                       # too low
        capacity("S6", "C5", "A", 99.0, status="terminated"),
        capacity("S7", "C5", "A", 76.0)]
    rows = [reading("A", 0, 90.0), reading("A", 30, 10.0), reading("Q", 0, 10.0)]
    return layers.account_opportunities(
        layers.enrich_accounts(table(spark, schemas.ACCOUNTS, accounts)),
        table(spark, schemas.SLICES, slices), features(spark, rows), as_of())


def test_opportunities(spark):
    found = {r.customer_id: r for r in opportunities(spark).collect()}
    assert set(found) == {"C1", "C2", "C5"}
    assert (found["C1"].slice_id, found["C1"].breach_risk_level, found["C1"].conversion_score) == (
        "S0", "critical", 0.913)
    assert found["C5"].utilization_pct == 76.0
    assert found["C1"].scored_at == datetime(2024, 9, 15, 12)


def test_rollup_thresholds_are_strict(spark):
    base = opportunities(spark).where("customer_id = 'C1'")
    rows = base.crossJoin(spark.createDataFrame(
        [(.70, .25), (.7001, .2501)], "s double, c double")).withColumns(
        {"conversion_score": F.col("s"), "churn_risk_score": F.col("c")})
    row = layers.revenue_rollup(rows).head()
    assert (row.total_customers_at_risk, row.high_upsell_opportunities, row.critical_count) == (2, 1, 2)
    assert (row.arr_at_churn_risk, row.high_confidence_monthly_upsell) == (12000.0, 2000.0)
    assert row.projected_upsell_arr == 14880.0


def test_one_site_with_most_rows(spark):
    """A site holding a third of the rows gives the same features as when it is alone."""
    rows = [reading("hot", i / 50, float(i % 90)) for i in range(1500)]
    others = [reading(f"T{i % 60}", i / 50, float(i % 70)) for i in range(3000)]
    alone = features(spark, rows).orderBy("window_start").collect()
    mixed = features(spark, rows + others).where("tower_id = 'hot'").orderBy("window_start").collect()
    assert alone == mixed and len(alone) == 6
