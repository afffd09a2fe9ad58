"""From raw tables to features, opportunities and the revenue rollup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.aggregates import exact_mean, exact_sum, sum_if
from ..functions.scalars import clamp, in_range_or_null
from ..operators.joins import distinct_sites, flag_keys, join_unique, proximity_join, sites_near
from ..operators.ranking import change_from_previous, latest_per_key, top_per_key
from ..operators.rows import require_not_null

# Thresholds of the rollup and the opportunity filter.
WINDOW_SECONDS = 300
HIGH_SCORE = 0.70
CHURN_CUT = 0.25
CHURN_SCORE_CUT = 0.60
ACCEPTANCE = 0.62
FLAGGED_SCORE = 60


def clean_telemetry(telemetry: DataFrame) -> DataFrame:
    """Drop unusable rows, bound the indicators, add ``congestion_score``.  Stateless."""
    usable = require_not_null(telemetry, ["tower_id", "timestamp", "bandwidth_utilization_pct"])
    percent = ["bandwidth_utilization_pct", "packet_loss_pct", "error_rate_pct"]
    score = scores.congestion_score(
        F.col("bandwidth_utilization_pct"), F.col("packet_loss_pct"), F.col("latency_ms"), F.col("error_rate_pct"))
    return usable.withColumns({
        "congestion_score": score,
        "active_connections": clamp(F.col("active_connections"), 0),
        "signal_strength_dbm": in_range_or_null(F.col("signal_strength_dbm"), -120, -30),
        **{c: clamp(F.col(c), 0.0) for c in ("latency_ms", "throughput_mbps")},
        **{c: clamp(F.col(c), 0.0, 100.0) for c in percent},
    })


def enrich_accounts(accounts: DataFrame) -> DataFrame:
    """Normalise tiers, add segment, propensity and expansion value.  Stateless."""
    likely = scores.propensity(
        F.col("churn_risk_score"), F.col("contract_renewal_months"),
        F.col("peak_event_utilization_pct"), F.col("support_tickets_30d"))
    return require_not_null(accounts, ["customer_id"]).withColumns({
        "contract_tier": F.upper("contract_tier"),
        "sla_tier": F.upper("sla_tier"),
        "customer_segment": scores.segment(F.col("customer_type")),
        "upsell_propensity_score": F.round(likely, 4),
        "monthly_upsell_opportunity_usd": scores.expansion_value(F.col("contracted_bandwidth_mbps")),
    })


def event_proximity(events: DataFrame, telemetry: DataFrame, radius_miles: float = 5.0) -> DataFrame:
    """Event and site pairs within the radius."""
    return proximity_join(events, distinct_sites(telemetry), radius_miles).select(
        "event_id", "event_name", "venue_name", "event_start_time", "event_end_time", "expected_attendance",
        "traffic_multiplier", "tower_id", F.col("latitude").alias("tower_latitude"),
        F.col("longitude").alias("tower_longitude"), "distance_miles")


def tumbling_features(cleaned: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """One row per site and window.

    Rows of a site and window are combined before the shuffle, which is on both
    columns, so a busy site is spread over its windows.
    """
    span = F.window("timestamp", f"{window_seconds} seconds")
    return cleaned.groupBy("tower_id", span.alias("span")).agg(
        F.round(exact_mean(F.col("bandwidth_utilization_pct")), 2).alias("avg_bandwidth_util"),
        F.round(F.max("bandwidth_utilization_pct"), 2).alias("peak_bandwidth_util"),
        F.round(exact_mean(F.col("active_connections")), 0).alias("avg_connections"),
        F.max("active_connections").alias("peak_connections"),
        F.round(exact_mean(F.col("congestion_score")), 2).alias("avg_congestion_score"),
        F.round(exact_mean(F.col("latency_ms")), 2).alias("avg_latency_ms"),
        F.round(exact_mean(F.col("packet_loss_pct")), 4).alias("avg_packet_loss_pct"),
        F.min("timestamp").alias("_first"),
    ).select(
        "tower_id", F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"),
        "avg_bandwidth_util", "peak_bandwidth_util", "avg_connections", "peak_connections",
        "avg_congestion_score", "avg_latency_ms", "avg_packet_loss_pct",
        F.hour("_first").alias("hour_of_day"), F.dayofweek("_first").alias("day_of_week"),
    )


def with_trends(windowed: DataFrame, steps: int = 1, chunk_seconds: int | None = None) -> DataFrame:
    """Change of utilization and connections against the site's previous window."""
    return change_from_previous(
        windowed, ["tower_id"], "window_start",
        {"bandwidth_trend_15min": ("avg_bandwidth_util", 2), "connection_trend_15min": ("avg_connections", 1)},
        steps, chunk_seconds)


def with_flags(trended: DataFrame, near_sites: DataFrame) -> DataFrame:
    """Add the near-event and predicted flags to windows with trends."""
    # A site has one row per window, so no site dominates and the join keeps the
    # partitioning of the trend step.
    flagged = flag_keys(trended, near_sites, "tower_id", "near_event_flag")
    return flagged.select(
        "tower_id", "window_start", "window_end", "avg_bandwidth_util", "peak_bandwidth_util",
        F.col("avg_connections").cast("bigint").alias("avg_connections"), "peak_connections",
        "avg_congestion_score", "avg_latency_ms", "avg_packet_loss_pct", "bandwidth_trend_15min",
        "connection_trend_15min", "near_event_flag", "hour_of_day", "day_of_week",
        scores.predicted_flag(F.col("avg_bandwidth_util"), F.col("bandwidth_trend_15min"))
        .alias("congestion_predicted_15min"))


def congestion_features(cleaned: DataFrame, near_sites: DataFrame, window_seconds: int = WINDOW_SECONDS,
                        steps: int = 1) -> DataFrame:
    """Windowed features with trends, the near-event flag and the predicted flag.

    ``near_sites`` is any frame with a ``tower_id`` column.
    """
    return with_flags(with_trends(tumbling_features(cleaned, window_seconds), steps), near_sites)


def features_from_raw(telemetry: DataFrame, events: DataFrame, window_seconds: int = WINDOW_SECONDS,
                      radius_miles: float = 5.0) -> DataFrame:
    """Raw telemetry and event calendar to congestion features."""
    near = sites_near(events, distinct_sites(telemetry), radius_miles)
    return congestion_features(clean_telemetry(telemetry), near, window_seconds)


def hottest_slice(slices: DataFrame) -> DataFrame:
    """The active slice with the highest utilization per account; ties by slice id."""
    return top_per_key(
        slices.where(F.col("status") == "active"), ["customer_id"],
        [F.desc("utilization_pct"), F.asc("slice_id")])


def latest_flagged_window(features: DataFrame, score_cut: float = FLAGGED_SCORE,
                          keys: Sequence[str] = ("tower_id",)) -> DataFrame:
    """The newest window per site (or other keys) among those predicted or scored congested."""
    flagged = features.where((F.col("congestion_predicted_15min") == 1) | (F.col("avg_congestion_score") > score_cut))
    return latest_per_key(flagged, list(keys), "window_start")


def account_opportunities(accounts: DataFrame, slices: DataFrame, features: DataFrame, scored_at: Column,
                          score_cut: float = FLAGGED_SCORE) -> DataFrame:
    """Enriched accounts whose hottest slice is near its limit at a congested site."""
    # The hottest slice is the one with the highest utilization, so slices below
    # the lowest limit can go before the ranking and the shuffle.
    hot = hottest_slice(slices.where(F.col("utilization_pct") >= 75)).select(
        "customer_id", "slice_id", "tower_id", "current_bandwidth_mbps", "utilization_pct")
    window = latest_flagged_window(features, score_cut).select(
        "tower_id", "window_start", "avg_congestion_score", "bandwidth_trend_15min",
        "congestion_predicted_15min", "near_event_flag")
    # Both sides have one row per account; many accounts may share a site.
    joined = join_unique(accounts.join(hot, "customer_id"), window, "tower_id", ["customer_id"])
    kept = joined.where((F.col("utilization_pct") >= 85) | (F.col("congestion_predicted_15min") == 1))
    return kept.select(
        "customer_id", "company_name", "customer_type", "customer_segment", "contract_tier",
        "monthly_contract_value", "contracted_bandwidth_mbps", "contracted_latency_ms",
        "upsell_propensity_score", "monthly_upsell_opportunity_usd", "churn_risk_score",
        "contract_renewal_months", "account_manager_id", "slice_id", "tower_id", "current_bandwidth_mbps",
        "utilization_pct", "window_start", "avg_congestion_score", "bandwidth_trend_15min",
        "congestion_predicted_15min", "near_event_flag",
        scores.breach_level(F.col("utilization_pct")).alias("breach_risk_level"),
        scores.account_score(F.col("upsell_propensity_score"), F.col("utilization_pct"),
                             F.col("congestion_predicted_15min")).alias("conversion_score"),
        F.col("monthly_upsell_opportunity_usd").alias("monthly_revenue_opportunity"),
        scored_at.alias("scored_at"))


def revenue_rollup(opportunities: DataFrame, time: str = "scored_at",
                   cuts: Mapping[str, float] | None = None) -> DataFrame:
    """Counts, averages and money by date, hour and segment, in one aggregate."""
    cut = {"high": HIGH_SCORE, "churn": CHURN_CUT, "churn_score": CHURN_SCORE_CUT, **(cuts or {})}
    high = F.col("conversion_score") > cut["high"]
    churning = (F.col("churn_risk_score") > cut["churn"]) & (F.col("conversion_score") > cut["churn_score"])
    value = F.col("monthly_revenue_opportunity")
    levels = {f"{level}_count": F.count_if(F.col("breach_risk_level") == level)
              for level in ("breach", "critical", "warning")}
    return opportunities.groupBy(
        F.to_date(time).alias("analysis_date"), F.hour(time).alias("hour_of_day"), "customer_segment",
    ).agg(
        F.count(F.lit(1)).alias("total_customers_at_risk"),
        *[count.alias(name) for name, count in levels.items()],
        F.count_if(high).alias("high_upsell_opportunities"),
        F.round(exact_mean(F.col("conversion_score")), 4).alias("avg_upsell_score"),
        F.round(exact_sum(value), 2).alias("total_monthly_upsell_opportunity"),
        F.round(sum_if(high, value), 2).alias("high_confidence_monthly_upsell"),
        F.round(sum_if(high, value) * ACCEPTANCE * 12, 2).alias("projected_upsell_arr"),
        F.round(sum_if(churning, F.col("monthly_contract_value") * 12), 2).alias("arr_at_churn_risk"),
        F.round(exact_mean(F.col("utilization_pct")), 2).alias("avg_utilization_pct"),
        F.round(F.max("utilization_pct"), 2).alias("peak_utilization_pct"),
    )
