"""Status, KPI, replay and feed views."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import exact_mean, exact_sum
from ..functions.scalars import burst_suffix, fill, number_or, since
from ..operators.ranking import newest_values, top_k

STEPS = 30
REPLAY_FLAG = 70
# The feed texts.
PROPOSAL_MESSAGE = "{verb} {company} — {utilization}% util — +${value}/mo"
ALERT_MESSAGE = "Congestion predicted on {tower} — Peak BW {peak}% — Burst slice provisioned"


def site_status(telemetry: DataFrame, features: DataFrame, prefix: str | None = None) -> DataFrame:
    """The newest raw reading of each site next to its newest window, if any."""
    if prefix is not None:
        telemetry, features = (df.where(F.col("tower_id").startswith(prefix)) for df in (telemetry, features))
    raw = newest_values(telemetry, ["tower_id"], "timestamp", [
        "bandwidth_utilization_pct", "active_connections", "latency_ms"]).drop("timestamp")
    window = newest_values(features, ["tower_id"], "window_start", [
        "avg_congestion_score", "congestion_predicted_15min", "avg_bandwidth_util", "peak_bandwidth_util",
        "bandwidth_trend_15min"]).drop("window_start").withColumnRenamed("avg_congestion_score", "congestion_score")
    return raw.join(window, "tower_id", "left")


def complete_status(status: DataFrame, sites: DataFrame) -> DataFrame:
    """Status of every known site; missing numbers read 0 and a missing flag false."""
    numbers = ["bandwidth_utilization_pct", "latency_ms", "congestion_score", "avg_bandwidth_util",
               "peak_bandwidth_util"]
    joined = sites.select("tower_id").distinct().join(status, "tower_id", "left")
    return joined.select(
        "tower_id",
        *[number_or(F.col(c)).alias(c) for c in numbers],
        number_or(F.col("active_connections"), 0, "bigint").alias("active_connections"),
        F.coalesce(F.col("congestion_predicted_15min") == 1, F.lit(False)).alias("congestion_predicted_15min"),
        F.coalesce(F.col("bandwidth_trend_15min").cast("string"), F.lit("")).alias("bandwidth_trend_15min"))


def burst_count(slices: DataFrame, strict: bool = False) -> DataFrame:
    running = (F.col("status") == "active") & burst_suffix(F.col("slice_type"), strict)
    return slices.agg(F.count_if(running).alias("burst_slices"))


def distinct_count(df: DataFrame, column: str, out: str, approximate: bool = False) -> DataFrame:
    """Number of distinct values; the approximate form keeps a small sketch per task."""
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(count.alias(out))


def latest_summary(summaries: DataFrame) -> DataFrame:
    return top_k(summaries, [F.desc("summary_generated_at"), F.asc("event_id")], 1)


def kpi_bundle(opportunities: DataFrame, telemetry: DataFrame, features: DataFrame, log: DataFrame,
               summaries: DataFrame, slices: DataFrame) -> DataFrame:
    """All headline numbers in one row; with landed layers each of them is scanned once.

    Every source is reduced to one row first; the rows are stacked and merged,
    which needs no cross join.
    """
    latest = latest_summary(summaries).agg(
        F.max("projected_upsell_arr_usd").alias("upsell_arr"),
        F.max("arr_protected_from_churn_usd").alias("arr_protected"))
    parts = [
        distinct_count(opportunities, "customer_id", "accounts_at_risk"),
        distinct_count(telemetry, "tower_id", "active_towers"),
        distinct_count(features.where("congestion_predicted_15min = 1"), "tower_id", "towers_congested"),
        log.agg(F.count(F.lit(1)).alias("proposals_sent"), F.count_if("accepted").alias("proposals_accepted")),
        latest,
        burst_count(slices),
    ]
    names = [c for part in parts for c in part.columns]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])


def site_summary(features: DataFrame, as_of: Column | None = None, minutes: int = 30) -> DataFrame:
    """Sites seen, flagged windows and peak, over all windows or the most recent ones."""
    if as_of is not None:
        features = features.where(since(F.col("window_start"), as_of, minutes))
    return features.agg(
        F.count_distinct("tower_id").alias("active_towers"),
        F.sum(F.when(F.col("congestion_predicted_15min") == 1, 1).otherwise(0)).alias("congested_towers"),
        F.round(F.max("peak_bandwidth_util"), 1).alias("peak_bandwidth_pct"))


def newest_windows(features: DataFrame) -> DataFrame:
    """Rows of the newest window start over all sites."""
    newest = features.agg(F.max("window_start")).scalar()
    return features.where(F.col("window_start") == newest)


def time_steps(telemetry: DataFrame, steps: int = STEPS, flag_above: float = REPLAY_FLAG,
               prefix: str | None = None, step: int | None = None) -> DataFrame:
    """The covered time cut into equal half-open steps; one row per step and site.

    ``prefix`` restricts the sites shown, not the time covered.  With ``step`` only
    that one is computed, and its range of times goes into the scan.  Step bounds are
    whole seconds, rounded down, and the newest second lies outside the last
    step.  Bounds enter the plan as scalar subqueries, so all steps come from one
    scan after the bounds are known.
    """
    second = F.unix_timestamp("timestamp")
    first = telemetry.agg(F.min(second)).scalar()
    last = telemetry.agg(F.max(second)).scalar()
    shown = telemetry if prefix is None else telemetry.where(F.col("tower_id").startswith(prefix))
    if step is not None:
        low, high = telemetry.agg(F.min("timestamp"), F.max("timestamp")).first()
        if low is None or not 0 <= step < steps:
            return time_steps(telemetry.limit(0), steps, flag_above, prefix)
        low, high = low.replace(microsecond=0), high.replace(microsecond=0)
        length = (high - low).total_seconds() / steps
        # A second on either side: the exact bounds are settled below.
        around = [low + timedelta(seconds=math.floor(n * length) + side) for n, side in ((step, -1), (step + 1, 1))]
        kind = telemetry.schema["timestamp"].dataType
        shown = shown.where(F.col("timestamp").between(*[F.lit(a).cast(kind) for a in around]))
    bounded = shown.select(
        "tower_id", "bandwidth_utilization_pct", "active_connections", "latency_ms",
        second.alias("_t"), first.alias("_from"), ((last - first) / F.lit(steps)).alias("_length"))
    guess = F.floor(F.try_divide(F.col("_t") - F.col("_from"), F.col("_length"))).cast("bigint")
    start_of_next = F.floor(F.col("_from") + (F.col("_guess") + 1) * F.col("_length"))
    stepped = (
        bounded.withColumn("_guess", guess)
        .withColumn("step", F.col("_guess") + F.when(F.col("_t") >= start_of_next, 1).otherwise(0))
        .where(F.col("step") < steps)
    )
    mean = exact_mean(F.col("bandwidth_utilization_pct"))
    if step is not None:
        stepped = stepped.where(F.col("step") == step)
    return replay_columns(stepped.groupBy("step", "tower_id").agg(
        mean.alias("bandwidth_utilization_pct"),
        F.max("active_connections").alias("active_connections"),
        exact_mean(F.col("latency_ms")).alias("latency_ms"),
    ), flag_above)


def replay_columns(means: DataFrame, flag_above: float) -> DataFrame:
    """The score and the flag of a site's mean."""
    return means.withColumns({
        "congestion_score": F.col("bandwidth_utilization_pct") / F.lit(100.0),
        "congested": F.coalesce(F.col("bandwidth_utilization_pct") > flag_above, F.lit(False)),
    })


def congested_per_step(replay: DataFrame) -> DataFrame:
    """Number of sites and of congested sites in each step."""
    return replay.groupBy("step").agg(
        F.count(F.lit(1)).alias("active_towers"), F.count_if("congested").alias("towers_congested"))


def activity_feed(log: DataFrame, features: DataFrame, proposals: int = 15, alerts: int = 8,
                  newest: int = 20) -> DataFrame:
    """The newest proposal and congestion messages, merged by time."""
    def whole(column: str) -> Column:
        return F.rint(number_or(F.col(column))).cast("bigint")

    sent = top_k(log, [F.desc("sent_at"), F.asc("proposal_id")], proposals).select(
        F.when(F.col("accepted"), "accepted").otherwise("proposal").alias("type"),
        fill(
            PROPOSAL_MESSAGE,
            verb=F.when(F.col("accepted"), "Accepted!").otherwise("Proposal sent to"),
            company=F.coalesce("company_name", F.substring("customer_id", 1, 12)),
            utilization=whole("utilization_pct"), value=whole("monthly_revenue_opportunity"),
        ).alias("message"),
        F.col("sent_at").alias("timestamp"))
    flagged = features.where("congestion_predicted_15min = 1")
    warned = top_k(flagged, [F.desc("window_start"), F.asc("tower_id")], alerts).select(
        F.lit("congestion").alias("type"),
        fill(ALERT_MESSAGE, tower=F.col("tower_id"), peak=whole("peak_bandwidth_util")).alias("message"),
        F.col("window_start").alias("timestamp"))
    return top_k(sent.unionByName(warned), [F.desc("timestamp"), F.asc("message")], newest)


def ranked_accounts(opportunities: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All opportunities by falling score."""
    return opportunities.select(*columns).orderBy(F.desc("conversion_score"), F.asc("customer_id"))


def segment_value(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("customer_segment").agg(
        F.round(exact_sum(F.col("projected_upsell_arr")), 2).alias("projected_upsell_arr"),
        F.sum("high_upsell_opportunities").alias("high_upsell_opportunities"),
    ).orderBy(F.desc("projected_upsell_arr"), F.asc("customer_segment"))


def segment_scores(rollup: DataFrame, weighted: bool = False) -> DataFrame:
    """Mean score per segment: the mean of the rollup's means, or weighted by accounts."""
    score, accounts = F.col("avg_upsell_score"), F.col("total_customers_at_risk")
    mean = F.try_divide(exact_sum(score * accounts), F.sum(accounts)) if weighted else exact_mean(score)
    return rollup.groupBy("customer_segment").agg(
        F.round(mean, 4).alias("avg_upsell_score"),
        F.sum("high_upsell_opportunities").alias("high_upsell_opportunities"),
        F.sum(accounts).alias("total_customers_at_risk"))
