"""Fixed report queries over features, opportunities, proposals, rollups and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import exact_mean, exact_sum, sum_if
from ..functions.scalars import burst_suffix, in_slice
from ..operators.joins import join_unique
from ..operators.ranking import latest_per_key, top_k
from ..operators.running import running
from .campaign import select_targets
from .layers import latest_flagged_window


def event_report(summaries: DataFrame, event_name: str) -> DataFrame:
    """The summary of one event, with the rate in percent and money in whole units."""
    money = ["immediate_monthly_upsell_usd", "projected_upsell_arr_usd", "arr_protected_from_churn_usd"]
    return top_k(summaries.where(F.col("event_name") == event_name), [F.desc("summary_generated_at"), F.asc("event_id")], 1).select(
        "event_name", "b2b_customers_targeted", "b2b_customers_accepted",
        F.round(F.col("acceptance_rate") * 100, 1).alias("acceptance_rate_pct"),
        *[F.round(c, 0).alias(c) for c in money], "burst_slices_provisioned")


def top_opportunities(opportunities: DataFrame, k: int = 100) -> DataFrame:
    best = top_k(select_targets(opportunities),
                 [F.desc("conversion_score"), F.desc("utilization_pct"), F.asc("customer_id")], k)
    return best.select(
        "company_name", "customer_type", "customer_segment",
        F.round("utilization_pct", 1).alias("utilization_pct"), "breach_risk_level",
        F.round("conversion_score", 3).alias("conversion_score"),
        F.round("monthly_revenue_opportunity", 0).alias("monthly_revenue_opportunity"), "tower_id")


def site_timeline(features: DataFrame, prefix: str) -> DataFrame:
    """Utilization of a venue's sites over time."""
    return features.where(F.col("tower_id").startswith(prefix)).select(
        "tower_id", "window_start", F.round("avg_bandwidth_util", 2).alias("avg_bandwidth_util"),
        "congestion_predicted_15min").orderBy("window_start", "tower_id")


def site_running_total(features: DataFrame) -> DataFrame:
    """Each site's series with what it has added up to: windows, flagged windows, connections at their peaks, and the highest
    utilization so far.  A site of any number of windows is spread over tasks."""
    series = running(features.select("tower_id", "window_start", "peak_connections", "peak_bandwidth_util",
                                     F.col("congestion_predicted_15min").cast("bigint").alias("flagged")),
                     ["tower_id"], ["window_start"], {
        "windows_so_far": ("sum", F.lit(1).cast("bigint")), "flagged_so_far": ("sum", "flagged"),
        "connections_so_far": ("sum", F.col("peak_connections").cast("bigint")),
        "highest_util_so_far": ("max", "peak_bandwidth_util")})
    return series.drop("flagged", "peak_connections", "peak_bandwidth_util")


def event_arr(summaries: DataFrame) -> DataFrame:
    """Projected and protected yearly revenue per event."""
    return summaries.select("event_name", "projected_upsell_arr_usd", "arr_protected_from_churn_usd")


def acceptance_by(log: DataFrame, column: str = "customer_type") -> DataFrame:
    return log.groupBy(column).agg(
        F.round(exact_mean(F.col("accepted").cast("int")), 4).alias("acceptance_rate"),
    ).orderBy(F.desc("acceptance_rate"), F.asc(column))


def projected_annual(rollup: DataFrame) -> DataFrame:
    """Projected yearly upsell per day."""
    return rollup.groupBy("analysis_date").agg(
        F.round(exact_sum(F.col("projected_upsell_arr")), 2).alias("projected_upsell_arr"))


def top_accounts(opportunities: DataFrame, k: int = 10) -> DataFrame:
    return top_k(opportunities, [F.desc("monthly_revenue_opportunity"), F.asc("customer_id")], k).select(
        "customer_id", "company_name", "monthly_revenue_opportunity")


def closest_to_limit(opportunities: DataFrame, k: int | None = None) -> DataFrame:
    """Accounts by their distance from the contracted bandwidth, nearest first; all of them unless ``k`` is given."""
    gap = F.abs(F.lit(100.0) - F.col("utilization_pct"))
    order = [F.asc("gap_pct"), F.asc("customer_id")]
    ranked = opportunities.withColumn("gap_pct", F.round(gap, 2))
    ranked = ranked.orderBy(*order) if k is None else top_k(ranked, order, k)
    return ranked.select("customer_id", "company_name", "utilization_pct", "gap_pct", "breach_risk_level")


def critical_between(log: DataFrame, start: Column, end: Column) -> DataFrame:
    """Accounts at a level per time slice ``[start, end)``."""
    return log.where(in_slice(F.col("sent_at"), start, end)).groupBy("breach_risk_level").agg(
        F.count_distinct("customer_id").alias("accounts"))


def mean_utilization(opportunities: DataFrame, customer_type: str) -> DataFrame:
    return opportunities.where(F.col("customer_type") == customer_type).agg(
        F.round(exact_mean(F.col("utilization_pct")), 2).alias("avg_utilization_pct"))


def above_utilization(opportunities: DataFrame, cut: float = 90.0) -> DataFrame:
    return opportunities.where(F.col("utilization_pct") > cut).select(
        "customer_id", "company_name", "utilization_pct", "breach_risk_level")


def type_at_risk(opportunities: DataFrame, customer_type: str) -> DataFrame:
    """Accounts of one type whose utilization is at or above the warning level."""
    return opportunities.where(
        (F.col("customer_type") == customer_type) & (F.col("breach_risk_level") != "watch")
    ).select("customer_id", "company_name", "utilization_pct", "breach_risk_level")


def burst_by_status(slices: DataFrame) -> DataFrame:
    """Burst slices by status, with the wildcard suffix and with the literal one."""
    return slices.where(burst_suffix(F.col("slice_type"))).groupBy("status").agg(
        F.count(F.lit(1)).alias("burst_slices"),
        F.count_if(burst_suffix(F.col("slice_type"), strict=True)).alias("strict_burst_slices"))


def congested_now(features: DataFrame) -> DataFrame:
    """Sites whose newest window is predicted congested."""
    return latest_per_key(features, ["tower_id"], "window_start").where(
        "congestion_predicted_15min = 1").select("tower_id", "window_start", "avg_bandwidth_util")


def last_alert(features: DataFrame, score_cut: float) -> DataFrame:
    """The newest flagged window of each site."""
    return latest_flagged_window(features, score_cut).select("tower_id", "window_start", "avg_congestion_score")


def sent_and_accepted(log: DataFrame) -> DataFrame:
    return log.groupBy("customer_type").agg(
        F.count(F.lit(1)).alias("sent"), F.count_if("accepted").alias("accepted"))


def segment_churn_risk(opportunities: DataFrame, cut: float = 0.25) -> DataFrame:
    """The segment with most accounts at churn risk."""
    counts = opportunities.groupBy("customer_segment").agg(
        F.count_if(F.col("churn_risk_score") > cut).alias("accounts_at_churn_risk"))
    return top_k(counts, [F.desc("accounts_at_churn_risk"), F.asc("customer_segment")], 1)


def mean_contract(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("customer_type").agg(
        F.round(exact_mean(F.col("contracted_bandwidth_mbps")), 2).alias("avg_contracted_mbps"))


def monthly_pipeline(rollup: DataFrame) -> DataFrame:
    month = F.date_trunc("month", "analysis_date").cast("date")
    return rollup.groupBy(month.alias("month")).agg(
        F.round(exact_sum(F.col("projected_upsell_arr")), 2).alias("pipeline_arr"))


def arr_at_risk(opportunities: DataFrame, tier: str, customer_type: str, cut: float = 0.25) -> DataFrame:
    """Yearly contract value at churn risk for one tier and type."""
    mine = opportunities.where((F.col("contract_tier") == tier) & (F.col("customer_type") == customer_type))
    return mine.agg(F.round(sum_if(
        F.col("churn_risk_score") > cut, F.col("monthly_contract_value") * 12), 2).alias("arr_at_churn_risk"))


def renewal_acceptance(log: DataFrame, accounts: DataFrame, months: int = 6, peak: float = 0.75) -> DataFrame:
    """Acceptance of accounts close to renewal with a high peak."""
    near = accounts.where(
        (F.col("contract_renewal_months") <= months) & (F.col("peak_event_utilization_pct") > peak))
    # One account may hold many proposals.
    return join_unique(log, near.select("customer_id"), "customer_id", ["proposal_id"]).agg(
        F.count(F.lit(1)).alias("proposals"),
        F.round(exact_mean(F.col("accepted").cast("int")), 4).alias("acceptance_rate"))


def renewal_risk(opportunities: DataFrame, accounts: DataFrame, customer_type: str | None = None,
                 months: int = 6, near_limit: float = 85.0) -> DataFrame:
    """Accounts near their limit that renew soon."""
    soon = accounts.where(F.col("contract_renewal_months") <= months).select(
        "customer_id", "sla_tier", "support_tickets_30d")
    at_limit = opportunities.where(F.col("utilization_pct") >= near_limit)
    if customer_type:
        at_limit = at_limit.where(F.col("customer_type") == customer_type)
    return at_limit.join(soon, "customer_id").select(
        "customer_id", "company_name", "customer_type", "utilization_pct", "contract_renewal_months",
        "sla_tier", "support_tickets_30d")


def active_by_site(slices: DataFrame) -> DataFrame:
    return slices.where(F.col("status") == "active").groupBy("tower_id", "slice_type").agg(
        F.count(F.lit(1)).alias("active_slices"))


def profile(accounts: DataFrame, column: str) -> DataFrame:
    """Distribution of a column with bandwidth and money totals."""
    return accounts.groupBy(column).agg(
        F.count(F.lit(1)).alias("accounts"),
        F.round(exact_sum(F.col("contracted_bandwidth_mbps")), 2).alias("total_bandwidth_mbps"),
        F.round(exact_sum(F.col("monthly_contract_value")), 2).alias("total_contract_value"))


def slice_profile(slices: DataFrame, cut: float = 88.0) -> DataFrame:
    """Slices per status, those at or above the cut, and the accounts behind them."""
    surging = F.col("utilization_pct") >= cut
    return slices.groupBy("status").agg(
        F.count(F.lit(1)).alias("slices"), F.count_if(surging).alias("surging"),
        F.count_distinct(F.when(surging, F.col("customer_id"))).alias("accounts_at_risk"))


def sla_breaches(opportunities: DataFrame) -> DataFrame:
    """Accounts using more than they contracted."""
    return opportunities.agg(F.count_if(F.col("utilization_pct") > 100).alias("sla_breaches"))
