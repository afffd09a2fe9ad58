"""The provisioning and proposal campaign: targets, burst slices, proposals, summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.aggregates import exact_mean, exact_sum, sum_if
from ..functions.scalars import fill, hash_unit
from ..operators.rows import conform
from ..session import materialise
from ..sources import schemas, tables

# Campaign thresholds and burst terms.
TARGET_SCORE = 0.65
PROTECTED_CHURN = 0.15
BURST_USE = 0.60
BURST_UTILIZATION = 60.0
BURST_LATENCY_MS = 8.0
BURST_HOURS = 4
MESSAGE = ("ALERT: {company} is at {utilization}% of contracted bandwidth on tower {tower}. "
           "Expand by 50% ({extra} Mbps) for ${value}/mo. Activate in 30 seconds.")


@dataclass(frozen=True)
class Campaign:
    """The scheduled event a campaign runs for."""

    event_id: str
    event_name: str
    event_date: str
    venue_name: str
    proposal_prefix: str = "PROP-"


BURST_PREFIX = "BURST-"


def select_targets(opportunities: DataFrame, cut: float = TARGET_SCORE, strict: bool = False) -> DataFrame:
    """Opportunities at or above the score (``strict``: above it)."""
    score = F.col("conversion_score")
    return opportunities.where(score > cut if strict else score >= cut)


def burst_slices(targets: DataFrame, as_of: Column) -> DataFrame:
    """One extra slice per target: half the contracted bandwidth for four hours.

    Ids are MD5 of the account, so they repeat when the job is run again.
    """
    extra = F.col("contracted_bandwidth_mbps") * scores.EXPANSION_SHARE
    return targets.select(
        F.concat(F.lit(BURST_PREFIX), F.upper(F.md5("customer_id"))).alias("slice_id"),
        "customer_id", "tower_id",
        F.concat("customer_type", F.lit("_burst")).alias("slice_type"),
        extra.alias("contracted_bandwidth_mbps"),
        extra.alias("bandwidth_allocated_mbps"),
        (extra * BURST_USE).alias("current_bandwidth_mbps"),
        F.lit(BURST_UTILIZATION).alias("utilization_pct"),
        F.lit(BURST_LATENCY_MS).alias("latency_guarantee_ms"),
        as_of.alias("created_timestamp"),
        F.timestamp_add("HOUR", F.lit(BURST_HOURS), as_of).alias("expires_timestamp"),
        F.lit("active").alias("status"),
        (extra * scores.PRICE_PER_MBPS).alias("revenue_per_hour"),
    )


def decide(targets: DataFrame, key: str = "customer_id", salt: str = "accept") -> DataFrame:
    """Add the repeatable accept draw by type rate and the yearly contribution."""
    value = F.col("monthly_revenue_opportunity")
    accepted = hash_unit(F.col(key), salt) < scores.acceptance_rate(F.col("customer_type"))
    return targets.withColumn("accepted", accepted).withColumn(
        "annual_upsell_contribution", F.when(F.col("accepted"), value * 12).otherwise(F.lit(0.0)))


def message() -> Column:
    """The text sent to the account manager; numbers are rounded but keep a decimal (``94.0``)."""
    return fill(
        MESSAGE, company=F.col("company_name"), tower=F.col("tower_id"),
        utilization=F.round("utilization_pct", 0),
        extra=F.round(F.col("contracted_bandwidth_mbps") * scores.EXPANSION_SHARE, 0),
        value=F.round("monthly_revenue_opportunity", 0))


def proposals(targets: DataFrame, sent_at: Column, prefix: str = "PROP-") -> DataFrame:
    """One proposal per target, in the column order of the proposal log."""
    identity = F.concat(F.lit(prefix), F.upper(F.substring(F.md5("customer_id"), 1, 8)))
    return decide(targets).withColumns({
        "proposal_id": identity, "proposal_message": message(), "sent_at": sent_at,
    }).select(*schemas.names(schemas.PROPOSALS))


def campaign_summary(log: DataFrame, by: Sequence[str] = (), **more: Column) -> DataFrame:
    """Targets, acceptances and money of a proposal log, overall or per group.

    ``more`` adds named aggregates to the same pass.
    """
    value = F.col("monthly_revenue_opportunity")
    at_risk = F.col("churn_risk_score") > PROTECTED_CHURN
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_targeted"),
        F.count_if("accepted").alias("total_accepted"),
        F.round(exact_mean(F.col("accepted").cast("int")), 4).alias("acceptance_rate"),
        F.round(sum_if(F.col("accepted"), value), 2).alias("immediate_monthly_upsell"),
        F.round(exact_sum(F.col("annual_upsell_contribution")), 2).alias("projected_upsell_arr"),
        F.round(sum_if(at_risk, F.col("monthly_contract_value") * 12), 2).alias("arr_protected_from_churn"),
        F.count_if(F.col("utilization_pct") > 100).cast("int").alias("sla_violations"),
        *[column.alias(name) for name, column in more.items()],
    )


def event_summary(log: DataFrame, event: Campaign, as_of: Column, bursts: DataFrame | None = None) -> DataFrame:
    """The summary row of one event; nothing passes through the driver.

    Burst slices are counted in ``bursts``; without it, one is taken to be provisioned for each target.
    """
    provisioned = F.col("total_targeted") if bursts is None else bursts.agg(F.count(F.lit(1))).scalar()
    return campaign_summary(log).select(
        F.lit(event.event_id).alias("event_id"), F.lit(event.event_name).alias("event_name"),
        F.lit(event.event_date).cast("date").alias("event_date"), F.lit(event.venue_name).alias("venue_name"),
        F.col("total_targeted").alias("b2b_customers_targeted"),
        F.col("total_accepted").alias("b2b_customers_accepted"),
        "acceptance_rate",
        F.col("immediate_monthly_upsell").alias("immediate_monthly_upsell_usd"),
        F.col("projected_upsell_arr").alias("projected_upsell_arr_usd"),
        F.col("arr_protected_from_churn").alias("arr_protected_from_churn_usd"),
        provisioned.alias("burst_slices_provisioned"),
        "sla_violations", as_of.alias("summary_generated_at"))


def run(opportunities: DataFrame, event: Campaign, as_of: Column, slices_path: str, log_path: str,
        summary_path: str) -> None:
    """Provision and log for all targets, then rewrite the event's summary.

    Targets are computed and written once; slices, proposals and summary derive
    from that copy.  Appends skip proposals that exist and accounts whose burst
    slice has not expired, so a rerun adds no rows and completes a broken run.
    """
    targets = materialise(select_targets(opportunities), "targets")
    slices = conform(burst_slices(targets, as_of), schemas.schema(schemas.SLICES))
    tables.append_new(slices, slices_path, ["slice_id"], F.col("expires_timestamp") > as_of)
    sent = conform(proposals(targets, as_of, event.proposal_prefix), schemas.schema(schemas.PROPOSALS))
    # Ids are short, so accounts may share one: the account is part of the key.
    tables.append_new(sent, log_path, ["proposal_id", "customer_id"])
    log = sent.sparkSession.read.schema(sent.schema).parquet(log_path)
    mine = log.where(F.col("proposal_id").startswith(event.proposal_prefix))
    first = mine.groupBy("customer_id").agg(F.min("sent_at").alias("sent_at"))
    stored = sent.sparkSession.read.schema(slices.schema).parquet(slices_path)
    served = stored.where(F.col("slice_id").startswith(BURST_PREFIX)).join(first, "customer_id").where(
        F.col("created_timestamp") >= F.col("sent_at"))
    tables.overwrite(event_summary(mine, event, as_of, served), summary_path)
