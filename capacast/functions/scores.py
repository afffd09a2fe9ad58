"""The scoring rules: congestion, propensity, breach level, account score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp, first_match, hash_int, ladder, lookup, weighted_sum

# Fixed values (weights, thresholds, codes) that must stay as they are for the
# results to be right.
CONGESTION_WEIGHTS = {"bandwidth": 0.40, "loss": 0.30, "latency": 0.20, "errors": 0.10}
SEGMENT_BY_TYPE = {
    "broadcaster": "media_rights",
    "public_safety": "critical_services",
    "venue_operator": "venue_ops",
    "payment_processor": "payments_ticketing",
    "team_sponsor": "teams_sponsors",
}
BREACH_LEVELS = ((100, "breach"), (90, "critical"), (85, "warning"))
SEVERITY_BANDS = ((0.7, "high"), (0.4, "medium"))
ACCEPTANCE_RATES = {
    "broadcaster": 0.72,
    "payment_processor": 0.68,
    "public_safety": 0.50,
    "team_sponsor": 0.65,
}
OTHER_ACCEPTANCE_RATE = 0.55
EXPANSION_SHARE = 0.50
PRICE_PER_MBPS = 0.008


def congestion_score(bandwidth: Column, loss: Column, latency: Column, errors: Column,
                     clamped: bool = True, digits: int | None = 2) -> Column:
    """Weighted 0 to 100 score of four indicators; latency counts per 100 ms.

    Unclamped, a null indicator makes the score null; clamped, it counts as 0.
    """
    if clamped:
        bandwidth, loss, errors = (clamp(c, 0.0, 100.0) for c in (bandwidth, loss, errors))
        latency = clamp(clamp(latency, 0.0) / F.lit(100.0), high=100.0)
    else:
        latency = latency / F.lit(100.0)
    indicators = {"bandwidth": bandwidth, "loss": loss, "latency": latency, "errors": errors}
    return weighted_sum([(indicators[k], w) for k, w in CONGESTION_WEIGHTS.items()], digits)


def segment(customer_type: Column) -> Column:
    return lookup(customer_type, SEGMENT_BY_TYPE, "other")


def propensity(churn: Column, renewal_months: Column, peak: Column, tickets: Column) -> Column:
    """How likely an account is to accept an expansion; the first matching rule decides."""
    near_renewal = [
        ((renewal_months <= months) & (peak >= load), value)
        for months, load, value in ((3, 0.80, 0.90), (6, 0.75, 0.80))
    ]
    return first_match(
        [(churn > 0.70, 0.15), *near_renewal, (tickets >= 3, 0.85), (peak >= 0.85, 0.75), (peak >= 0.70, 0.60)],
        0.40,
    )


def expansion_value(bandwidth: Column) -> Column:
    """Monthly value of widening a contract by the expansion share."""
    per_mbps = EXPANSION_SHARE * PRICE_PER_MBPS * 1000
    return F.round(bandwidth.cast("double") * F.lit(per_mbps), 2)


def breach_level(utilization: Column) -> Column:
    return ladder(utilization, BREACH_LEVELS, "watch")


def severity_band(score: Column) -> Column:
    return ladder(score, SEVERITY_BANDS, "low", inclusive=False)


def predicted_flag(utilization: Column, trend: Column) -> Column:
    """1 when utilization is high and rising fast, or very high."""
    rising = (utilization > 75) & (trend > 10)
    return F.when(rising | (utilization > 85), 1).otherwise(0)


def account_score(propensity_score: Column, utilization: Column, predicted: Column) -> Column:
    """Propensity, utilization pressure from 75 percent on, and a bonus when congestion is predicted."""
    pressure = clamp((utilization - F.lit(75.0)) / F.lit(25.0), 0.0, 1.0)
    bonus = F.when(predicted == 1, 0.20).otherwise(0.0)
    return F.round(weighted_sum([(propensity_score, 0.45), (pressure, 0.35)]) + bonus, 4)


def acceptance_rate(customer_type: Column) -> Column:
    return lookup(customer_type, ACCEPTANCE_RATES, OTHER_ACCEPTANCE_RATE)


def rollout_step(key: Column, score: Column, first: int = 4, span: int = 18) -> Column:
    """The step at which a key is revealed: hash-staggered, shifted by ten times the missing score."""
    shift = F.floor((F.lit(1.0) - clamp(score, 0.0, 1.0)) * F.lit(10)).cast("bigint")
    return F.lit(first) + F.pmod(hash_int(key) + shift, F.lit(span))
