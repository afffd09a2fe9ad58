"""Declared schemas of the inputs and of the two tables the campaign job writes."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Column names and types are the contract with existing tables.
TELEMETRY = """
    tower_id STRING, timestamp TIMESTAMP, latitude DOUBLE, longitude DOUBLE,
    active_connections BIGINT, bandwidth_utilization_pct DOUBLE, signal_strength_dbm DOUBLE,
    latency_ms DOUBLE, packet_loss_pct DOUBLE, throughput_mbps DOUBLE, error_rate_pct DOUBLE,
    temperature_celsius DOUBLE, power_consumption_watts DOUBLE
"""
ACCOUNTS = """
    customer_id STRING, company_name STRING, customer_type STRING, contract_tier STRING,
    monthly_contract_value DOUBLE, contracted_bandwidth_mbps DOUBLE, contracted_latency_ms DOUBLE,
    sla_tier STRING, churn_risk_score DOUBLE, contract_start_date DATE, contract_renewal_months INT,
    support_tickets_30d INT, peak_event_utilization_pct DOUBLE, account_manager_id STRING
"""
EVENTS = """
    event_id STRING, event_name STRING, venue_name STRING, venue_latitude DOUBLE, venue_longitude DOUBLE,
    event_start_time TIMESTAMP, event_end_time TIMESTAMP, expected_attendance INT, event_type STRING,
    traffic_multiplier DOUBLE
"""
SLICES = """
    slice_id STRING, customer_id STRING, tower_id STRING, slice_type STRING,
    contracted_bandwidth_mbps DOUBLE, bandwidth_allocated_mbps DOUBLE, current_bandwidth_mbps DOUBLE,
    utilization_pct DOUBLE, latency_guarantee_ms DOUBLE, created_timestamp TIMESTAMP,
    expires_timestamp TIMESTAMP, status STRING, revenue_per_hour DOUBLE
"""
PROPOSALS = """
    proposal_id STRING, customer_id STRING, company_name STRING, customer_type STRING,
    customer_segment STRING, contract_tier STRING, account_manager_id STRING, proposal_message STRING,
    sent_at TIMESTAMP, conversion_score DOUBLE, utilization_pct DOUBLE, breach_risk_level STRING,
    contract_renewal_months INT, churn_risk_score DOUBLE, accepted BOOLEAN,
    monthly_revenue_opportunity DOUBLE, annual_upsell_contribution DOUBLE, monthly_contract_value DOUBLE
"""
EVENT_SUMMARY = """
    event_id STRING, event_name STRING, event_date DATE, venue_name STRING,
    b2b_customers_targeted BIGINT, b2b_customers_accepted BIGINT, acceptance_rate DOUBLE,
    immediate_monthly_upsell_usd DOUBLE, projected_upsell_arr_usd DOUBLE,
    arr_protected_from_churn_usd DOUBLE, burst_slices_provisioned BIGINT, sla_violations INT,
    summary_generated_at TIMESTAMP
"""


def schema(ddl: str, naive_times: bool = False) -> StructType:
    """Parse a schema; ``naive_times`` reads times without a zone, as Parquet files often hold them."""
    return StructType.fromDDL(ddl.replace("TIMESTAMP", "TIMESTAMP_NTZ") if naive_times else ddl)


def names(ddl: str) -> list[str]:
    return schema(ddl).names
