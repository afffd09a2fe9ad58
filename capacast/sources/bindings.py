"""Domain tables derived from the supplied test tables by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import ACCOUNTS, EVENTS, SLICES, TELEMETRY, names
from .tables import load, stream

# The columns of the test tables.  A declared schema saves the
# look into the files that inferring one would take.
SOURCES = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
}

# The expression behind each column of a domain table.
TELEMETRY_COLUMNS = {
    "tower_id": "concat(if(user_id % 5 = 0, 'LF-', 'DT-'), user_id)",
    "timestamp": "if(event_id % 211 != 0, ts, NULL)",
    "latitude": "if(event_id % 77 != 0, 47 + (user_id % 20) / 100 + if(event_id % 997 = 0, 0.5D, 0D), NULL)",
    "longitude": "-122 - (user_id % 13) / 100",
    "active_connections": "event_id % 1200 - 20",
    "bandwidth_utilization_pct": "if(event_id % 50 != 0, value, NULL)",
    "signal_strength_dbm": "double(-20 - (event_id % 120))",
    "latency_ms": "if(event_id % 60 != 0, value * 3, NULL)",
    "packet_loss_pct": "if(event_type = 'error', value / 10, 0D)",
    "throughput_mbps": "value * 2 - 10",
    "error_rate_pct": "event_id % 100 / 10",
    "temperature_celsius": "double(20 + event_id % 30)",
    "power_consumption_watts": "double(100 + event_id % 400)",
}
TIER = "element_at(array('platinum', 'gold', 'standard'), c_nationkey % 3 + 1)"
ACCOUNT_COLUMNS = {
    "customer_id": "concat('AC-', c_custkey)",
    "company_name": "c_name",
    "customer_type": """CASE WHEN c_custkey % 97 = 0 THEN 'wholesale' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'broadcaster'
        WHEN c_mktsegment = 'BUILDING' THEN 'venue_operator' WHEN c_mktsegment = 'FURNITURE' THEN 'payment_processor'
        WHEN c_mktsegment = 'HOUSEHOLD' THEN 'public_safety' WHEN c_mktsegment = 'MACHINERY' THEN 'team_sponsor'
        ELSE 'wholesale' END""",
    "contract_tier": TIER,
    "monthly_contract_value": "greatest(c_acctbal, 0D)",
    "contracted_bandwidth_mbps": "double((c_custkey % 50 + 1) * 10)",
    "contracted_latency_ms": "double(5 + c_custkey % 4 * 5)",
    "sla_tier": TIER,
    "churn_risk_score": "c_custkey * 37 % 100 / 100",
    "contract_start_date": "date_add(DATE '2020-01-01', int(c_custkey % 1500))",
    "contract_renewal_months": "int(c_custkey % 18 + 1)",
    "support_tickets_30d": "int(c_custkey % 5)",
    "peak_event_utilization_pct": "if(c_custkey % 89 != 0, c_custkey * 53 % 100 / 100, NULL)",
    "account_manager_id": "concat('AM-', lpad(string(c_custkey % 40), 3, '0'))",
}
START = "timestampadd(DAY, int(s_suppkey % 27), TIMESTAMP_NTZ '2024-01-01 00:00:00')"
EVENT_COLUMNS = {
    "event_id": "concat('EV-', s_suppkey)",
    "event_name": "s_name",
    "venue_name": "concat('Venue ', s_nationkey)",
    "venue_latitude": "47 + (s_suppkey * 7 % 40) / 100",
    "venue_longitude": "-121.8D - (s_suppkey * 3 % 17) / 100",
    "event_start_time": START,
    "event_end_time": f"timestampadd(DAY, int(1 + s_suppkey % 3), {START})",
    "expected_attendance": "int((s_suppkey + 1) * 100)",
    "event_type": "if(s_suppkey % 2 = 0, 'sports', 'concert')",
    "traffic_multiplier": "1.5D + s_suppkey % 10 / 10",
}
SLICE_COLUMNS = {
    "slice_id": "concat('SL-', o_orderkey)",
    "customer_id": "concat('AC-', o_custkey)",
    "tower_id": "concat(if(o_orderkey % sites % 5 = 0, 'LF-', 'DT-'), o_orderkey % sites)",
    "slice_type": """concat(lower(replace(substring(o_orderpriority, 3), ' ', '_')),
        CASE o_orderkey % 10 WHEN 0 THEN '_burst' WHEN 1 THEN 'xburst' ELSE '' END)""",
    "contracted_bandwidth_mbps": "double((o_custkey % 50 + 1) * 10)",
    "bandwidth_allocated_mbps": "double((o_custkey % 50 + 1) * 10)",
    "current_bandwidth_mbps": "double((o_custkey % 50 + 1) * 10) * (o_totalprice / 4800D) / 100",
    "utilization_pct": "o_totalprice / 4800D",
    "latency_guarantee_ms": "double(5 + o_orderkey % 4 * 5)",
    "created_timestamp": "o_orderdate",
    "expires_timestamp": "timestampadd(HOUR, int(o_orderkey % 72), o_orderdate)",
    "status": "if(o_orderstatus = 'O', 'active', 'terminated')",
    "revenue_per_hour": "double((o_custkey % 50 + 1) * 10) * 0.008D",
}


def _select(df: DataFrame, columns: dict[str, str], ddl: str) -> DataFrame:
    return df.selectExpr(*[f"{columns[name]} AS {name}" for name in names(ddl)])


def source(spark: SparkSession, name: str, folder: str) -> DataFrame:
    return load(spark, name, folder, SOURCES[name])


def source_stream(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """The table as a stream; a stream's path is a folder or a pattern, this one matches the table only."""
    return stream(spark, f"{folder}/{{{name}}}.parquet", SOURCES[name])


def telemetry_from(events: DataFrame) -> DataFrame:
    """Event rows read as telemetry; also for streams."""
    return _select(events, TELEMETRY_COLUMNS, TELEMETRY)


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry_from(source(spark, "events", folder))


def accounts_from(customer: DataFrame) -> DataFrame:
    """Customer rows read as contract accounts; also for streams."""
    return _select(customer, ACCOUNT_COLUMNS, ACCOUNTS)


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    return accounts_from(source(spark, "customer", folder))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers read as scheduled events around the sites."""
    return _select(source(spark, "supplier", folder), EVENT_COLUMNS, EVENTS)


def slices(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read as capacity slices, spread over the sites of the telemetry."""
    sites = source(spark, "events", folder).agg(F.max("user_id") + 1).scalar()
    return _select(source(spark, "orders", folder).withColumn("sites", sites), SLICE_COLUMNS, SLICES)
