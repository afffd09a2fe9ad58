"""Small hand-made domain tables."""

from datetime import date, datetime, timedelta

from capacast.sources import schemas

START = datetime(2024, 9, 15, 10, 0)


def reading(site, minute, bandwidth, **more):
    row = dict.fromkeys(schemas.names(schemas.TELEMETRY))
    row.update(tower_id=site, timestamp=START + timedelta(minutes=minute), latitude=47.6, longitude=-122.33,
               active_connections=100, bandwidth_utilization_pct=bandwidth, signal_strength_dbm=-80.0,
               latency_ms=20.0, packet_loss_pct=0.0, throughput_mbps=10.0, error_rate_pct=0.0,
               temperature_celsius=20.0, power_consumption_watts=100.0)
    row.update(more)
    return tuple(row.values())


def account(key, kind="broadcaster", **more):
    row = dict(customer_id=key, company_name="Company " + key, customer_type=kind, contract_tier="gold",
               monthly_contract_value=1000.0, contracted_bandwidth_mbps=500.0, contracted_latency_ms=5.0,
               sla_tier="gold", churn_risk_score=0.1, contract_start_date=date(2022, 1, 1),
               contract_renewal_months=3, support_tickets_30d=0, peak_event_utilization_pct=0.9,
               account_manager_id="AM-1")
    row.update(more)
    return tuple(row.values())


def capacity(key, owner, site, utilization, **more):
    row = dict(slice_id=key, customer_id=owner, tower_id=site, slice_type="broadcaster",
               contracted_bandwidth_mbps=500.0, bandwidth_allocated_mbps=500.0, current_bandwidth_mbps=400.0,
               utilization_pct=utilization, latency_guarantee_ms=5.0, created_timestamp=START,
               expires_timestamp=START, status="active", revenue_per_hour=4.0)
    row.update(more)
    return tuple(row.values())


def table(spark, ddl, rows):
    return spark.createDataFrame(rows, schemas.schema(ddl, naive_times=True))
