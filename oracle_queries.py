"""The registered queries as plain SQL over the supplied tables, for comparison."""

from __future__ import annotations

import re

DAY = 86400
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def rnd(x: str, digits: int) -> str:
    """Half-up rounding on the decimal text of a double."""
    return f"round(cast(cast({x} AS varchar) AS decimal(38,20)), {digits})::DOUBLE"


def mean(x: str) -> str:
    """Mean of the values as they are written out, so that it does not depend on their order."""
    return f"({money(x)} / count({x}))"


def money(x: str) -> str:
    return f"sum(cast(cast({x} AS varchar) AS decimal(38,18)))::DOUBLE"


def draw(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5({key} || '{salt}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def bucket(column: str, seconds: int) -> str:
    return f"make_timestamp(epoch_us({column}) // {seconds}000000 * {seconds}000000)"


def windowed(source: str, seconds: int) -> str:
    start = bucket("timestamp", seconds)
    return f"""
      SELECT tower_id, {start} AS window_start,
        {start} + to_seconds({seconds}) AS window_end,
        {rnd(mean('bandwidth_utilization_pct'), 2)} AS avg_bandwidth_util,
        {rnd('max(bandwidth_utilization_pct)', 2)} AS peak_bandwidth_util,
        {rnd(mean('active_connections'), 0)} AS avg_connections,
        max(active_connections) AS peak_connections,
        {rnd(mean('congestion_score'), 2)} AS avg_congestion_score,
        {rnd(mean('latency_ms'), 2)} AS avg_latency_ms,
        {rnd(mean('packet_loss_pct'), 4)} AS avg_packet_loss_pct,
        extract(hour FROM min(timestamp))::INT AS hour_of_day,
        (extract(dow FROM min(timestamp)) + 1)::INT AS day_of_week
      FROM {source} GROUP BY ALL"""


def trended(source: str) -> str:
    def change(column: str, digits: int) -> str:
        previous = f"lag({column}) OVER (PARTITION BY tower_id ORDER BY window_start)"
        return rnd(f"coalesce({column} - {previous}, 0)", digits)
    return f"""
      SELECT *, {change('avg_bandwidth_util', 2)} AS bandwidth_trend_15min,
        {change('avg_connections', 1)} AS connection_trend_15min
      FROM {source}"""


def featured(source: str) -> str:
    return f"""
      SELECT tower_id, window_start, window_end, avg_bandwidth_util, peak_bandwidth_util,
        avg_connections::BIGINT AS avg_connections, peak_connections, avg_congestion_score, avg_latency_ms,
        avg_packet_loss_pct, bandwidth_trend_15min, connection_trend_15min,
        (tower_id IN (SELECT tower_id FROM proximity))::INT AS near_event_flag, hour_of_day, day_of_week,
        (avg_bandwidth_util > 85 OR (avg_bandwidth_util > 75 AND bandwidth_trend_15min > 10))::INT
          AS congestion_predicted_15min
      FROM {source}"""


def last_flagged(source: str, cut: int) -> str:
    return f"""
      SELECT * FROM {source} WHERE congestion_predicted_15min = 1 OR avg_congestion_score > {cut}
      QUALIFY row_number() OVER (PARTITION BY tower_id ORDER BY window_start DESC) = 1"""


BANDWIDTH = "least(100.0, greatest(0.0, bandwidth_utilization_pct))::DOUBLE"
LOSS = "least(100.0, greatest(0.0, packet_loss_pct))::DOUBLE"
ERRORS = "least(100.0, greatest(0.0, error_rate_pct))::DOUBLE"
LATENCY = "least(100.0, greatest(0.0, latency_ms) / 100.0)::DOUBLE"
SCORE = rnd(f"({BANDWIDTH} * 0.4 + {LOSS} * 0.3 + {LATENCY} * 0.2 + {ERRORS} * 0.1)", 2)
SEGMENT = """CASE customer_type WHEN 'broadcaster' THEN 'media_rights'
    WHEN 'public_safety' THEN 'critical_services' WHEN 'venue_operator' THEN 'venue_ops'
    WHEN 'payment_processor' THEN 'payments_ticketing' WHEN 'team_sponsor' THEN 'teams_sponsors'
    ELSE 'other' END"""
PROPENSITY = """(CASE WHEN churn_risk_score > 0.7 THEN 0.15
    WHEN contract_renewal_months <= 3 AND peak_event_utilization_pct >= 0.8 THEN 0.9
    WHEN contract_renewal_months <= 6 AND peak_event_utilization_pct >= 0.75 THEN 0.8
    WHEN support_tickets_30d >= 3 THEN 0.85 WHEN peak_event_utilization_pct >= 0.85 THEN 0.75
    WHEN peak_event_utilization_pct >= 0.7 THEN 0.6 ELSE 0.4 END)::DOUBLE"""
BREACH = """CASE WHEN utilization_pct >= 100 THEN 'breach' WHEN utilization_pct >= 90 THEN 'critical'
    WHEN utilization_pct >= 85 THEN 'warning' ELSE 'watch' END"""
RATE = """(CASE customer_type WHEN 'broadcaster' THEN 0.72 WHEN 'payment_processor' THEN 0.68
    WHEN 'public_safety' THEN 0.5 WHEN 'team_sponsor' THEN 0.65 ELSE 0.55 END)::DOUBLE"""
MILES = """sqrt(pow(69.1::DOUBLE * (venue_latitude - latitude), 2)
    + pow(69.1::DOUBLE * (venue_longitude - longitude) * cos(venue_latitude / 57.3::DOUBLE), 2))"""


def account_score(predicted: str) -> str:
    pressure = "least(1.0, greatest(0.0, (utilization_pct - 75.0) / 25.0))::DOUBLE"
    return rnd(f"""(upsell_propensity_score * 0.45::DOUBLE + {pressure} * 0.35::DOUBLE
        + (CASE WHEN {predicted} = 1 THEN 0.2 ELSE 0.0 END)::DOUBLE)""", 4)


def scored(last_flagged: str) -> str:
    return f"""
      SELECT customer_id, company_name, customer_type, customer_segment, contract_tier,
        monthly_contract_value, e.contracted_bandwidth_mbps, contracted_latency_ms, upsell_propensity_score,
        monthly_upsell_opportunity_usd, churn_risk_score, contract_renewal_months, account_manager_id,
        slice_id, tower_id, current_bandwidth_mbps, utilization_pct, window_start, avg_congestion_score,
        bandwidth_trend_15min, congestion_predicted_15min, near_event_flag, {BREACH} AS breach_risk_level,
        {account_score('congestion_predicted_15min')} AS conversion_score,
        monthly_upsell_opportunity_usd AS monthly_revenue_opportunity, {AS_OF} AS scored_at
      FROM enriched e JOIN top_slice USING (customer_id) JOIN {last_flagged} USING (tower_id)
      WHERE utilization_pct >= 85 OR (utilization_pct >= 75 AND congestion_predicted_15min = 1)"""


def provisioned(targets: str) -> str:
    return f"""
      SELECT 'BURST-' || upper(md5(customer_id)) AS slice_id, customer_id, tower_id,
        customer_type || '_burst' AS slice_type,
        contracted_bandwidth_mbps * 0.5::DOUBLE AS contracted_bandwidth_mbps,
        contracted_bandwidth_mbps * 0.5::DOUBLE AS bandwidth_allocated_mbps,
        contracted_bandwidth_mbps * 0.5::DOUBLE * 0.6::DOUBLE AS current_bandwidth_mbps,
        60::DOUBLE AS utilization_pct, 8::DOUBLE AS latency_guarantee_ms,
        scored_at AS created_timestamp, scored_at + to_hours(4) AS expires_timestamp, 'active' AS status,
        contracted_bandwidth_mbps * 0.5::DOUBLE * 0.008::DOUBLE AS revenue_per_hour
      FROM {targets}"""


# Shared sub-queries, in order of dependence.
PARTS = {
    "telemetry": """
      SELECT CASE WHEN user_id % 5 = 0 THEN 'LF-' ELSE 'DT-' END || user_id AS tower_id,
        CASE WHEN event_id % 211 <> 0 THEN ts END AS timestamp,
        CASE WHEN event_id % 77 <> 0 THEN 47 + (user_id % 20) / 100
          + (CASE WHEN event_id % 997 = 0 THEN 0.5 ELSE 0.0 END)::DOUBLE END AS latitude,
        -122 - (user_id % 13) / 100 AS longitude,
        event_id % 1200 - 20 AS active_connections,
        CASE WHEN event_id % 50 <> 0 THEN value END AS bandwidth_utilization_pct,
        (-20 - (event_id % 120))::DOUBLE AS signal_strength_dbm,
        CASE WHEN event_id % 60 <> 0 THEN value * 3 END AS latency_ms,
        CASE WHEN event_type = 'error' THEN value / 10 ELSE 0::DOUBLE END AS packet_loss_pct,
        value * 2 - 10 AS throughput_mbps,
        (event_id % 100) / 10 AS error_rate_pct,
        (20 + event_id % 30)::DOUBLE AS temperature_celsius,
        (100 + event_id % 400)::DOUBLE AS power_consumption_watts
      FROM events""",
    "accounts": """
      SELECT 'AC-' || c_custkey AS customer_id, c_name AS company_name,
        CASE WHEN c_custkey % 97 = 0 THEN 'wholesale' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'broadcaster'
          WHEN c_mktsegment = 'BUILDING' THEN 'venue_operator'
          WHEN c_mktsegment = 'FURNITURE' THEN 'payment_processor'
          WHEN c_mktsegment = 'HOUSEHOLD' THEN 'public_safety'
          WHEN c_mktsegment = 'MACHINERY' THEN 'team_sponsor' ELSE 'wholesale' END AS customer_type,
        CASE c_nationkey % 3 WHEN 0 THEN 'platinum' WHEN 1 THEN 'gold' ELSE 'standard' END AS contract_tier,
        greatest(c_acctbal, 0) AS monthly_contract_value,
        ((c_custkey % 50 + 1) * 10)::DOUBLE AS contracted_bandwidth_mbps,
        (5 + c_custkey % 4 * 5)::DOUBLE AS contracted_latency_ms,
        CASE c_nationkey % 3 WHEN 0 THEN 'platinum' WHEN 1 THEN 'gold' ELSE 'standard' END AS sla_tier,
        (c_custkey * 37 % 100) / 100 AS churn_risk_score,
        DATE '2020-01-01' + (c_custkey % 1500)::INT AS contract_start_date,
        (c_custkey % 18 + 1)::INT AS contract_renewal_months,
        (c_custkey % 5)::INT AS support_tickets_30d,
        CASE WHEN c_custkey % 89 <> 0 THEN (c_custkey * 53 % 100) / 100 END AS peak_event_utilization_pct,
        'AM-' || lpad((c_custkey % 40)::VARCHAR, 3, '0') AS account_manager_id
      FROM customer""",
    "calendar": """
      SELECT 'EV-' || s_suppkey AS event_id, s_name AS event_name, 'Venue ' || s_nationkey AS venue_name,
        47 + (s_suppkey * 7 % 40) / 100 AS venue_latitude,
        -121.8::DOUBLE - (s_suppkey * 3 % 17) / 100 AS venue_longitude,
        TIMESTAMP '2024-01-01' + to_days((s_suppkey % 27)::INT) AS event_start_time,
        TIMESTAMP '2024-01-01' + to_days((s_suppkey % 27 + 1 + s_suppkey % 3)::INT) AS event_end_time,
        ((s_suppkey + 1) * 100)::INT AS expected_attendance,
        1.5::DOUBLE + (s_suppkey % 10) / 10 AS traffic_multiplier
      FROM supplier""",
    "slices": """
      SELECT *, contracted_bandwidth_mbps AS bandwidth_allocated_mbps,
        contracted_bandwidth_mbps * utilization_pct / 100 AS current_bandwidth_mbps,
        contracted_bandwidth_mbps * 0.008::DOUBLE AS revenue_per_hour
      FROM (
        SELECT 'SL-' || o_orderkey AS slice_id, 'AC-' || o_custkey AS customer_id,
          CASE WHEN site % 5 = 0 THEN 'LF-' ELSE 'DT-' END || site AS tower_id,
          lower(replace(substr(o_orderpriority, 3), ' ', '_')) || CASE o_orderkey % 10
            WHEN 0 THEN '_burst' WHEN 1 THEN 'xburst' ELSE '' END AS slice_type,
          ((o_custkey % 50 + 1) * 10)::DOUBLE AS contracted_bandwidth_mbps,
          o_totalprice / 4800.0::DOUBLE AS utilization_pct,
          (5 + o_orderkey % 4 * 5)::DOUBLE AS latency_guarantee_ms,
          o_orderdate AS created_timestamp,
          o_orderdate + to_hours((o_orderkey % 72)::INT) AS expires_timestamp,
          CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'terminated' END AS status
        FROM (SELECT *, o_orderkey % (SELECT max(user_id) + 1 FROM events) AS site FROM orders))""",
    "cleaned": f"""
      SELECT tower_id, timestamp, latitude, longitude,
        greatest(0, active_connections) AS active_connections,
        {BANDWIDTH} AS bandwidth_utilization_pct,
        CASE WHEN signal_strength_dbm >= -120 AND signal_strength_dbm <= -30
          THEN signal_strength_dbm END AS signal_strength_dbm,
        greatest(0.0, latency_ms)::DOUBLE AS latency_ms, {LOSS} AS packet_loss_pct,
        greatest(0.0, throughput_mbps)::DOUBLE AS throughput_mbps, {ERRORS} AS error_rate_pct,
        temperature_celsius, power_consumption_watts, {SCORE} AS congestion_score
      FROM telemetry
      WHERE tower_id IS NOT NULL AND timestamp IS NOT NULL AND bandwidth_utilization_pct IS NOT NULL""",
    "enriched": f"""
      SELECT customer_id, company_name, customer_type, upper(contract_tier) AS contract_tier,
        monthly_contract_value, contracted_bandwidth_mbps, contracted_latency_ms, upper(sla_tier) AS sla_tier,
        churn_risk_score, contract_start_date, contract_renewal_months, support_tickets_30d,
        peak_event_utilization_pct, account_manager_id, {SEGMENT} AS customer_segment,
        {PROPENSITY} AS upsell_propensity_score,
        contracted_bandwidth_mbps * 4 AS monthly_upsell_opportunity_usd
      FROM accounts WHERE customer_id IS NOT NULL""",
    "sites": "SELECT DISTINCT tower_id, latitude, longitude FROM telemetry "
             "WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
    "known_places": """
      SELECT tower_id, timestamp, latitude, longitude FROM telemetry
      WHERE timestamp IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY tower_id, timestamp ORDER BY latitude DESC, longitude DESC) = 1""",
    "place_changes": """
      SELECT tower_id, timestamp, latitude, longitude FROM known_places
      WINDOW by_time AS (PARTITION BY tower_id ORDER BY timestamp)
      QUALIFY lag(timestamp) OVER by_time IS NULL OR lag(latitude) OVER by_time <> latitude
        OR lag(longitude) OVER by_time <> longitude""",
    "proximity": f"""
      SELECT event_id, event_name, venue_name, event_start_time, event_end_time, expected_attendance,
        traffic_multiplier, tower_id, latitude AS tower_latitude, longitude AS tower_longitude,
        {rnd(MILES, 3)} AS distance_miles
      FROM calendar, sites WHERE {MILES} <= 5""",
    "daily": windowed("cleaned", DAY),
    "daily_trend": trended("daily"),
    "features": featured("daily_trend"),
    "five_minutes": windowed("cleaned", 300),
    "five_minutes_trend": trended("five_minutes"),
    "features_5min": featured("five_minutes_trend"),
    "top_slice": """
      SELECT * FROM slices WHERE status = 'active'
      QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY utilization_pct DESC, slice_id) = 1""",
    "last_flagged": last_flagged("features", 40),
    "last_flagged_5min": last_flagged("features_5min", 60),
    "opportunities_5min": scored("last_flagged_5min"),
    "opportunities": scored("last_flagged"),
    "rollup": f"""
      SELECT cast(window_start AS DATE) AS analysis_date, extract(hour FROM window_start)::INT AS hour_of_day,
        customer_segment, count(*) AS total_customers_at_risk,
        count(*) FILTER (breach_risk_level = 'breach') AS breach_count,
        count(*) FILTER (breach_risk_level = 'critical') AS critical_count,
        count(*) FILTER (breach_risk_level = 'warning') AS warning_count,
        count(*) FILTER (conversion_score > 0.7) AS high_upsell_opportunities,
        {rnd(mean('conversion_score'), 4)} AS avg_upsell_score,
        {rnd(money('monthly_revenue_opportunity'), 2)} AS total_monthly_upsell_opportunity,
        {rnd(money('CASE WHEN conversion_score > 0.7 THEN monthly_revenue_opportunity ELSE 0 END'), 2)}
          AS high_confidence_monthly_upsell,
        {rnd(money('CASE WHEN conversion_score > 0.7 THEN monthly_revenue_opportunity ELSE 0 END')
             + ' * 0.62::DOUBLE * 12', 2)} AS projected_upsell_arr,
        {rnd(money('CASE WHEN churn_risk_score > 0.25 AND conversion_score > 0.6 '
                   'THEN monthly_contract_value * 12 ELSE 0 END'), 2)} AS arr_at_churn_risk,
        {rnd(mean('utilization_pct'), 2)} AS avg_utilization_pct,
        {rnd('max(utilization_pct)', 2)} AS peak_utilization_pct
      FROM opportunities GROUP BY ALL""",
    "targets": "SELECT * FROM opportunities WHERE conversion_score >= 0.65",
    "decided": f"""
      SELECT *, {draw('customer_id', 'accept')} < {RATE} AS accepted,
        CASE WHEN {draw('customer_id', 'accept')} < {RATE} THEN monthly_revenue_opportunity * 12
          ELSE 0::DOUBLE END AS annual_upsell_contribution
      FROM targets""",
    "log": f"""
      SELECT 'PROP-CUP-' || upper(substr(md5(customer_id), 1, 8)) AS proposal_id, customer_id, company_name,
        customer_type, customer_segment, contract_tier, account_manager_id,
        'ALERT: ' || company_name || ' is at ' || {rnd('utilization_pct', 0)}
          || '% of contracted bandwidth on tower ' || tower_id || '. Expand by 50% ('
          || {rnd('contracted_bandwidth_mbps * 0.5::DOUBLE', 0)} || ' Mbps) for $'
          || {rnd('monthly_revenue_opportunity', 0)} || '/mo. Activate in 30 seconds.' AS proposal_message,
        window_start + to_hours(contract_renewal_months) AS sent_at, conversion_score, utilization_pct,
        breach_risk_level, contract_renewal_months, churn_risk_score, accepted, monthly_revenue_opportunity,
        annual_upsell_contribution, monthly_contract_value
      FROM decided""",
    "summaries": f"""
      SELECT 'EVT-' || customer_segment AS event_id, customer_segment AS event_name,
        cast(max(sent_at) AS DATE) AS event_date, 'Main venue' AS venue_name,
        count(*) AS b2b_customers_targeted, count(*) FILTER (accepted) AS b2b_customers_accepted,
        {rnd(mean('accepted::INT'), 4)} AS acceptance_rate,
        {rnd(money('CASE WHEN accepted THEN monthly_revenue_opportunity ELSE 0 END'), 2)}
          AS immediate_monthly_upsell_usd,
        {rnd(money('annual_upsell_contribution'), 2)} AS projected_upsell_arr_usd,
        {rnd(money('CASE WHEN churn_risk_score > 0.15 THEN monthly_contract_value * 12 ELSE 0 END'), 2)}
          AS arr_protected_from_churn_usd,
        count(*) AS burst_slices_provisioned,
        (count(*) FILTER (utilization_pct > 100))::INT AS sla_violations,
        max(sent_at) AS summary_generated_at
      FROM log GROUP BY customer_segment""",
    "bursts": provisioned("targets"),
    "raw_latest": """
      SELECT * FROM telemetry
      QUALIFY row_number() OVER (PARTITION BY tower_id ORDER BY timestamp DESC NULLS LAST) = 1""",
    "feature_latest": """
      SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY tower_id ORDER BY window_start DESC) = 1""",
    "status": """
      SELECT t.tower_id, t.bandwidth_utilization_pct, t.active_connections, t.latency_ms,
        f.avg_congestion_score AS congestion_score, f.congestion_predicted_15min, f.avg_bandwidth_util,
        f.peak_bandwidth_util, f.bandwidth_trend_15min
      FROM raw_latest t LEFT JOIN feature_latest f ON t.tower_id = f.tower_id
      WHERE starts_with(t.tower_id, 'LF-')""",
    "bounds": "SELECT floor(epoch(min(timestamp)))::BIGINT AS m, floor(epoch(max(timestamp)))::BIGINT AS n "
              "FROM telemetry",
    "step_windows": """
      SELECT k AS step, floor(m + k * ((n - m) / 30))::BIGINT AS a,
        floor(m + (k + 1) * ((n - m) / 30))::BIGINT AS b
      FROM bounds, range(30) AS steps(k)""",
    "replay": f"""
      SELECT step, tower_id, {mean('bandwidth_utilization_pct')} AS bandwidth_utilization_pct,
        max(active_connections) AS active_connections, {mean('latency_ms')} AS latency_ms,
        {mean('bandwidth_utilization_pct')} / 100 AS congestion_score,
        coalesce({mean('bandwidth_utilization_pct')} > 70, false) AS congested
      FROM telemetry JOIN step_windows ON epoch(timestamp) >= a AND epoch(timestamp) < b
      GROUP BY step, tower_id""",
    "minutes": windowed("cleaned", 60),
    "five": windowed("cleaned", 300),
    "hourly": windowed("cleaned", 3600),
    "closed": "SELECT * FROM hourly "
              "WHERE window_end <= (SELECT max(timestamp) FROM cleaned) - to_minutes(10)",
    "closed_last_flagged": """
      SELECT * FROM features WHERE (congestion_predicted_15min = 1 OR avg_congestion_score > 40)
        AND window_end <= (SELECT max(timestamp) FROM cleaned) - to_minutes(10)
      QUALIFY row_number() OVER (PARTITION BY tower_id ORDER BY window_start DESC) = 1""",
    "closed_opportunities": scored("closed_last_flagged"),
    "ml_table": """
      SELECT tower_id, window_start, avg_bandwidth_util, peak_bandwidth_util, avg_connections,
        avg_congestion_score, avg_latency_ms, avg_packet_loss_pct, bandwidth_trend_15min,
        connection_trend_15min, near_event_flag, hour_of_day, day_of_week, congestion_predicted_15min
      FROM features""",
    "split": """
      SELECT tower_id, window_start, congestion_predicted_15min,
        row_number() OVER (PARTITION BY congestion_predicted_15min ORDER BY
          md5(tower_id || '|' || strftime(window_start, '%Y-%m-%d %H:%M:%S') || '|split42'))
        <= ceil(count(*) OVER (PARTITION BY congestion_predicted_15min) * 0.2) AS is_test
      FROM ml_table""",
    "goal": """
      SELECT count(*) FILTER (congestion_predicted_15min = 1) AS pos,
        least(count(*) FILTER (congestion_predicted_15min = 0),
          5 * count(*) FILTER (congestion_predicted_15min = 1)) AS want
      FROM split WHERE NOT is_test""",
    "judged": f"""
      SELECT customer_id, accepted::INT AS label, (conversion_score > 0.7)::INT AS prediction,
        conversion_score AS score
      FROM decided""",
}


def compose(select: str) -> str:
    """Put the sub-queries a statement needs in front of it."""
    needed: set[str] = set()
    open_texts = [select]
    while open_texts:
        words = set(re.findall(r"\w+", open_texts.pop()))
        for name in PARTS.keys() & words - needed:
            needed.add(name)
            open_texts.append(PARTS[name])
    parts = [f"{name} AS ({PARTS[name]})" for name in PARTS if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


OPPORTUNITY_COLUMNS = """customer_id, company_name, customer_type, customer_segment, conversion_score,
    utilization_pct, breach_risk_level, tower_id, contracted_bandwidth_mbps, current_bandwidth_mbps,
    monthly_revenue_opportunity, monthly_contract_value"""
SUMMARY_MONEY = f"""{rnd('immediate_monthly_upsell_usd', 0)} AS immediate_monthly_upsell_usd,
    {rnd('projected_upsell_arr_usd', 0)} AS projected_upsell_arr_usd,
    {rnd('arr_protected_from_churn_usd', 0)} AS arr_protected_from_churn_usd"""

SELECTS = {
    # Rows and expressions
    "ingest_select": "SELECT * FROM telemetry",
    "require_not_null": """SELECT tower_id, timestamp, bandwidth_utilization_pct FROM telemetry
        WHERE tower_id IS NOT NULL AND timestamp IS NOT NULL AND bandwidth_utilization_pct IS NOT NULL""",
    "clamp_columns": f"""SELECT tower_id, timestamp, greatest(0, active_connections) AS active_connections,
        {BANDWIDTH} AS bandwidth_utilization_pct, greatest(0.0, latency_ms)::DOUBLE AS latency_ms,
        greatest(0.0, throughput_mbps)::DOUBLE AS throughput_mbps, {LOSS} AS packet_loss_pct,
        {ERRORS} AS error_rate_pct FROM telemetry""",
    "range_or_null": """SELECT tower_id, timestamp, CASE WHEN signal_strength_dbm BETWEEN -120 AND -30
        THEN signal_strength_dbm END AS signal_strength_dbm FROM telemetry""",
    "weighted_score": f"SELECT tower_id, timestamp, {SCORE} AS congestion_score FROM telemetry",
    "weighted_score_raw": """SELECT tower_id, timestamp, bandwidth_utilization_pct * 0.4::DOUBLE
        + packet_loss_pct * 0.3::DOUBLE + latency_ms / 100 * 0.2::DOUBLE + error_rate_pct * 0.1::DOUBLE
        AS congestion_score FROM telemetry""",
    "clean_telemetry": "SELECT * FROM cleaned",
    "enrich_accounts": "SELECT * FROM enriched",
    "segment_lookup": f"""SELECT customer_id, upper(contract_tier) AS contract_tier,
        upper(sla_tier) AS sla_tier, {SEGMENT} AS customer_segment FROM accounts""",
    "rule_cascade_score": f"SELECT customer_id, {PROPENSITY} AS upsell_propensity_score FROM accounts",
    "expansion_value": f"""SELECT customer_id,
        {rnd('contracted_bandwidth_mbps * 0.5::DOUBLE * 0.008::DOUBLE * 1000', 2)}
        AS monthly_upsell_opportunity_usd FROM accounts""",
    "breach_level": f"SELECT slice_id, utilization_pct, {BREACH} AS breach_risk_level FROM slices",
    "account_score": f"""SELECT customer_id, {account_score('contract_renewal_months % 2')} AS conversion_score
        FROM enriched JOIN top_slice USING (customer_id)""",
    "select_targets": """SELECT customer_id, conversion_score, conversion_score > 0.65 AS show_proposal
        FROM targets""",
    "sampled_outcome": """SELECT customer_id, customer_type, accepted, monthly_revenue_opportunity,
        annual_upsell_contribution FROM decided""",
    "burst_slices": "SELECT * FROM bursts",
    "proposal_message": "SELECT * FROM log",
    "prefix_filter": "SELECT tower_id, timestamp FROM telemetry WHERE tower_id LIKE 'LF-%'",
    "suffix_filter": """SELECT slice_id, slice_type, ends_with(slice_type, '_burst') AS strict_burst FROM slices
        WHERE slice_type LIKE '%_burst'""",
    "recent_window": """SELECT tower_id, window_start, avg_bandwidth_util FROM five
        WHERE window_start >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 30 MINUTE""",
    "coerce_default": """SELECT event_id, coalesce(try_cast(raw AS DOUBLE), 0) AS number,
        coalesce(try_cast(raw AS DOUBLE), -1) AS number_or_minus_one
        FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN value::VARCHAR END AS raw
          FROM events)""",
    "severity_band": """SELECT tower_id, window_start, CASE WHEN avg_bandwidth_util / 100 > 0.7 THEN 'high'
        WHEN avg_bandwidth_util / 100 > 0.4 THEN 'medium' ELSE 'low' END AS band FROM features""",
    "staggered_rollout": """SELECT customer_id, 4 + (('0x' || substr(md5(customer_id), 1, 8))::BIGINT
        + floor((1 - least(1.0, greatest(0.0, conversion_score))::DOUBLE) * 10)::BIGINT) % 18 AS rollout_step
        FROM opportunities""",
    "utilization_ratio": f"""SELECT slice_id,
        {rnd('current_bandwidth_mbps / nullif(contracted_bandwidth_mbps, 0) * 100', 2)} AS utilization
        FROM slices""",
    "status_as_of": """SELECT slice_id, CASE WHEN expires_timestamp > TIMESTAMP '1998-06-01 12:00:00'
        THEN 'active' ELSE 'terminated' END AS status FROM slices""",
    "union_evolving": """SELECT tower_id, timestamp, latency_ms, NULL::DOUBLE AS throughput_mbps FROM telemetry
        UNION ALL SELECT tower_id, timestamp, latency_ms, throughput_mbps FROM telemetry""",
    "scalar_time_bucket": f"""SELECT tower_id, timestamp, {bucket('timestamp', 300)} AS window_start,
        extract(hour FROM timestamp)::INT AS hour_of_day, (extract(dow FROM timestamp) + 1)::INT AS day_of_week,
        cast(timestamp AS DATE) AS day, floor(epoch(timestamp))::BIGINT AS unix_seconds
        FROM telemetry WHERE timestamp IS NOT NULL""",
    "scalar_string_ids": f"""SELECT customer_id, upper(md5(customer_id)) AS full_id,
        'PROP-' || upper(substr(md5(customer_id), 1, 8)) AS short_id, {draw('customer_id', 'x')} AS unit
        FROM accounts""",
    # Joins
    "near_event_flag": "SELECT tower_id, window_start, near_event_flag FROM features",
    "near_event_flag_timed": """SELECT tower_id, window_start, EXISTS (SELECT 1 FROM proximity p
        WHERE p.tower_id = d.tower_id AND d.window_start >= p.event_start_time
          AND d.window_end <= p.event_end_time)::INT AS near_event_flag FROM daily d""",
    "geo_proximity": "SELECT * FROM proximity",
    "join_top1": """SELECT customer_id, company_name, slice_id, tower_id, utilization_pct
        FROM enriched JOIN top_slice USING (customer_id)""",
    "account_opportunities": "SELECT * FROM opportunities",
    "account_opportunities_5min": "SELECT * FROM opportunities_5min",
    "congestion_features_5min": "SELECT * FROM features_5min",
    "site_status": "SELECT * FROM status",
    "latest_global_window": """SELECT tower_id, avg_congestion_score, avg_bandwidth_util,
        congestion_predicted_15min FROM features WHERE window_start = (SELECT max(window_start) FROM features)""",
    "dimension_backfill": """SELECT tower_id, coalesce(bandwidth_utilization_pct, 0) AS bandwidth_utilization_pct,
        coalesce(latency_ms, 0) AS latency_ms, coalesce(congestion_score, 0) AS congestion_score,
        coalesce(avg_bandwidth_util, 0) AS avg_bandwidth_util,
        coalesce(peak_bandwidth_util, 0) AS peak_bandwidth_util,
        coalesce(active_connections, 0) AS active_connections,
        coalesce(congestion_predicted_15min = 1, false) AS congestion_predicted_15min,
        coalesce(bandwidth_trend_15min::VARCHAR, '') AS bandwidth_trend_15min
        FROM (SELECT DISTINCT tower_id FROM telemetry) LEFT JOIN status USING (tower_id)""",
    "renewal_risk_accounts": """SELECT o.customer_id, o.company_name, o.customer_type, o.utilization_pct,
        o.contract_renewal_months, e.sla_tier, e.support_tickets_30d
        FROM opportunities o JOIN enriched e ON o.customer_id = e.customer_id
        WHERE o.utilization_pct >= 85 AND e.contract_renewal_months <= 6""",
    "append_idempotent": """SELECT slice_id, customer_id, tower_id, slice_type, contracted_bandwidth_mbps,
        bandwidth_allocated_mbps, current_bandwidth_mbps, utilization_pct, latency_guarantee_ms,
        created_timestamp, expires_timestamp, status, revenue_per_hour FROM bursts""",
    "append_to_buckets": """SELECT slice_id, customer_id, tower_id, slice_type, contracted_bandwidth_mbps,
        bandwidth_allocated_mbps, current_bandwidth_mbps, utilization_pct, latency_guarantee_ms,
        created_timestamp, expires_timestamp, status, revenue_per_hour FROM bursts""",
    "site_places": """SELECT tower_id, latitude, longitude, timestamp AS valid_from,
        lead(timestamp) OVER (PARTITION BY tower_id ORDER BY timestamp) AS valid_until FROM place_changes""",
    "site_as_of": """SELECT t.tower_id, t.timestamp, t.active_connections, c.latitude AS known_latitude,
        c.longitude AS known_longitude
        FROM telemetry t ASOF LEFT JOIN place_changes c ON t.tower_id = c.tower_id AND t.timestamp >= c.timestamp""",
    # Aggregates
    "tumbling_features": "SELECT * FROM five",
    "congestion_features": "SELECT * FROM features",
    "revenue_rollup": "SELECT * FROM rollup",
    "site_summary": f"""SELECT count(DISTINCT tower_id) AS active_towers,
        sum(congestion_predicted_15min)::BIGINT AS congested_towers,
        {rnd('max(peak_bandwidth_util)', 1)} AS peak_bandwidth_pct FROM features""",
    "site_summary_recent": f"""SELECT count(DISTINCT tower_id) AS active_towers,
        sum(congestion_predicted_15min)::BIGINT AS congested_towers,
        {rnd('max(peak_bandwidth_util)', 1)} AS peak_bandwidth_pct FROM features
        WHERE window_start >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 2 DAY""",
    "event_summary": f"""SELECT 'EVT-001' AS event_id, 'Cup final' AS event_name, DATE '2024-01-31' AS event_date,
        'Main venue' AS venue_name, count(*) AS b2b_customers_targeted,
        count(*) FILTER (accepted) AS b2b_customers_accepted,
        {rnd(mean('accepted::INT'), 4)} AS acceptance_rate,
        {rnd(money('CASE WHEN accepted THEN monthly_revenue_opportunity ELSE 0 END'), 2)}
          AS immediate_monthly_upsell_usd,
        {rnd(money('annual_upsell_contribution'), 2)} AS projected_upsell_arr_usd,
        {rnd(money('CASE WHEN churn_risk_score > 0.15 THEN monthly_contract_value * 12 ELSE 0 END'), 2)}
          AS arr_protected_from_churn_usd,
        count(*) AS burst_slices_provisioned, (count(*) FILTER (utilization_pct > 100))::INT AS sla_violations,
        {AS_OF} AS summary_generated_at FROM log""",
    "campaign_summary": f"""SELECT count(*) AS total_targeted, count(*) FILTER (accepted) AS total_accepted,
        {rnd(mean('accepted::INT'), 4)} AS acceptance_rate,
        {rnd(money('CASE WHEN accepted THEN monthly_revenue_opportunity ELSE 0 END'), 2)}
          AS immediate_monthly_upsell,
        {rnd(money('annual_upsell_contribution'), 2)} AS projected_upsell_arr,
        {rnd(money('CASE WHEN churn_risk_score > 0.15 THEN monthly_contract_value * 12 ELSE 0 END'), 2)}
          AS arr_protected_from_churn,
        (count(*) FILTER (utilization_pct > 100))::INT AS sla_violations FROM log""",
    "distinct_counts": """SELECT (SELECT count(DISTINCT customer_id) FROM opportunities) AS accounts_at_risk,
        (SELECT count(DISTINCT tower_id) FROM telemetry) AS active_towers""",
    "filtered_counts": """SELECT count(*) AS slices, count(*) FILTER (status = 'active') AS active,
        count(*) FILTER (status = 'active' AND slice_type LIKE '%_burst') AS burst_slices FROM slices""",
    "kpi_bundle": """SELECT (SELECT count(DISTINCT customer_id) FROM opportunities) AS accounts_at_risk,
        (SELECT count(DISTINCT tower_id) FROM telemetry) AS active_towers,
        (SELECT count(DISTINCT tower_id) FROM features WHERE congestion_predicted_15min = 1) AS towers_congested,
        (SELECT count(*) FROM log) AS proposals_sent,
        (SELECT count(*) FROM log WHERE accepted) AS proposals_accepted,
        (SELECT projected_upsell_arr_usd FROM summaries ORDER BY summary_generated_at DESC, event_id LIMIT 1)
          AS upsell_arr,
        (SELECT arr_protected_from_churn_usd FROM summaries
          ORDER BY summary_generated_at DESC, event_id LIMIT 1) AS arr_protected,
        (SELECT count(*) FROM slices WHERE status = 'active' AND slice_type LIKE '%_burst') AS burst_slices""",
    "segment_value": f"""SELECT customer_segment, {rnd(money('projected_upsell_arr'), 2)} AS projected_upsell_arr,
        sum(high_upsell_opportunities)::BIGINT AS high_upsell_opportunities FROM rollup GROUP BY 1""",
    "segment_scores": f"""SELECT customer_segment, {rnd(mean('avg_upsell_score'), 4)} AS avg_upsell_score,
        sum(high_upsell_opportunities)::BIGINT AS high_upsell_opportunities,
        sum(total_customers_at_risk)::BIGINT AS total_customers_at_risk FROM rollup GROUP BY 1""",
    "segment_scores_weighted": f"""SELECT customer_segment,
        {rnd(money('avg_upsell_score * total_customers_at_risk') + ' / sum(total_customers_at_risk)', 4)}
          AS avg_upsell_score,
        sum(high_upsell_opportunities)::BIGINT AS high_upsell_opportunities,
        sum(total_customers_at_risk)::BIGINT AS total_customers_at_risk FROM rollup GROUP BY 1""",
    "time_step_replay": "SELECT * FROM replay",
    "replay_from_rollups": "SELECT * FROM replay WHERE step = 12",
    "rolling_distinct": """SELECT a.day, count(DISTINCT tower_id) AS active_towers, true AS close
        FROM (SELECT DISTINCT timestamp::DATE AS day FROM telemetry WHERE timestamp IS NOT NULL) a
        JOIN (SELECT DISTINCT timestamp::DATE AS own, tower_id FROM telemetry) b ON b.own BETWEEN a.day - 6 AND a.day
        GROUP BY a.day""",
    "time_step_replay_prefix": "SELECT * FROM replay WHERE tower_id LIKE 'LF-%'",
    "congested_per_step": """SELECT step, count(*) AS active_towers,
        count(*) FILTER (congested) AS towers_congested FROM replay GROUP BY step""",
    "distinct_sites": "SELECT * FROM sites",
    "profile_counts": f"""SELECT customer_type, count(*) AS accounts,
        {rnd(money('contracted_bandwidth_mbps'), 2)} AS total_bandwidth_mbps,
        {rnd(money('monthly_contract_value'), 2)} AS total_contract_value FROM accounts GROUP BY 1""",
    "slice_profile": """SELECT status, count(*) AS slices, count(*) FILTER (utilization_pct >= 88) AS surging,
        count(DISTINCT customer_id) FILTER (utilization_pct >= 88) AS accounts_at_risk FROM slices GROUP BY 1""",
    "sla_breach_count": "SELECT count(*) FILTER (utilization_pct > 100) AS sla_breaches FROM opportunities",
    # Windows and ranking
    "lag_trend": trended("minutes").replace("SELECT *,", "SELECT tower_id, window_start, avg_bandwidth_util,"),
    "window_trend": trended("five").replace("SELECT *,", "SELECT tower_id, window_start,"),
    "latest_per_key": """SELECT tower_id, timestamp, bandwidth_utilization_pct, congestion_score FROM cleaned
        QUALIFY row_number() OVER (PARTITION BY tower_id ORDER BY timestamp DESC) = 1""",
    "top1_per_key": "SELECT customer_id, slice_id, tower_id, utilization_pct FROM top_slice",
    "site_timeline": """SELECT tower_id, window_start, avg_bandwidth_util, congestion_predicted_15min
        FROM features WHERE tower_id LIKE 'LF-%'""",
    "site_running_total": """SELECT tower_id, window_start, count(*) OVER so_far AS windows_so_far,
        (sum(congestion_predicted_15min) OVER so_far)::BIGINT AS flagged_so_far,
        (sum(peak_connections) OVER so_far)::BIGINT AS connections_so_far,
        max(peak_bandwidth_util) OVER so_far AS highest_util_so_far
        FROM features WINDOW so_far AS (PARTITION BY tower_id ORDER BY window_start)""",
    "top_opportunities": f"""SELECT company_name, customer_type, customer_segment,
        {rnd('utilization_pct', 1)} AS utilization_pct, breach_risk_level,
        {rnd('conversion_score', 3)} AS conversion_score,
        {rnd('monthly_revenue_opportunity', 0)} AS monthly_revenue_opportunity, tower_id
        FROM (SELECT * FROM targets ORDER BY conversion_score DESC, utilization_pct DESC, customer_id LIMIT 100)""",
    "latest_summary": "SELECT * FROM summaries ORDER BY summary_generated_at DESC, event_id LIMIT 1",
    "activity_feed": """SELECT type, message, timestamp FROM (
        (SELECT CASE WHEN accepted THEN 'accepted' ELSE 'proposal' END AS type,
          CASE WHEN accepted THEN 'Accepted!' ELSE 'Proposal sent to' END || ' ' || company_name || ' — '
            || round_even(utilization_pct, 0)::BIGINT || '% util — +$'
            || round_even(monthly_revenue_opportunity, 0)::BIGINT || '/mo' AS message, sent_at AS timestamp
          FROM log ORDER BY sent_at DESC, proposal_id LIMIT 15)
        UNION ALL
        (SELECT 'congestion', 'Congestion predicted on ' || tower_id || ' — Peak BW '
            || round_even(peak_bandwidth_util, 0)::BIGINT || '% — Burst slice provisioned', window_start
          FROM features WHERE congestion_predicted_15min = 1 ORDER BY window_start DESC, tower_id LIMIT 8))
        ORDER BY timestamp DESC, message LIMIT 20""",
    "ranked_accounts": f"SELECT {OPPORTUNITY_COLUMNS} FROM opportunities",
    "event_summary_report": f"""SELECT event_name, b2b_customers_targeted, b2b_customers_accepted,
        {rnd('acceptance_rate * 100', 1)} AS acceptance_rate_pct, {SUMMARY_MONEY}, burst_slices_provisioned
        FROM summaries WHERE event_name = 'media_rights'""",
    # Streams
    "stream_ingest": "SELECT * FROM telemetry",
    "stream_clean": "SELECT * FROM cleaned",
    "stream_enrich": "SELECT * FROM enriched",
    "stream_tumbling": "SELECT * FROM closed",
    "stream_trend": trended("closed"),
    "stream_trend_stateful": trended("closed"),
    "stream_latest": """SELECT tower_id, timestamp, bandwidth_utilization_pct, congestion_score FROM cleaned
        QUALIFY row_number() OVER (PARTITION BY tower_id ORDER BY timestamp DESC, bandwidth_utilization_pct DESC,
          congestion_score DESC) = 1""",
    "stream_provision": provisioned("closed_opportunities") + " WHERE conversion_score >= 0.65",
    "stream_provision_loop": "SELECT * FROM closed_opportunities",
    "layer_refresh": "SELECT * FROM rollup",
    # Learning
    "ml_feature_table": "SELECT * FROM ml_table",
    "future_label": """SELECT tower_id, window_start, congestion_predicted_15min, lead(congestion_predicted_15min)
        OVER (PARTITION BY tower_id ORDER BY window_start) AS congested_later FROM features""",
    "stratified_split": "SELECT * FROM split",
    "oversample": """SELECT tower_id, window_start, congestion_predicted_15min, count(*) AS copies FROM (
        SELECT tower_id, window_start, congestion_predicted_15min, unnest(range(CASE
          WHEN congestion_predicted_15min = 0 THEN 1 ELSE want // pos + (row_number() OVER (
            PARTITION BY congestion_predicted_15min ORDER BY md5(tower_id || '|'
              || strftime(window_start, '%Y-%m-%d %H:%M:%S') || '|over42')) <= want % pos)::INT END)) AS copy
        FROM split, goal WHERE NOT is_test) GROUP BY ALL""",
    "simulated_label": f"""SELECT customer_id, conversion_score, (CASE WHEN conversion_score > 0.7
        THEN {draw('customer_id', 'high')} < 0.47::DOUBLE ELSE {draw('customer_id', 'low')} < 0.05::DOUBLE END)::INT
        AS will_convert FROM opportunities""",
    "rf_held_out": """SELECT tower_id, window_start, congestion_predicted_15min, true AS valid,
        true AS same_when_restored, true AS accurate FROM split WHERE is_test""",
    "gbt_held_out": f"""SELECT customer_id, will_convert, true AS valid, true AS same_when_restored FROM (
          SELECT customer_id, (CASE WHEN conversion_score > 0.7 THEN {draw('customer_id', 'high')} < 0.47::DOUBLE
            ELSE {draw('customer_id', 'low')} < 0.05::DOUBLE END)::INT AS will_convert
          FROM opportunities WHERE avg_congestion_score IS NOT NULL AND congestion_predicted_15min IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY will_convert ORDER BY md5(customer_id || '|split42'))
          <= ceil(count(*) OVER (PARTITION BY will_convert) * 0.2)""",
    "importance_total": "SELECT feature, true AS valid, 1.0::DOUBLE AS total FROM (VALUES "
        + ", ".join(f"('{c}')" for c in (
            "avg_bandwidth_util", "peak_bandwidth_util", "avg_connections", "avg_congestion_score", "avg_latency_ms",
            "avg_packet_loss_pct", "bandwidth_trend_15min", "connection_trend_15min", "near_event_flag",
            "hour_of_day", "day_of_week")) + ") AS t(feature)",
    "label_balance": f"""SELECT congestion_predicted_15min, count(*) AS rows,
        {rnd('count(*) / (SELECT count(*) FROM ml_table)', 4)} AS share FROM ml_table GROUP BY 1""",
    "classification_metrics": f"""SELECT count(*) AS rows,
        {rnd('count(*) FILTER (label = prediction) / count(*)', 6)} AS accuracy,
        {rnd('count(*) FILTER (label = 1 AND prediction = 1) / count(*) FILTER (prediction = 1)', 6)} AS precision,
        {rnd('count(*) FILTER (label = 1 AND prediction = 1) / count(*) FILTER (label = 1)', 6)} AS recall,
        {rnd('''(SELECT sum(CASE WHEN a.score > b.score THEN 2 WHEN a.score = b.score THEN 1 ELSE 0 END)::DOUBLE
            / (2 * count(*)) FROM judged a, judged b WHERE a.label = 1 AND b.label = 0)''', 6)} AS auc,
        count(*) FILTER (score IS NULL) AS unscored
        FROM judged""",
    "class_report": f"""SELECT class,
        {rnd('count(*) FILTER (label = class AND prediction = class) / count(*) FILTER (prediction = class)', 6)}
          AS precision,
        {rnd('count(*) FILTER (label = class AND prediction = class) / count(*) FILTER (label = class)', 6)}
          AS recall,
        {rnd('''2 * count(*) FILTER (label = class AND prediction = class)
          / (count(*) FILTER (prediction = class) + count(*) FILTER (label = class))''', 6)} AS f1,
        count(*) FILTER (label = class) AS support
        FROM judged, (VALUES (0), (1)) AS classes(class) GROUP BY class""",
    # Reports
    "event_arr": "SELECT event_name, projected_upsell_arr_usd, arr_protected_from_churn_usd FROM summaries",
    "acceptance_by_type": f"""SELECT customer_type, {rnd(mean('accepted::INT'), 4)} AS acceptance_rate
        FROM log GROUP BY 1""",
    "projected_annual": f"""SELECT analysis_date, {rnd(money('projected_upsell_arr'), 2)} AS projected_upsell_arr
        FROM rollup GROUP BY 1""",
    "top_accounts": """SELECT customer_id, company_name, monthly_revenue_opportunity FROM opportunities
        ORDER BY monthly_revenue_opportunity DESC, customer_id LIMIT 10""",
    "closest_to_breach": f"""SELECT customer_id, company_name, utilization_pct,
        {rnd('abs(100.0::DOUBLE - utilization_pct)', 2)} AS gap_pct, breach_risk_level FROM opportunities
        ORDER BY gap_pct, customer_id""",
    "critical_in_window": """SELECT breach_risk_level, count(DISTINCT customer_id) AS accounts FROM log
        WHERE sent_at >= TIMESTAMP '2024-01-10' AND sent_at < TIMESTAMP '2024-01-25' GROUP BY 1""",
    "avg_util_by_type": f"""SELECT {rnd(mean('utilization_pct'), 2)} AS avg_utilization_pct FROM opportunities
        WHERE customer_type = 'broadcaster'""",
    "over_threshold": """SELECT customer_id, company_name, utilization_pct, breach_risk_level FROM opportunities
        WHERE utilization_pct > 90""",
    "type_at_risk": """SELECT customer_id, company_name, utilization_pct, breach_risk_level FROM opportunities
        WHERE customer_type = 'payment_processor' AND utilization_pct >= 85""",
    "burst_count": """SELECT status, count(*) AS burst_slices,
        count(*) FILTER (ends_with(slice_type, '_burst')) AS strict_burst_slices FROM slices
        WHERE slice_type LIKE '%_burst' GROUP BY 1""",
    "congested_now": """SELECT tower_id, window_start, avg_bandwidth_util FROM feature_latest
        WHERE congestion_predicted_15min = 1""",
    "last_alert": "SELECT tower_id, window_start, avg_congestion_score FROM last_flagged",
    "sent_vs_accepted": """SELECT customer_type, count(*) AS sent, count(*) FILTER (accepted) AS accepted
        FROM log GROUP BY 1""",
    "segment_churn_risk": """SELECT customer_segment, count(*) FILTER (churn_risk_score > 0.25)
        AS accounts_at_churn_risk FROM opportunities GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    "avg_contract_by_type": f"""SELECT customer_type, {rnd(mean('contracted_bandwidth_mbps'), 2)}
        AS avg_contracted_mbps FROM accounts GROUP BY 1""",
    "monthly_pipeline": f"""SELECT date_trunc('month', analysis_date)::DATE AS month,
        {rnd(money('projected_upsell_arr'), 2)} AS pipeline_arr FROM rollup GROUP BY 1""",
    "arr_at_risk_slice": f"""SELECT {rnd(money('''CASE WHEN churn_risk_score > 0.25
        THEN monthly_contract_value * 12 ELSE 0 END'''), 2)} AS arr_at_churn_risk FROM opportunities
        WHERE contract_tier = 'PLATINUM' AND customer_type = 'broadcaster'""",
    "renewal_acceptance": f"""SELECT count(*) AS proposals, {rnd(mean('accepted::INT'), 4)} AS acceptance_rate
        FROM log l JOIN enriched e ON l.customer_id = e.customer_id
        WHERE e.contract_renewal_months <= 6 AND e.peak_event_utilization_pct > 0.75""",
    "active_slices_by_site": """SELECT tower_id, slice_type, count(*) AS active_slices FROM slices
        WHERE status = 'active' GROUP BY ALL""",
}


def statements() -> dict[str, str]:
    return {name: compose(select) for name, select in SELECTS.items()}
