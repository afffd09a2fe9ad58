"""The command line end to end on small tables."""

from datetime import timedelta

import jobs
from capacast.plans import learning, refresh
from capacast.sources import schemas
from tests.fixtures import START, account, capacity, reading


def test_refresh_then_campaign(spark, tmp_path):
    raw, layers, out = (str(tmp_path / n) for n in ("raw", "layers", "out"))

    def put(name, ddl, rows):
        spark.createDataFrame(rows, schemas.schema(ddl)).write.parquet(f"{raw}/{name}")

    put("telemetry", schemas.TELEMETRY, [reading("A", m, 90.0) for m in range(30)])
    put("accounts", schemas.ACCOUNTS, [account("C1")])
    put("events", schemas.EVENTS, [
        ("E", "Cup", "Field", 47.6, -122.33, START, START + timedelta(hours=2), 1000, "sports", 2.0)])
    put("slices", schemas.SLICES, [capacity("S1", "C1", "A", 97.0)])
    for _ in range(2):
        jobs.main(["refresh", "--raw", raw, "--layers", layers])
        jobs.main(["campaign", "--layers", layers, "--slices", f"{raw}/slices", "--out", out, "--event", "E",
                   "--name", "Cup", "--date", "2024-09-15", "--venue", "Field", "--prefix", "P-"])
    assert spark.read.parquet(f"{layers}/{refresh.REVENUE}").head().total_customers_at_risk == 1
    assert spark.read.parquet(f"{raw}/slices").count() == 2
    assert spark.read.parquet(f"{out}/upsell_proposal_log").count() == 1
    assert spark.read.parquet(f"{out}/event_revenue_summary").head().b2b_customers_targeted == 1


def test_training_job_stores_model_and_measures(spark, tmp_path):
    rows = spark.range(300).selectExpr(
        "string(id % 5) AS tower_id", "id AS window_start", "double(id % 100) AS avg_bandwidth_util",
        "int(id % 100 > 85) AS congestion_predicted_15min")
    results = learning.train_congestion(rows, str(tmp_path / "m"), trees=3, depth=3)
    assert results["metrics"].head().accuracy > .9
    assert {p.name for p in (tmp_path / "m").iterdir()} >= {"model", "scored", "metrics", "report", "importances"}
    assert results["skipped"].count() == len(learning.CONGESTION_FEATURES) - results["importances"].count()
    accounts = spark.range(200).selectExpr(
        "concat('C', id) AS customer_id", "0.6 + id % 40 / 100 AS conversion_score",
        "double(id) AS monthly_contract_value", "id % 7 / 10 AS churn_risk_score")
    tickets = accounts.selectExpr("customer_id", "int(length(customer_id)) AS support_tickets_30d")
    results = learning.train_accounts(accounts, tickets, str(tmp_path / "a"), rounds=2, depth=2)
    assert results["metrics"].head().rows > 0
    assert {r.feature for r in results["skipped"].collect()} == set(learning.ACCOUNT_FEATURES) - {
        "monthly_contract_value", "churn_risk_score", "support_tickets_30d"}
