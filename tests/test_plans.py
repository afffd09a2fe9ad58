"""Shape of the physical plans: what is pushed down, and what never happens."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from capacast.operators import joins, ranking
from capacast.plans import layers
from capacast.sources import schemas, tables
from tests.fixtures import START, reading, table

FOLDER = "/root/testdata/sf0.001"
# These jobs run actions of their own while being built.
EAGER = re.compile("stream_|layer_refresh|append_idempotent|_train_score|importances|split|oversample")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Telemetry as a real table, so that pushdown can be seen."""
    path = str(tmp_path_factory.mktemp("plans") / "telemetry")
    tables.overwrite(table(spark, schemas.TELEMETRY, [reading("A", m, 50.0) for m in range(10)]), path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", [n for n in entry_points.REGISTRY if not EAGER.search(n)])
def test_no_nested_loops_or_python(spark, name):
    text = plan(entry_points.queries()[name](spark, FOLDER))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|MapInPandas|ArrowEval", text)


def test_cleaning_pushes_filters_and_prunes_columns(stored):
    text = plan(layers.tumbling_features(layers.clean_telemetry(stored)))
    pushed = re.search(r"PushedFilters: \[([^\]]*)", text).group(1)
    for column in ("tower_id", "timestamp", "bandwidth_utilization_pct"):
        assert f"IsNotNull({column})" in pushed
    read = re.search("ReadSchema: (.*)", text).group(1)
    assert "temperature_celsius" not in read and "throughput_mbps" not in read


def test_features_shuffle_combined_rows_only(stored):
    text = plan(layers.tumbling_features(layers.clean_telemetry(stored)))
    assert text.count("Exchange ") == 1 and "partial_sum" in text and "ObjectHashAggregate" not in text


def test_time_and_prefix_filters_reach_the_scan(stored):
    cut = F.lit(START).cast("timestamp_ntz")
    assert "GreaterThanOrEqual(timestamp" in plan(stored.where(F.col("timestamp") >= cut).select("tower_id"))
    assert "StringStartsWith(tower_id,LF-)" in plan(stored.where(F.col("tower_id").startswith("LF-")).select("tower_id"))


def test_top_row_is_limited_before_the_shuffle(stored):
    text = plan(ranking.top_per_key(stored, ["tower_id"], [F.desc("bandwidth_utilization_pct"), F.asc("timestamp")]))
    before = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_newest_row_is_combined_before_the_shuffle(stored):
    text = plan(ranking.newest_values(stored, ["tower_id"], "timestamp", ["latency_ms", "active_connections"]))
    assert text.count("Exchange") == 1 and "partial_max(struct(" in text.split("Exchange")[1]


def test_near_sites_are_joined_after_the_distinct(spark, stored):
    events = spark.createDataFrame(
        [("E", 47.6, -122.3)], "event_id string, venue_latitude double, venue_longitude double")
    text = plan(joins.sites_near(events, joins.distinct_sites(stored)))
    below = text[text.index("LeftSemi"):]
    assert "HashAggregate(keys=[tower_id" in below


def test_flag_reuses_the_partitioning_of_the_trend(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = stored.select("tower_id").distinct()
        text = plan(layers.congestion_features(layers.clean_telemetry(stored), near))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Site and window, site, and the keys of the near sites.
    assert text.count("Exchange ") == 3
