"""Replay from rollups, distinct counts from daily sketches, and appends by bucket."""

import math
import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from capacast import session
from capacast.plans import rollups, serving, sketches
from capacast.sources import schemas, tables
from tests.fixtures import START, reading, table


def readings(seed, days=5, count=600):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        second = timedelta(seconds=rng.randrange(days * 86400))
        value = rng.choice([None, 99.0, rng.uniform(0, 100)])
        rows.append(reading(rng.choice(["LF-1", "LF-2", "DT-3"]), 0, value, timestamp=START + second,
                            active_connections=rng.randrange(500), latency_ms=rng.uniform(1, 90)))
    return rows + [reading("DT-3", 0, math.inf), reading("DT-9", 0, 5.0, timestamp=None)]


def values(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_pieces_cover_a_range_once():
    rng = random.Random(3)
    for _ in range(200):
        low = rng.randrange(10**6)
        high = low + rng.choice([0, 1, 59, 61, 3601, 90_000, 10**6])
        found = sorted((a, b, w) for w, a, b in rollups.pieces(low, high))
        assert sum(b - a for a, b, _ in found) == high - low
        assert all(x[1] == y[0] for x, y in zip(found, found[1:]))
        assert all(w == 0 or (a % w == 0 and b % w == 0) for a, b, w in found)
        assert sum(b - a for a, b, w in found if not w) < 120


@pytest.mark.parametrize("steps", [7, 30])
def test_every_step_equals_the_replay_of_raw_readings(spark, tmp_path, steps):
    telemetry = table(spark, schemas.TELEMETRY, readings(steps))
    rollups.write_rollups(telemetry, str(tmp_path))
    whole = serving.time_steps(telemetry, steps)
    for step in (0, 1, steps // 2, steps - 1):
        found = rollups.replay_step(spark, str(tmp_path), step, steps)
        assert values(found) == values(whole.where(F.col("step") == step)) != []
        assert found.schema["step"].dataType == whole.schema["step"].dataType
    one = rollups.replay_step(spark, str(tmp_path), 1, steps, prefix="LF-")
    assert values(one) == values(serving.time_steps(telemetry, steps, prefix="LF-").where("step = 1"))
    assert rollups.replay_step(spark, str(tmp_path), steps, steps).count() == 0


def test_days_written_anew_take_the_place_of_the_old(spark, tmp_path):
    first = table(spark, schemas.TELEMETRY, readings(1))
    rollups.write_rollups(first, str(tmp_path))
    day = F.to_date("timestamp") == F.to_date(F.lit(START + timedelta(days=2)))
    later = first.where(~day | F.col("timestamp").isNull()).unionByName(
        table(spark, schemas.TELEMETRY, readings(2)).where(day))
    rollups.write_rollups(later.where(day), str(tmp_path))
    whole = serving.time_steps(later, 4)
    for step in range(4):
        assert values(rollups.replay_step(spark, str(tmp_path), step, 4)) == values(whole.where(F.col("step") == step))


def test_a_step_reads_raw_readings_of_its_edges_only(spark, tmp_path):
    rollups.write_rollups(table(spark, schemas.TELEMETRY, readings(4, days=60)), str(tmp_path))
    plan = rollups.replay_step(spark, str(tmp_path), 1, 3)._jdf.queryExecution().executedPlan().toString()
    raw = [scan for scan in plan.split("FileScan ") if "GreaterThanOrEqual(timestamp" in scan]
    assert 1 <= len(raw) <= 2 and plan.count("FileScan ") <= 7
    for scan in raw:
        low, high = re.search(r"PartitionFilters: \[isnotnull\(day#\d+\), \(day#\d+ >= ([\d-]+)\), \(day#\d+ <= ([\d-]+)",
                              scan).groups()
        assert low == high and "LessThan(timestamp" in scan


def test_no_readings_no_steps(spark, tmp_path):
    rollups.write_rollups(table(spark, schemas.TELEMETRY, readings(4)), str(tmp_path))
    rollups.write_rollups(table(spark, schemas.TELEMETRY, []), str(tmp_path))
    assert rollups.replay_step(spark, str(tmp_path), 0).count() > 0
    rollups.write_rollups(table(spark, schemas.TELEMETRY, [reading("A", 0, 1.0)]), str(tmp_path / "one"))
    assert rollups.replay_step(spark, str(tmp_path / "one"), 0).count() == 0


def test_month_from_daily_sketches(spark, tmp_path):
    seen = spark.range(600_000).select(
        F.concat(F.lit("S"), F.col("id") % 90_000).alias("site"),
        F.timestamp_seconds(1_704_067_200 + F.pmod(F.xxhash64("id"), F.lit(31)) * 86400).alias("timestamp"))
    path = str(tmp_path / "sketches")
    sketches.store(sketches.daily_sketches(seen, "site"), path)
    stored = sketches.stored(spark, path)
    for first, last in (("2024-01-01", "2024-01-30"), ("2024-01-05", "2024-01-06")):
        exact = seen.where(F.to_date("timestamp").between(first, last)).agg(F.count_distinct("site")).first()[0]
        found = sketches.distinct_between(stored, first, last, "n")
        assert abs(found.first().n - exact) < 0.02 * exact
        filters = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
        assert first in filters and last in filters
    assert sketches.distinct_between(stored, "2030-01-01", "2030-01-02", "n").first().n == 0
    # A day written anew replaces its own sketch only.
    sketches.store(sketches.daily_sketches(seen.where("to_date(timestamp) = '2024-01-03'").limit(1), "site"), path)
    again = sketches.stored(spark, path)
    assert again.count() == 31 and sketches.distinct_between(again, "2024-01-03", "2024-01-03", "n").first().n == 1


def test_rolling_counts_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), f"S{rng.randrange(30)}", START + timedelta(days=rng.choice([0, 1, 2, 9, 10, 30])))
            for _ in range(150)] + [("a", None, START), ("a", "S1", None)]
    df = spark.createDataFrame(rows, "g string, site string, timestamp timestamp_ntz")
    known = [(g, s, t.date()) for g, s, t in rows if s and t]
    wanted = sorted((g, d, len({s for h, s, e in known if h == g and d - timedelta(days=6) <= e <= d}))
                    for g, d in {(g, d) for g, _, d in known})
    exact = sketches.rolling_distinct_exact(df, "site", 7, "n", by=["g"])
    near = sketches.rolling_distinct(sketches.daily_sketches(df, "site", by=["g"]), 7, "n", by=["g"])
    assert sorted(tuple(r) for r in exact.collect()) == wanted == sorted(tuple(r) for r in near.collect())


def test_append_to_buckets_adds_new_keys_once_and_reads_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "target")
    rows = spark.range(3000).select(F.concat(F.lit("K"), "id").alias("k"), F.col("id").alias("v"))
    tables.append_to_buckets(rows.where("v < 2000"), path, ["k"])
    tables.append_to_buckets(rows, path, ["k"])
    tables.append_to_buckets(rows.unionByName(rows), path, ["k"])
    found = spark.read.parquet(path)
    assert found.count() == 3000 == found.select("k").distinct().count()
    name = tables.bucket_column(256)
    ten = rows.limit(10).select(F.pmod(F.xxhash64("k"), F.lit(256)).cast("int").alias(name))
    asked = [r[0] for r in ten.distinct().collect()]
    read = tables.in_buckets(spark, path, found.schema, name, asked)
    assert f"PartitionFilters: [{name}" in read._jdf.queryExecution().executedPlan().toString()
    files = [r[0] for r in read.select(F.input_file_name()).distinct().collect()]
    assert 0 < len({re.search(rf"{name}=\d+", f).group(0) for f in files}) <= len(asked) <= 10


def test_null_keys_and_nothing_to_append(spark, tmp_path):
    path = str(tmp_path / "target")
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    tables.append_to_buckets(rows.limit(0), path, ["k"])
    tables.append_to_buckets(rows, path, ["k"])
    assert [tuple(r)[:2] for r in spark.read.parquet(path).collect()] == [("a", 1)]


def test_scratch_needs_a_shared_folder(spark):
    own = session.os.path.abspath("spark-warehouse")
    assert session.usable(f"file:{own}", "local[4]") and not session.usable(f"file:{own}", "spark://host:7077")
    assert session.usable("hdfs://name/warehouse", "yarn")


def test_discarded_scratch_is_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path / "run"))
    path = session.scratch(spark, "rows")
    spark.range(3).write.parquet(path)
    assert tables.exists(spark, path)
    session.discard_scratch(spark)
    assert not tables.exists(spark, path) and not (tmp_path / "run").exists()
