from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from capacast import session
from capacast.operators import rows
from capacast.sources import schemas, tables
from tests.fixtures import START, reading, table


def test_load_and_overwrite(spark, tmp_path):
    tables.overwrite(spark.range(5), str(tmp_path / "t.parquet"))
    tables.overwrite(spark.range(3).withColumn("x", F.lit(1)), str(tmp_path / "t.parquet"))
    loaded = tables.load(spark, "t", str(tmp_path))
    assert loaded.count() == 3 and loaded.columns == ["id", "x"]


def test_append_and_merged_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(spark.range(2), path)
    tables.append(spark.range(2).withColumn("extra", F.lit("a")), path)
    found = tables.merged(spark, path)
    assert sorted(found.columns) == ["extra", "id"] and found.where("extra IS NULL").count() == 2


def test_merged_widens_types(spark, tmp_path):
    """Files with int, double and absent columns, over days, in turns."""
    path = str(tmp_path / "t")
    parts = ["id as x, cast(id as int) as y", "id as x, id + 0.5D as y", "id as x", "id as x, cast(id as short) as y, 'a' as z"]
    for i in range(8):
        frame = spark.range(i * 10, i * 10 + 5, numPartitions=2).selectExpr(*parts[i % 4].split(", "))
        frame.withColumn("day", F.lit(f"2024-01-0{i % 3 + 1}").cast("date")).write.mode("append").partitionBy("day").parquet(path)
    found = tables.merged(spark, path)
    assert dict(found.dtypes) == {"x": "bigint", "y": "double", "z": "string", "day": "date"}
    want = {i * 10 + k: [i * 10.0 + k, i * 10 + k + 0.5, None, i * 10.0 + k][i % 4] for i in range(8) for k in range(5)}
    rows = found.collect()
    assert {r.x: r.y for r in rows} == want and len(rows) == 40
    assert sum(r.z == "a" for r in rows) == 10 and {str(r.day) for r in rows} == {f"2024-01-0{d}" for d in (1, 2, 3)}


def test_widened_types():
    from pyspark.sql import types as T
    assert tables.widened(T.ShortType(), T.LongType()) == T.LongType()
    assert tables.widened(T.FloatType(), T.ByteType()) == T.DoubleType()
    assert tables.widened(T.StringType(), T.StringType()) == T.StringType()
    for one, other in ((T.LongType(), T.DoubleType()), (T.StringType(), T.IntegerType())):
        with pytest.raises(TypeError):
            tables.widened(one, other)


def test_union_evolving(spark):
    old = spark.createDataFrame([(0,)], "id int")
    found = rows.union_evolving(old, old.withColumn("x", F.lit(2)))
    assert sorted(map(tuple, found.collect()), key=repr) == [(0, 2), (0, None)]


def test_ingest_stamps(spark):
    found = rows.ingest(spark.range(2).withColumn("junk", F.lit(1)), ["id"])
    assert found.columns == ["id", "ingested_at"]
    assert found.select("ingested_at").distinct().count() == 1


def test_status_as_of(spark):
    df = spark.createDataFrame([(START,), (START + timedelta(1),), (None,)], "expires_timestamp timestamp_ntz")
    found = rows.status_as_of(df, F.lit(START).cast("timestamp_ntz"))
    assert [r.status for r in found.collect()] == ["terminated", "active", "terminated"]


def test_history_is_pruned_by_day(spark, tmp_path):
    data = table(spark, schemas.TELEMETRY, [reading(f"T{i % 3}", i * 60, 5.0) for i in range(100)])
    path = str(tmp_path / "history")
    tables.write_history(data, path, "timestamp", ["tower_id"])
    day = spark.read.parquet(path).where("day = DATE '2024-09-16'")
    assert day.count() == 24
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()


def test_append_new_into_missing_folder(spark, tmp_path):
    path = str(tmp_path / "new")
    fresh = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    tables.append_new(fresh, path, ["id"])
    tables.append_new(fresh.union(spark.createDataFrame([(3, "c")], "id int, v string")), path, ["id"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_materialise_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), None)], "t timestamp_ntz, x double")
    stored = session.materialise(df, "kept")
    assert stored.collect() == df.collect() and stored.dtypes == df.dtypes
    assert spark.conf.get("spark.checkpoint.dir") in stored.inputFiles()[0]


def test_conform_rejects_unreadable_values(spark):
    bad = spark.createDataFrame([("x",)], "id string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        rows.conform(bad, schemas.schema("id INT")).collect()
