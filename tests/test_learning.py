import random

import pytest
from pyspark.sql import functions as F

from capacast import session
from capacast.plans import learning

KEYS = ["tower_id", "window_start"]


@pytest.fixture(scope="module")
def training(spark):
    """Windows whose label follows from utilization."""
    i = F.col("id")
    util = F.pmod(F.xxhash64("id"), F.lit(10000)) / 100
    df = spark.range(600).select(
        (i % 7).cast("string").alias("tower_id"), i.alias("window_start"),
        util.alias("avg_bandwidth_util"), (util + 3).alias("peak_bandwidth_util"),
        (i % 11).cast("double").alias("avg_connections"), (util > 85).cast("int").alias(learning.CONGESTION_LABEL))
    return session.materialise(df, "training-fixture")


def test_available_features(training):
    present, missing = learning.available(training, learning.CONGESTION_FEATURES)
    assert present == ["avg_bandwidth_util", "peak_bandwidth_util", "avg_connections"]
    assert len(missing) == 8


def test_feature_table_drops_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", None, 0), ("c", 2.0, None)], "k string, x double, y int")
    table = learning.feature_table(df, ["x", "absent"], "y", ["k"])
    assert [tuple(r) for r in table.collect()] == [("a", 1.0, 1)]


def test_split_before_oversampling_leaks_nothing(training):
    train, test = learning.train_and_test(training, learning.CONGESTION_LABEL, KEYS, factor=5)
    assert train.join(test, KEYS).count() == 0
    assert train.select(*KEYS).distinct().count() + test.count() == 600
    balance = {r[0]: r["count"] for r in train.groupBy(learning.CONGESTION_LABEL).count().collect()}
    positives = train.where(F.col(learning.CONGESTION_LABEL) == 1).select(*KEYS).distinct().count()
    assert balance[1] == min(balance[0], 5 * positives)


def test_forest_learns_saves_and_scores(spark, training):
    columns, _ = learning.available(training, learning.CONGESTION_FEATURES)
    train, test = learning.train_and_test(training, learning.CONGESTION_LABEL, KEYS, factor=5)
    model = learning.fit_forest(train, columns, learning.CONGESTION_LABEL, trees=5, depth=4)
    path = session.scratch(spark, "model")
    learning.save(model, path)
    scored = learning.score(learning.restore(path), test)
    row = learning.classification_metrics(scored, learning.CONGESTION_LABEL, "prediction", "score").head()
    assert row.rows == test.count() and row.accuracy > .95 and row.auc > .95
    ranked = learning.importances(spark, model, columns).collect()
    assert {ranked[0].feature, ranked[1].feature} == {"avg_bandwidth_util", "peak_bandwidth_util"}
    assert abs(sum(r.importance for r in ranked) - 1) < 1e-9


def test_boosted_learns(training):
    columns, _ = learning.available(training, learning.CONGESTION_FEATURES)
    train, test = learning.train_and_test(training, learning.CONGESTION_LABEL, KEYS)
    model = learning.fit_boosted(train, columns, learning.CONGESTION_LABEL, rounds=4, depth=3)
    scored = learning.score(model, test)
    assert scored.where(F.col("prediction") != F.col(learning.CONGESTION_LABEL)).count() < 6


def test_metrics_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(2), rng.choice([.1, .25, .5, .500001, round(rng.random(), 5)]))
            for _ in range(300)]
    scored = spark.createDataFrame(rows, "y int, p int, s double")
    row = learning.classification_metrics(scored, "y", "p", "s").head()
    hits = sum(y == p == 1 for y, p, _ in rows)
    pairs = [(a, b) for ya, _, a in rows if ya for yb, _, b in rows if not yb]
    wins = sum((a > b) + (a == b) / 2 for a, b in pairs)
    assert row.auc == round(wins / len(pairs), 6)
    assert row.accuracy == round(sum(y == p for y, p, _ in rows) / 300, 6)
    assert row.precision == round(hits / sum(p for _, p, _ in rows), 6)
    assert row.recall == round(hits / sum(y for y, _, _ in rows), 6)


@pytest.mark.parametrize("rows, area", [
    ([(1, .1000004), (0, .1000001)], 1.0), ([(1, 1e9), (0, -1e12), (1, 3.0), (0, 2e9)], 0.5), ([(1, .5), (0, .5)], 0.5),
    ([(1, .9), (0, .1), (1, None), (0, None), (None, .5)], 1.0), ([(1, float("inf")), (0, 1e308)], 1.0)])
def test_area_of_close_wide_tied_and_missing_scores(spark, rows, area):
    scored = spark.createDataFrame([(y, y, s) for y, s in rows], "y int, p int, s double")
    row = learning.classification_metrics(scored, "y", "p", "s").head()
    assert row.auc == area and row.unscored == sum(s is None for _, s in rows)


def test_metrics_of_one_class(spark):
    scored = spark.createDataFrame([(0, 0, .2), (0, 0, .3)], "y int, p int, s double")
    row = learning.classification_metrics(scored, "y", "p", "s").head()
    assert (row.accuracy, row.precision, row.recall, row.auc) == (1.0, 0.0, 0.0, 0.0)


def test_class_report(spark):
    scored = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "y int, p int")
    found = {r[0]: tuple(r)[1:] for r in learning.class_report(scored, "y", "p").collect()}
    assert found == {1: (.5, .5, .5, 2), 0: (.666667, .666667, .666667, 3)}


def test_future_label(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 0)],
                               f"tower_id string, window_start int, {learning.CONGESTION_LABEL} int")
    later = learning.future_label(df).orderBy("window_start").collect()
    assert [r.congested_later for r in later] == [1, 0, None]
