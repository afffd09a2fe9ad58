"""Training tables, exact sampling, forest and boosted models, and their metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit
from ..operators.rows import require_not_null
from ..operators.running import running
from ..operators.selection import oversample, stratified_split
from ..session import materialise, shared_folder

# Model inputs, settings and the simulated conversion rates.
CONGESTION_FEATURES = [
    "avg_bandwidth_util", "peak_bandwidth_util", "avg_connections", "avg_congestion_score", "avg_latency_ms",
    "avg_packet_loss_pct", "bandwidth_trend_15min", "connection_trend_15min", "near_event_flag", "hour_of_day",
    "day_of_week",
]
CONGESTION_LABEL = "congestion_predicted_15min"
ACCOUNT_FEATURES = [
    "monthly_contract_value", "contracted_bandwidth_mbps", "contract_renewal_months", "churn_risk_score",
    "support_tickets_30d", "upsell_propensity_score", "utilization_pct", "avg_congestion_score",
    "congestion_predicted_15min", "near_event_flag",
]
ACCOUNT_LABEL = "will_convert"
HIGH_SCORE = 0.7
HIGH_RATE = 0.47
LOW_RATE = 0.05
OVERSAMPLE_FACTOR = 5
SEED = 42


def available(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """The wanted features the table has, and those it lacks."""
    present = [c for c in features if c in df.columns]
    return present, [c for c in features if c not in present]


def feature_table(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str]) -> DataFrame:
    """Keys, the available features and the label; rows with a null are dropped."""
    present, _ = available(df, features)
    wanted = [*keys, *[c for c in present if c not in keys], label]
    return require_not_null(df.select(*wanted), [*present, label])


def future_label(features: DataFrame, steps: int = 1, label: str = CONGESTION_LABEL,
                 out: str = "congested_later") -> DataFrame:
    """The label ``steps`` windows later at the same site; null where none follows."""
    by_site = Window.partitionBy("tower_id").orderBy("window_start")
    return features.withColumn(out, F.lead(label, steps).over(by_site))


def simulated_label(opportunities: DataFrame, key: str = "customer_id", out: str = ACCOUNT_LABEL) -> DataFrame:
    """A repeatable conversion draw, likely above the high score and rare below."""
    high = F.col("conversion_score") > HIGH_SCORE
    draw = F.when(high, hash_unit(F.col(key), "high") < HIGH_RATE).otherwise(
        hash_unit(F.col(key), "low") < LOW_RATE)
    return opportunities.withColumn(out, draw.cast("int"))


def label_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of each label value; the total is taken over the few counts."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.round(F.col("rows") / total, 4))


def train_and_test(table: DataFrame, label: str, keys: Sequence[str], test_share: float = 0.2,
                   seed: int = SEED, factor: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Stratified split, then (optionally) oversampling of the training part only.

    Splitting first keeps copies of one row from landing on both sides.
    """
    table = materialise(table, "training")
    split = materialise(stratified_split(table, label, keys, test_share, seed), "split")
    train, test = (split.where(F.col("is_test") == side).drop("is_test") for side in (False, True))
    if factor:
        train = oversample(train, label, keys, factor, seed).drop("copy")
    return train, test


def _balanced(train: DataFrame, label: str) -> DataFrame:
    """Weight ``n / (2 * n_label)`` per row."""
    ones = train.agg(F.count_if(F.col(label) == 1)).scalar()
    total = train.agg(F.count(F.lit(1))).scalar()
    own = F.when(F.col(label) == 1, ones).otherwise(total - ones)
    return train.withColumn("weight", total / (F.lit(2.0) * own))


def _assembled(columns: Sequence[str], classifier) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), classifier])


def _checkpointed(df: DataFrame) -> None:
    # Boosting cuts its lineage every few rounds by a reliable checkpoint.
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))


def fit_forest(train: DataFrame, columns: Sequence[str], label: str, trees: int = 200, depth: int = 12,
               min_leaf: int = 2, seed: int = SEED) -> PipelineModel:
    """Random forest with balanced class weights."""
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, seed=seed)
    return _assembled(columns, forest).fit(_balanced(train, label))


def fit_boosted(train: DataFrame, columns: Sequence[str], label: str, rounds: int = 150, rate: float = 0.08,
                depth: int = 5, subsample: float = 0.8, seed: int = SEED) -> PipelineModel:
    """Gradient boosted trees."""
    _checkpointed(train)
    boosted = GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth,
        subsamplingRate=subsample, seed=seed, checkpointInterval=10)
    return _assembled(columns, boosted).fit(train)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and the probability of the positive class."""
    return model.transform(df).withColumn(
        "score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def restore(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(spark, model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """Feature importances, largest first; as many rows as features."""
    weights = model.stages[-1].featureImportances
    rows = [(name, float(weights[i])) for i, name in enumerate(columns)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), F.asc("feature"))


def _auc(scored: DataFrame, label: str, score_column: str) -> DataFrame:
    """Exact area under the curve from counts per distinct score, in one row; rows without a score are left out.

    A running count of the negatives over the distinct scores, without one task for all of them, gives those below a score.
    """
    counts = scored.where(F.col(score_column).isNotNull()).groupBy(F.col(score_column).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    fine = running(counts, [], ["score"], {"below": ("sum", "neg")}, inclusive=False)
    # Twice the number of ordered pairs, so ties count as whole numbers.
    double_wins = F.col("pos").cast("decimal(18,0)") * (
        F.col("below") * 2 + F.col("neg")).cast("decimal(19,0)")
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double") * 2
    return fine.agg(
        F.round(F.coalesce(F.try_divide(F.sum(double_wins).cast("double"), pairs), F.lit(0.0)), 6).alias("auc"))


def classification_metrics(scored: DataFrame, label: str, prediction: str, score_column: str) -> DataFrame:
    """Accuracy, precision, recall and AUC in one row; undefined values are 0.

    Rows without a score do not enter the AUC; ``unscored`` tells how many there are.
    """
    actual, said = F.col(label) == 1, F.col(prediction) == 1

    def share(top, bottom):
        return F.round(F.coalesce(F.try_divide(top, bottom), F.lit(0.0)), 6)

    n = F.count(F.lit(1))
    hits, claims, cases = F.count_if(actual & said), F.count_if(said), F.count_if(actual)
    right = F.count_if(F.col(label) == F.col(prediction))
    counted = scored.agg(
        n.alias("rows"), share(right, n).alias("accuracy"), share(hits, claims).alias("precision"),
        share(hits, cases).alias("recall"), F.count_if(F.col(score_column).isNull()).alias("unscored"))
    return counted.withColumn("auc", _auc(scored, label, score_column).scalar())


def class_report(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from one table of counts."""
    cells = scored.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("said")).agg(
        F.count(F.lit(1)).alias("n"))
    # A few rows from here on: one per pair of classes.
    both = cells.select(F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claims"),
                 F.when(F.col("actual") == F.col("said"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("said").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claims"),
                 F.lit(0).cast("bigint").alias("hits")),
    )).alias("part")).select("part.*")
    sums = both.groupBy("class").agg(
        F.sum("hits").alias("hits"), F.sum("claims").alias("claims"), F.sum("support").alias("support"))

    def share(top, bottom):
        return F.round(F.coalesce(F.try_divide(top, bottom), F.lit(0.0)), 6)

    return sums.select(
        F.col("class").cast("int").alias("class"),
        share(F.col("hits"), F.col("claims")).alias("precision"),
        share(F.col("hits"), F.col("support")).alias("recall"),
        share(F.col("hits") * 2, F.col("claims") + F.col("support")).alias("f1"), "support")


def evaluate_and_store(model: PipelineModel, test: DataFrame, columns: Sequence[str], label: str,
                       folder: str, missing: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Save the model, its scored test rows, its measures and the features it had to do without below ``folder``."""
    save(model, f"{folder}/model")
    score(model, test).write.mode("overwrite").parquet(f"{folder}/scored")
    scored = test.sparkSession.read.parquet(f"{folder}/scored")
    results = {
        "metrics": classification_metrics(scored, label, "prediction", "score"),
        "report": class_report(scored, label, "prediction"),
        "importances": importances(test.sparkSession, model, columns),
        "skipped": test.sparkSession.createDataFrame([(c,) for c in missing], "feature string"),
    }
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return results


def train_congestion(features: DataFrame, folder: str, **settings) -> dict[str, DataFrame]:
    """Predicted congestion of a window from its features, by a forest."""
    keys = ["tower_id", "window_start"]
    columns, missing = available(features, CONGESTION_FEATURES)
    table = feature_table(features, columns, CONGESTION_LABEL, keys)
    train, test = train_and_test(table, CONGESTION_LABEL, keys, factor=OVERSAMPLE_FACTOR)
    model = fit_forest(train, columns, CONGESTION_LABEL, **settings)
    return evaluate_and_store(model, test, columns, CONGESTION_LABEL, folder, missing)


def with_tickets(opportunities: DataFrame, accounts: DataFrame) -> DataFrame:
    """Opportunities with the account's recent support tickets, which the model wants as well."""
    return opportunities.join(accounts.select("customer_id", "support_tickets_30d"), "customer_id")


def train_accounts(opportunities: DataFrame, accounts: DataFrame, folder: str, **settings) -> dict[str, DataFrame]:
    """Conversion of an account from its contract and its site, by boosted trees."""
    labelled = simulated_label(with_tickets(opportunities, accounts))
    columns, missing = available(labelled, ACCOUNT_FEATURES)
    table = feature_table(labelled, columns, ACCOUNT_LABEL, ["customer_id"])
    train, test = train_and_test(table, ACCOUNT_LABEL, ["customer_id"])
    model = fit_boosted(train, columns, ACCOUNT_LABEL, **settings)
    return evaluate_and_store(model, test, columns, ACCOUNT_LABEL, folder, missing)
