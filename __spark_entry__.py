
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from capacast import session  # noqa: E402
from capacast.functions import scalars, scores  # noqa: E402
from capacast.operators import asof, joins, ranking, rows, selection  # noqa: E402
from capacast.plans import campaign, layers, learning, refresh, reports, rollups, serving, sketches  # noqa: E402
from capacast.sources import bindings, schemas, tables  # noqa: E402
from capacast.streaming import jobs, loop, trends  # noqa: E402

try:  # the training-data operators are an optional part
    import corpus_pipeline  # noqa: E402
    from capacast.llm import queries as llm  # noqa: E402
except ImportError as missing:  # a path means that the module is there and broken
    if missing.name not in ("corpus_pipeline", "capacast.llm") or missing.path:
        raise
    llm = None

DAY = 86400
HOUR = 3600
SCORE_CUT = 40
AS_OF = "2024-01-31 00:00:00"
PREFIX = "PROP-CUP-"
EVENT = campaign.Campaign("EVT-001", "Cup final", "2024-01-31", "Main venue", PREFIX)


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


class Tables:
    """The domain tables of one test folder; every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = session.configure(spark)
        self.folder = folder

    @cached_property
    def telemetry(self) -> DataFrame:
        return bindings.telemetry(self.spark, self.folder)

    @cached_property
    def accounts(self) -> DataFrame:
        return bindings.accounts(self.spark, self.folder)

    @cached_property
    def calendar(self) -> DataFrame:
        return bindings.events(self.spark, self.folder)

    @cached_property
    def slices(self) -> DataFrame:
        return bindings.slices(self.spark, self.folder)

    @cached_property
    def cleaned(self) -> DataFrame:
        return layers.clean_telemetry(self.telemetry)

    @cached_property
    def enriched(self) -> DataFrame:
        return layers.enrich_accounts(self.accounts)

    @cached_property
    def near_sites(self) -> DataFrame:
        return joins.sites_near(self.calendar, joins.distinct_sites(self.telemetry))

    @cached_property
    def features(self) -> DataFrame:
        return layers.congestion_features(self.cleaned, self.near_sites, DAY)

    @cached_property
    def opportunities(self) -> DataFrame:
        return layers.account_opportunities(self.enriched, self.slices, self.features, at(AS_OF), SCORE_CUT)

    @cached_property
    def features_5min(self) -> DataFrame:
        """Features at the defaults of the job."""
        return layers.congestion_features(self.cleaned, self.near_sites)

    @cached_property
    def opportunities_5min(self) -> DataFrame:
        return layers.account_opportunities(self.enriched, self.slices, self.features_5min, at(AS_OF))

    @cached_property
    def rollup(self) -> DataFrame:
        return layers.revenue_rollup(self.opportunities, "window_start")

    @cached_property
    def targets(self) -> DataFrame:
        return campaign.select_targets(self.opportunities)

    @cached_property
    def log(self) -> DataFrame:
        sent = F.timestamp_add("HOUR", F.col("contract_renewal_months"), F.col("window_start"))
        return campaign.proposals(self.targets, sent, PREFIX)

    def landed(self) -> Tables:
        """The same tables with features, opportunities and log written once and read by what follows."""
        found = Tables(self.spark, self.folder)
        found.features = session.materialise(self.features, "features")
        found.opportunities = session.materialise(found.opportunities, "opportunities")
        found.log = session.materialise(found.log, "log")
        return found

    @cached_property
    def summaries(self) -> DataFrame:
        """One summary per segment, standing in for a history of events."""
        grouped = campaign.campaign_summary(
            self.log, ["customer_segment"], summary_generated_at=F.max("sent_at"))
        return grouped.select(
            F.concat(F.lit("EVT-"), "customer_segment").alias("event_id"),
            F.col("customer_segment").alias("event_name"),
            F.to_date("summary_generated_at").alias("event_date"), F.lit("Main venue").alias("venue_name"),
            F.col("total_targeted").alias("b2b_customers_targeted"),
            F.col("total_accepted").alias("b2b_customers_accepted"), "acceptance_rate",
            F.col("immediate_monthly_upsell").alias("immediate_monthly_upsell_usd"),
            F.col("projected_upsell_arr").alias("projected_upsell_arr_usd"),
            F.col("arr_protected_from_churn").alias("arr_protected_from_churn_usd"),
            F.col("total_targeted").alias("burst_slices_provisioned"), "sla_violations", "summary_generated_at")

    @cached_property
    def training(self) -> DataFrame:
        return learning.feature_table(
            self.features, learning.CONGESTION_FEATURES, learning.CONGESTION_LABEL, SITE_WINDOW)

    @cached_property
    def account_training(self) -> DataFrame:
        labelled = learning.simulated_label(learning.with_tickets(self.opportunities, self.enriched))
        return learning.feature_table(
            labelled, learning.ACCOUNT_FEATURES, learning.ACCOUNT_LABEL, ["customer_id"])

    def telemetry_stream(self) -> DataFrame:
        return bindings.telemetry_from(bindings.source_stream(self.spark, "events", self.folder))

    def account_stream(self) -> DataFrame:
        return bindings.accounts_from(bindings.source_stream(self.spark, "customer", self.folder))


SITE_WINDOW = ["tower_id", "window_start"]


# --- rows and expressions -------------------------------------------------------------------

def ingest_select(t: Tables) -> DataFrame:
    return rows.ingest(t.telemetry, schemas.names(schemas.TELEMETRY), stamp=False)


def require_not_null(t: Tables) -> DataFrame:
    needed = ["tower_id", "timestamp", "bandwidth_utilization_pct"]
    return rows.require_not_null(t.telemetry, needed).select(*needed)


def clamp_columns(t: Tables) -> DataFrame:
    percent = ["bandwidth_utilization_pct", "packet_loss_pct", "error_rate_pct"]
    return t.telemetry.select(
        "tower_id", "timestamp",
        scalars.clamp(F.col("active_connections"), 0).alias("active_connections"),
        *[scalars.clamp(F.col(c), 0.0).alias(c) for c in ("latency_ms", "throughput_mbps")],
        *[scalars.clamp(F.col(c), 0.0, 100.0).alias(c) for c in percent])


def range_or_null(t: Tables) -> DataFrame:
    signal = scalars.in_range_or_null(F.col("signal_strength_dbm"), -120, -30)
    return t.telemetry.select("tower_id", "timestamp", signal.alias("signal_strength_dbm"))


def _score(t: Tables, **options) -> DataFrame:
    indicators = ["bandwidth_utilization_pct", "packet_loss_pct", "latency_ms", "error_rate_pct"]
    score = scores.congestion_score(*[F.col(c) for c in indicators], **options)
    return t.telemetry.select("tower_id", "timestamp", score.alias("congestion_score"))


def weighted_score(t: Tables) -> DataFrame:
    return _score(t)


def weighted_score_raw(t: Tables) -> DataFrame:
    return _score(t, clamped=False, digits=None)


def segment_lookup(t: Tables) -> DataFrame:
    return t.enriched.select("customer_id", "contract_tier", "sla_tier", "customer_segment")


def rule_cascade_score(t: Tables) -> DataFrame:
    return t.enriched.select("customer_id", "upsell_propensity_score")


def expansion_value(t: Tables) -> DataFrame:
    return t.enriched.select("customer_id", "monthly_upsell_opportunity_usd")


def breach_level(t: Tables) -> DataFrame:
    level = scores.breach_level(F.col("utilization_pct"))
    return t.slices.select("slice_id", "utilization_pct", level.alias("breach_risk_level"))


def account_score(t: Tables) -> DataFrame:
    hot = layers.hottest_slice(t.slices).select("customer_id", "utilization_pct")
    score = scores.account_score(
        F.col("upsell_propensity_score"), F.col("utilization_pct"), F.col("contract_renewal_months") % 2)
    return t.enriched.join(hot, "customer_id").select("customer_id", score.alias("conversion_score"))


def select_targets(t: Tables) -> DataFrame:
    return t.targets.select(
        "customer_id", "conversion_score", (F.col("conversion_score") > 0.65).alias("show_proposal"))


def sampled_outcome(t: Tables) -> DataFrame:
    return campaign.decide(t.targets).select(
        "customer_id", "customer_type", "accepted", "monthly_revenue_opportunity", "annual_upsell_contribution")


def burst_slices(t: Tables) -> DataFrame:
    return campaign.burst_slices(t.targets, F.col("scored_at"))


def prefix_filter(t: Tables) -> DataFrame:
    return t.telemetry.where(scalars.with_prefix(F.col("tower_id"), "LF-")).select("tower_id", "timestamp")


def suffix_filter(t: Tables) -> DataFrame:
    kind = F.col("slice_type")
    return t.slices.where(scalars.burst_suffix(kind)).select(
        "slice_id", "slice_type", scalars.burst_suffix(kind, strict=True).alias("strict_burst"))


def recent_window(t: Tables) -> DataFrame:
    windows = layers.tumbling_features(t.cleaned)
    return windows.where(scalars.since(F.col("window_start"), at("2024-01-20 12:00:00"), 30)).select(
        "tower_id", "window_start", "avg_bandwidth_util")


def coerce_default(t: Tables) -> DataFrame:
    turn = F.col("event_id") % 3
    raw = F.when(turn == 0, F.col("props")).when(turn == 1, F.col("value").cast("string"))
    return bindings.source(t.spark, "events", t.folder).select(
        "event_id", scalars.number_or(raw).alias("number"), scalars.number_or(raw, -1).alias("number_or_minus_one"))


def severity_band(t: Tables) -> DataFrame:
    return t.features.select(*SITE_WINDOW, scores.severity_band(F.col("avg_bandwidth_util") / 100).alias("band"))


def staggered_rollout(t: Tables) -> DataFrame:
    step = scores.rollout_step(F.col("customer_id"), F.col("conversion_score"))
    return t.opportunities.select("customer_id", step.alias("rollout_step"))


def utilization_ratio(t: Tables) -> DataFrame:
    share = scalars.ratio_pct(F.col("current_bandwidth_mbps"), F.col("contracted_bandwidth_mbps"))
    return t.slices.select("slice_id", share.alias("utilization"))


def status_as_of(t: Tables) -> DataFrame:
    return rows.status_as_of(t.slices, at("1998-06-01 12:00:00")).select("slice_id", "status")


def union_evolving(t: Tables) -> DataFrame:
    old = t.telemetry.select("tower_id", "timestamp", "latency_ms")
    return rows.union_evolving(old, t.telemetry.select(*old.columns, "throughput_mbps"))


def scalar_time_bucket(t: Tables) -> DataFrame:
    time = F.col("timestamp")
    return t.telemetry.dropna(subset=["timestamp"]).select(
        "tower_id", "timestamp", scalars.time_bucket(time, 300).alias("window_start"),
        F.hour(time).alias("hour_of_day"), F.dayofweek(time).alias("day_of_week"), F.to_date(time).alias("day"),
        F.unix_timestamp(time).alias("unix_seconds"))


def scalar_string_ids(t: Tables) -> DataFrame:
    hashed = F.upper(F.md5("customer_id"))
    return t.accounts.select(
        "customer_id", hashed.alias("full_id"),
        F.concat(F.lit("PROP-"), F.substring(hashed, 1, 8)).alias("short_id"),
        scalars.hash_unit(F.col("customer_id"), "x").alias("unit"))


# --- joins and appends ----------------------------------------------------------------------

def near_event_flag(t: Tables) -> DataFrame:
    return t.features.select(*SITE_WINDOW, "near_event_flag")


def near_event_flag_timed(t: Tables) -> DataFrame:
    spans = layers.event_proximity(t.calendar, t.telemetry)
    flagged = joins.flag_windows_inside(
        layers.tumbling_features(t.cleaned, DAY), spans, "tower_id", DAY, "near_event_flag")
    return flagged.select(*SITE_WINDOW, "near_event_flag")


def join_top1(t: Tables) -> DataFrame:
    hot = layers.hottest_slice(t.slices).select("customer_id", "slice_id", "tower_id", "utilization_pct")
    return t.enriched.join(hot, "customer_id").select(
        "customer_id", "company_name", "slice_id", "tower_id", "utilization_pct")


def site_status(t: Tables) -> DataFrame:
    return serving.site_status(t.telemetry, t.features, "LF-")


def latest_global_window(t: Tables) -> DataFrame:
    return serving.newest_windows(t.features).select(
        "tower_id", "avg_congestion_score", "avg_bandwidth_util", "congestion_predicted_15min",
    ).orderBy(F.desc("avg_congestion_score"), F.asc("tower_id"))


def dimension_backfill(t: Tables) -> DataFrame:
    return serving.complete_status(site_status(t), t.telemetry)


def append_idempotent(t: Tables) -> DataFrame:
    """Appends the same burst slices twice; the second append adds nothing."""
    path = session.scratch(t.spark, "burst-slices")
    bursts = session.materialise(campaign.burst_slices(t.targets, F.col("scored_at")), "bursts")
    for _ in range(2):
        tables.append_new(bursts, path, ["slice_id"])
    return t.spark.read.schema(bursts.schema).parquet(path)


def append_to_buckets(t: Tables) -> DataFrame:
    """The same burst slices appended twice, in two parts at first, to a target laid out by slice."""
    path = session.scratch(t.spark, "burst-slices")
    bursts = session.materialise(campaign.burst_slices(t.targets, F.col("scored_at")), "bursts")
    for part in (bursts.where(F.pmod(F.xxhash64("slice_id"), F.lit(2)) == 0), bursts, bursts):
        tables.append_to_buckets(part, path, ["slice_id"])
    return t.spark.read.schema(bursts.schema).parquet(path).select(*bursts.columns)


PLACE = ["latitude", "longitude"]


def site_places(t: Tables) -> DataFrame:
    """The intervals in which each site is known to have been at a place."""
    return asof.validity(asof.changes(t.telemetry, "tower_id", "timestamp", PLACE), "tower_id", "timestamp")


def site_as_of(t: Tables) -> DataFrame:
    """Each reading with the place of its site as it was last known at that time."""
    readings = t.telemetry.select("tower_id", "timestamp", "active_connections")
    moves = asof.changes(t.telemetry, "tower_id", "timestamp", PLACE)
    return asof.join_as_of(readings, moves, "tower_id", "timestamp", PLACE)


# --- aggregates -----------------------------------------------------------------------------

def distinct_counts(t: Tables) -> DataFrame:
    accounts = serving.distinct_count(t.opportunities, "customer_id", "accounts_at_risk").scalar()
    return serving.distinct_count(t.telemetry, "tower_id", "active_towers").withColumn("accounts_at_risk", accounts)


def rolling_distinct(t: Tables) -> DataFrame:
    """Sites seen in the seven days up to each day, and whether the count from daily sketches is within 2 % of it."""
    path = session.scratch(t.spark, "sketches")
    sketches.store(sketches.daily_sketches(t.telemetry, "tower_id"), path)
    estimated = sketches.rolling_distinct(sketches.stored(t.spark, path), 7, "estimated")
    exact = sketches.rolling_distinct_exact(t.telemetry, "tower_id", 7, "active_towers")
    error = F.abs(F.col("estimated") - F.col("active_towers"))
    return exact.join(estimated, "day", "left").select(
        "day", "active_towers", F.coalesce(error <= 0.02 * F.col("active_towers"), F.lit(False)).alias("close"))


def replay_from_rollups(t: Tables) -> DataFrame:
    """A step of the replay from rollups by minute, hour and day; later days come in a second turn."""
    folder = session.scratch(t.spark, "rollups")
    middle = at("2024-01-16 00:00:00")
    for part in (F.col("timestamp") < middle, F.col("timestamp") >= middle):
        rollups.write_rollups(t.telemetry.where(part), folder)
    return rollups.replay_step(t.spark, folder, 12)


def filtered_counts(t: Tables) -> DataFrame:
    active = F.col("status") == "active"
    return t.slices.agg(
        F.count(F.lit(1)).alias("slices"), F.count_if(active).alias("active"),
        F.count_if(active & scalars.burst_suffix(F.col("slice_type"))).alias("burst_slices"))


def kpi_bundle(t: Tables) -> DataFrame:
    t = t.landed()
    return serving.kpi_bundle(t.opportunities, t.telemetry, t.features, t.log, t.summaries, t.slices)


# --- windows and ranking --------------------------------------------------------------------

def lag_trend(t: Tables) -> DataFrame:
    """Trends over one-minute windows; a site's history is cut into days."""
    minutes = layers.tumbling_features(t.cleaned, 60)
    return layers.with_trends(minutes, chunk_seconds=DAY).select(
        *SITE_WINDOW, "avg_bandwidth_util", "bandwidth_trend_15min", "connection_trend_15min")


def window_trend(t: Tables) -> DataFrame:
    return layers.with_trends(layers.tumbling_features(t.cleaned)).select(
        *SITE_WINDOW, "bandwidth_trend_15min", "connection_trend_15min")


def latest_per_key(t: Tables) -> DataFrame:
    return ranking.newest_values(
        t.cleaned, ["tower_id"], "timestamp", ["bandwidth_utilization_pct", "congestion_score"])


def top1_per_key(t: Tables) -> DataFrame:
    return layers.hottest_slice(t.slices.select(
        "customer_id", "slice_id", "tower_id", "utilization_pct", "status")).drop("status")


def ranked_accounts(t: Tables) -> DataFrame:
    return serving.ranked_accounts(t.opportunities, [
        "customer_id", "company_name", "customer_type", "customer_segment", "conversion_score",
        "utilization_pct", "breach_risk_level", "tower_id", "contracted_bandwidth_mbps",
        "current_bandwidth_mbps", "monthly_revenue_opportunity", "monthly_contract_value"])


# --- streams --------------------------------------------------------------------------------

def naive_times(df: DataFrame) -> DataFrame:
    """Times without a zone, as the batch results have them."""
    zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


def stream_ingest(t: Tables) -> DataFrame:
    raw = jobs.ingest_stream(t.telemetry_stream(), schemas.names(schemas.TELEMETRY))
    return jobs.run_fresh(raw, "ingested").drop("ingested_at")


def stream_clean(t: Tables) -> DataFrame:
    return jobs.run_fresh(jobs.clean_stream(t.telemetry_stream()), "cleaned")


def stream_enrich(t: Tables) -> DataFrame:
    return jobs.run_fresh(jobs.enrich_stream(t.account_stream()), "enriched")


def stream_tumbling(t: Tables) -> DataFrame:
    windows = jobs.tumbling_stream(jobs.clean_stream(t.telemetry_stream()), HOUR)
    return naive_times(jobs.run_fresh(windows, "windows"))


def stream_trend(t: Tables) -> DataFrame:
    """Trends of the windows that each of two runs closes; new files arrive in between."""
    raw, windows, marks, out = (session.scratch(t.spark, n) for n in ("raw", "windows", "marks", "trends"))
    time = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    middle = t.telemetry.agg((F.min(time) + F.max(time)) / 2).scalar()
    since = at("1900-01-01")
    for part in (F.coalesce(time < middle, F.lit(True)), time >= middle):
        tables.append(t.telemetry.where(part), raw)
        stream = jobs.tumbling_stream(jobs.clean_stream(tables.stream(t.spark, raw, t.telemetry.schema)), HOUR)
        closed = naive_times(jobs.run_to_files(stream, windows, marks))
        tables.append(jobs.trends_of_new(closed, since), out)
        newest = closed.agg(F.max("window_end")).scalar()
        since = F.coalesce(newest, at("1900-01-01"))
    return t.spark.read.parquet(out)


def stream_trend_stateful(t: Tables) -> DataFrame:
    """Trends kept on the stream over three runs; some readings arrive a run late."""
    raw, out, marks = (session.scratch(t.spark, n) for n in ("raw", "trends", "marks"))
    time = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    low, high = t.telemetry.agg(F.min(time), F.max(time)).first()
    step = ((high or 0) - (low or 0)) / 3 + 1
    delayed = F.when(F.pmod(time, F.lit(3)) == 0, 300).otherwise(0)  # up to five minutes, within the watermark
    run = F.coalesce(F.least(F.lit(2), F.floor((time - (low or 0) + delayed) / step)), F.lit(0))
    for number in range(3):
        tables.append(t.telemetry.where(run == number), raw)
        windows = jobs.tumbling_stream(jobs.clean_stream(tables.stream(t.spark, raw, t.telemetry.schema)), HOUR)
        found = jobs.run_to_files(trends.trend_stream(windows), out, marks)
    return naive_times(found)


def stream_latest(t: Tables) -> DataFrame:
    """Closed windows from the state stream, open ones from the landed readings."""
    closed = naive_times(jobs.run_fresh(jobs.latest_stream(jobs.clean_stream(t.telemetry_stream()), HOUR), "latest"))
    readings = jobs.run_fresh(jobs.clean_stream(t.telemetry_stream()), "readings")
    return jobs.current_state(closed, readings, HOUR)


def stream_provision(t: Tables) -> DataFrame:
    """Streamed windows to provisioned slices; the loop runs twice and adds no slice twice."""
    stream = jobs.tumbling_stream(jobs.clean_stream(t.telemetry_stream()), DAY)
    windows = naive_times(jobs.run_fresh(stream, "windows"))
    path = session.scratch(t.spark, "slices")
    tables.append(t.slices, path)
    for _ in range(2):
        current = t.spark.read.schema(t.slices.schema).parquet(path)
        found = jobs.opportunities_of_closed(
            windows, t.near_sites, t.enriched, current, at(AS_OF), SCORE_CUT)
        bursts = campaign.burst_slices(campaign.select_targets(found), F.col("scored_at"))
        tables.append_new(session.materialise(bursts, "bursts"), path, ["slice_id"])
    return t.spark.read.schema(t.slices.schema).parquet(path).where(F.col("slice_id").startswith("BURST-"))


def stream_provision_loop(t: Tables) -> DataFrame:
    """Opportunities after three turns of the closed loop, each of which reads the windows that are new to it."""
    raw, out, marks, progress, slices = (
        session.scratch(t.spark, n) for n in ("raw", "windows", "marks", "progress", "slices"))
    time = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    low, high = t.telemetry.agg(F.min(time), F.max(time)).first()
    run = F.coalesce(F.least(F.lit(2), F.floor((time - (low or 0)) * 3 / ((high or 0) - (low or 0) + 1))), F.lit(0))
    for number in range(3):
        tables.append(t.telemetry.where(run == number), raw)
        windows = jobs.tumbling_stream(jobs.clean_stream(tables.stream(t.spark, raw, t.telemetry.schema)), DAY)
        landed = naive_times(jobs.run_to_files(trends.trend_stream(windows), out, marks, by_day="window_start"))
        found = loop.step(landed, progress, t.near_sites, t.enriched, t.slices, slices, at(AS_OF), SCORE_CUT)
    return found


def layer_refresh(t: Tables) -> DataFrame:
    """All layers written to files from the older readings, then brought up to date with the newer ones, and once more
    without new input."""
    folder, raw = session.scratch(t.spark, "layers"), session.scratch(t.spark, "raw")
    settings = refresh.Settings(window_seconds=DAY, score_cut=SCORE_CUT, rollup_time="window_start")
    time = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    middle = t.telemetry.agg((F.min(time) + F.max(time)) / 2).scalar()
    for part in (F.coalesce(time < middle, F.lit(True)), time >= middle, None):
        if part is not None:
            tables.write_history(t.telemetry.where(part), raw, "timestamp", ["tower_id"])
        streams = {"telemetry": tables.stream(t.spark, raw, t.telemetry.schema), "accounts": t.account_stream()}
        written = refresh.refresh(folder, streams, t.calendar, t.slices, at(AS_OF), settings)
    return written[refresh.REVENUE]


# --- learning -------------------------------------------------------------------------------

def stratified_split(t: Tables) -> DataFrame:
    table = session.materialise(t.training, "training")
    return selection.stratified_split(table, learning.CONGESTION_LABEL, SITE_WINDOW).select(
        *SITE_WINDOW, learning.CONGESTION_LABEL, "is_test")


def oversample(t: Tables) -> DataFrame:
    train = session.materialise(stratified_split(t), "split").where(~F.col("is_test"))
    grown = selection.oversample(train, learning.CONGESTION_LABEL, SITE_WINDOW)
    return grown.groupBy(*SITE_WINDOW, learning.CONGESTION_LABEL).agg(F.count(F.lit(1)).alias("copies"))


def _forest(t: Tables):
    train, test = learning.train_and_test(t.training, learning.CONGESTION_LABEL, SITE_WINDOW, factor=5)
    model = learning.fit_forest(train, learning.CONGESTION_FEATURES, learning.CONGESTION_LABEL)
    return model, test


def rf_train_score(t: Tables) -> DataFrame:
    """Fit, save, read back, score the held-out rows."""
    model, test = _forest(t)
    path = session.scratch(t.spark, "forest")
    learning.save(model, path)
    return learning.score(learning.restore(path), test).select(
        *SITE_WINDOW, learning.CONGESTION_LABEL, "prediction", "score")


def feature_importances(t: Tables) -> DataFrame:
    model, _ = _forest(t)
    return learning.importances(t.spark, model, learning.CONGESTION_FEATURES)


def gbt_train_score(t: Tables) -> DataFrame:
    train, test = learning.train_and_test(t.account_training, learning.ACCOUNT_LABEL, ["customer_id"])
    model = learning.fit_boosted(train, learning.ACCOUNT_FEATURES, learning.ACCOUNT_LABEL)
    return learning.score(model, test).select("customer_id", learning.ACCOUNT_LABEL, "prediction", "score")


def _checked(t: Tables, model, test: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Scored test rows: whether prediction and score are in range, and the saved model gives the same."""
    path = session.scratch(t.spark, "model")
    learning.save(model, path)
    scored = learning.score(model, test).select(*keys, label, "prediction", "score")
    again = learning.score(learning.restore(path), test).select(
        *keys, F.col("prediction").alias("prediction_again"), F.col("score").alias("score_again"))
    valid = F.col("prediction").isin(0.0, 1.0) & F.col("score").between(0.0, 1.0)
    same = (F.col("prediction") == F.col("prediction_again")) & (F.col("score") == F.col("score_again"))
    return scored.join(again, keys).withColumn("valid", valid).withColumn("same_when_restored", same)


def rf_held_out(t: Tables) -> DataFrame:
    """The forest on the held-out rows, and whether it is right more often than the 85 % asked for."""
    model, test = _forest(t)
    checked = session.materialise(_checked(t, model, test, SITE_WINDOW, learning.CONGESTION_LABEL), "scored")
    right = checked.agg(F.avg((F.col("prediction") == F.col(learning.CONGESTION_LABEL)).cast("int"))).scalar()
    return checked.select(*SITE_WINDOW, learning.CONGESTION_LABEL, "valid", "same_when_restored",
                          (right > 0.85).alias("accurate"))


def gbt_held_out(t: Tables) -> DataFrame:
    train, test = learning.train_and_test(t.account_training, learning.ACCOUNT_LABEL, ["customer_id"])
    model = learning.fit_boosted(train, learning.ACCOUNT_FEATURES, learning.ACCOUNT_LABEL, rounds=20)
    return _checked(t, model, test, ["customer_id"], learning.ACCOUNT_LABEL).select(
        "customer_id", learning.ACCOUNT_LABEL, "valid", "same_when_restored")


def importance_total(t: Tables) -> DataFrame:
    """One row for each wanted feature, none missing, and the rounded sum of all importances."""
    found = feature_importances(t)
    total = found.agg(F.round(F.sum("importance"), 6)).scalar()
    return found.select("feature", F.col("importance").between(0.0, 1.0).alias("valid"), total.alias("total"))


def simulated_label(t: Tables) -> DataFrame:
    return learning.simulated_label(t.opportunities).select(
        "customer_id", "conversion_score", learning.ACCOUNT_LABEL)


def _judged(t: Tables) -> DataFrame:
    """Accepted proposals as truth, a high account score as the guess."""
    return campaign.decide(t.targets).select(
        F.col("accepted").cast("int").alias("label"),
        (F.col("conversion_score") > 0.7).cast("int").alias("prediction"), F.col("conversion_score").alias("score"))


REGISTRY: dict[str, Callable[[Tables], DataFrame]] = {
    "ingest_select": ingest_select,
    "require_not_null": require_not_null,
    "clamp_columns": clamp_columns,
    "range_or_null": range_or_null,
    "weighted_score": weighted_score,
    "weighted_score_raw": weighted_score_raw,
    "clean_telemetry": lambda t: t.cleaned,
    "enrich_accounts": lambda t: t.enriched,
    "segment_lookup": segment_lookup,
    "rule_cascade_score": rule_cascade_score,
    "expansion_value": expansion_value,
    "breach_level": breach_level,
    "account_score": account_score,
    "select_targets": select_targets,
    "sampled_outcome": sampled_outcome,
    "burst_slices": burst_slices,
    "proposal_message": lambda t: t.log,
    "prefix_filter": prefix_filter,
    "suffix_filter": suffix_filter,
    "recent_window": recent_window,
    "coerce_default": coerce_default,
    "severity_band": severity_band,
    "staggered_rollout": staggered_rollout,
    "utilization_ratio": utilization_ratio,
    "status_as_of": status_as_of,
    "union_evolving": union_evolving,
    "scalar_time_bucket": scalar_time_bucket,
    "scalar_string_ids": scalar_string_ids,
    "near_event_flag": near_event_flag,
    "near_event_flag_timed": near_event_flag_timed,
    "geo_proximity": lambda t: layers.event_proximity(t.calendar, t.telemetry),
    "join_top1": join_top1,
    "account_opportunities": lambda t: t.opportunities,
    "site_status": site_status,
    "latest_global_window": latest_global_window,
    "dimension_backfill": dimension_backfill,
    "renewal_risk_accounts": lambda t: reports.renewal_risk(t.opportunities, t.enriched),
    "append_idempotent": append_idempotent,
    "append_to_buckets": append_to_buckets,
    "site_places": site_places,
    "site_as_of": site_as_of,
    "tumbling_features": lambda t: layers.tumbling_features(t.cleaned),
    "congestion_features": lambda t: t.features,
    "congestion_features_5min": lambda t: t.features_5min,
    "account_opportunities_5min": lambda t: t.opportunities_5min,
    "revenue_rollup": lambda t: t.rollup,
    "site_summary": lambda t: serving.site_summary(t.features),
    "site_summary_recent": lambda t: serving.site_summary(t.features, at("2024-01-30 12:00:00"), 2 * 24 * 60),
    "campaign_summary": lambda t: campaign.campaign_summary(t.log),
    "event_summary": lambda t: campaign.event_summary(t.log, EVENT, at(AS_OF)),
    "distinct_counts": distinct_counts,
    "filtered_counts": filtered_counts,
    "kpi_bundle": kpi_bundle,
    "segment_value": lambda t: serving.segment_value(t.rollup),
    "segment_scores": lambda t: serving.segment_scores(t.rollup),
    "segment_scores_weighted": lambda t: serving.segment_scores(t.rollup, weighted=True),
    "time_step_replay": lambda t: serving.time_steps(t.telemetry),
    "time_step_replay_prefix": lambda t: serving.time_steps(t.telemetry, prefix="LF-"),
    "congested_per_step": lambda t: serving.congested_per_step(serving.time_steps(t.telemetry)),
    "replay_from_rollups": replay_from_rollups,
    "rolling_distinct": rolling_distinct,
    "distinct_sites": lambda t: joins.distinct_sites(t.telemetry),
    "profile_counts": lambda t: reports.profile(t.accounts, "customer_type"),
    "slice_profile": lambda t: reports.slice_profile(t.slices),
    "sla_breach_count": lambda t: reports.sla_breaches(t.opportunities),
    "lag_trend": lag_trend,
    "window_trend": window_trend,
    "latest_per_key": latest_per_key,
    "top1_per_key": top1_per_key,
    "site_timeline": lambda t: reports.site_timeline(t.features, "LF-"),
    "site_running_total": lambda t: reports.site_running_total(t.features),
    "top_opportunities": lambda t: reports.top_opportunities(t.opportunities),
    "latest_summary": lambda t: serving.latest_summary(t.summaries),
    "activity_feed": lambda t: serving.activity_feed(t.log, t.features),
    "ranked_accounts": ranked_accounts,
    "event_summary_report": lambda t: reports.event_report(t.summaries, "media_rights"),
    "stream_ingest": stream_ingest,
    "stream_clean": stream_clean,
    "stream_enrich": stream_enrich,
    "stream_tumbling": stream_tumbling,
    "stream_trend": stream_trend,
    "stream_trend_stateful": stream_trend_stateful,
    "stream_latest": stream_latest,
    "stream_provision": stream_provision,
    "stream_provision_loop": stream_provision_loop,
    "layer_refresh": layer_refresh,
    "ml_feature_table": lambda t: t.training,
    "future_label": lambda t: learning.future_label(t.features).select(
        *SITE_WINDOW, learning.CONGESTION_LABEL, "congested_later"),
    "stratified_split": stratified_split,
    "oversample": oversample,
    "simulated_label": simulated_label,
    "label_balance": lambda t: learning.label_balance(t.training, learning.CONGESTION_LABEL),
    "classification_metrics": lambda t: learning.classification_metrics(
        _judged(t), "label", "prediction", "score"),
    "class_report": lambda t: learning.class_report(_judged(t), "label", "prediction"),
    "rf_train_score": rf_train_score,
    "gbt_train_score": gbt_train_score,
    "feature_importances": feature_importances,
    "rf_held_out": rf_held_out,
    "gbt_held_out": gbt_held_out,
    "importance_total": importance_total,
    "event_arr": lambda t: reports.event_arr(t.summaries),
    "acceptance_by_type": lambda t: reports.acceptance_by(t.log),
    "projected_annual": lambda t: reports.projected_annual(t.rollup),
    "top_accounts": lambda t: reports.top_accounts(t.opportunities),
    "closest_to_breach": lambda t: reports.closest_to_limit(t.opportunities),
    "critical_in_window": lambda t: reports.critical_between(t.log, at("2024-01-10"), at("2024-01-25")),
    "avg_util_by_type": lambda t: reports.mean_utilization(t.opportunities, "broadcaster"),
    "over_threshold": lambda t: reports.above_utilization(t.opportunities),
    "type_at_risk": lambda t: reports.type_at_risk(t.opportunities, "payment_processor"),
    "burst_count": lambda t: reports.burst_by_status(t.slices),
    "congested_now": lambda t: reports.congested_now(t.features),
    "last_alert": lambda t: reports.last_alert(t.features, SCORE_CUT),
    "sent_vs_accepted": lambda t: reports.sent_and_accepted(t.log),
    "segment_churn_risk": lambda t: reports.segment_churn_risk(t.opportunities),
    "avg_contract_by_type": lambda t: reports.mean_contract(t.accounts),
    "monthly_pipeline": lambda t: reports.monthly_pipeline(t.rollup),
    "arr_at_risk_slice": lambda t: reports.arr_at_risk(t.opportunities, "PLATINUM", "broadcaster"),
    "renewal_acceptance": lambda t: reports.renewal_acceptance(t.log, t.enriched),
    "active_slices_by_site": lambda t: reports.active_by_site(t.slices),
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: congestion features of the smallest folder."""
    return Tables(spark, "/root/testdata/sf0.001").features


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One callable (spark, folder) per operator."""
    def bind(job):
        return lambda spark, folder: job(Tables(spark, folder))
    found = {name: bind(job) for name, job in REGISTRY.items()}
    return found | llm.QUERIES | {"pipeline": corpus_pipeline.run} if llm else found


def oracle_sql() -> dict[str, str]:
    """The same results as SQL; iterative and provisioning jobs have none."""
    found = oracle_queries.statements()
    return found | llm.ORACLE_SQL if llm else found
