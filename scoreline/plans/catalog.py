"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreline.functions import columns as C
from scoreline.operators import (
    alerts,
    clean,
    drift,
    features,
    merge,
    metrics,
    models,
    quality,
    registry,
    sketches,
    split,
    views,
)
from scoreline.plans import bindings as B
from scoreline.plans import cycle
from scoreline.session import fresh_dir
from scoreline.sources import records, sinks, tables
from scoreline.sources.store import Store
from scoreline.streaming import events, flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed values used by queries and their SQL alike.
PROCESSED = "2024-02-01T00:00:00Z"
NUMERIC = ("churn_probability", "actual_churn")
MINIMUMS = {"accuracy": 0.5, "recall": 0.1, "roc_auc": 0.5}
ALERTS = alerts.AlertConfig(min_records=320, max_records=350)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _text(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as ISO text, the same in every engine."""
    return df.withColumns({n: C.iso_second(F.col(n)) for n in names})


def _stamp():
    return F.lit(PROCESSED).cast("timestamp")


# Cleaning and projections ---------------------------------------------------------------


@query
def clean_strip(spark, sf):
    return clean.strip_strings(B.raw_customers(spark, sf))


@query
def clean_lenient_numeric(spark, sf):
    raw = B.raw_customers(spark, sf)
    return raw.select(
        C.strip(F.col("customerID")).alias("customerID"),
        C.lenient_double(F.col("TotalCharges")).alias("TotalCharges"),
    )


@query
def clean_yes_no(spark, sf):
    raw = B.raw_customers(spark, sf)
    return raw.select(
        C.strip(F.col("customerID")).alias("customerID"),
        C.yes_no(F.col("PaperlessBilling")).alias("PaperlessBilling"),
        C.yes_no(F.col("Churn")).alias("churn"),
    )


@query
def clean_table(spark, sf):
    return clean.clean(B.raw_customers(spark, sf), B.CUSTOMERS, on_error="flag")


@query
def null_profile(spark, sf):
    flagged = clean.clean(B.raw_customers(spark, sf), B.CUSTOMERS, on_error="flag")
    return quality.null_profile(flagged.drop(clean.ERROR))


@query
def quality_report(spark, sf):
    flagged = clean.clean(B.raw_customers(spark, sf), B.CUSTOMERS, on_error="flag")
    return quality.quality_report(flagged.drop(clean.ERROR), B.CUSTOMERS)


@query
def range_rules(spark, sf):
    shifted = B.customers(spark, sf).withColumn("tenure", F.col("tenure") - 1500)
    shifted = shifted.withColumn("threshold", F.col("MonthlyCharges") / 200000.0)
    broken = quality.range_rules(shifted, B.CUSTOMERS, "threshold")
    return broken.select("customerID", F.array_join("broken_rules", ",").alias("broken_rules"))


@query
def feature_projection(spark, sf):
    return clean.project_features(B.customers(spark, sf), B.CUSTOMERS)


@query
def fill_missing_columns(spark, sf):
    partial = B.customers(spark, sf).drop("TotalCharges", "SeniorCitizen", "Region")
    return clean.scoring_input(partial, B.CUSTOMERS)


@query
def score_records(spark, sf):
    """Records from CSV files of three headers in one folder: in order, reversed with a column more,
    and turned with three columns less; scored with the defaults for what a file lacks."""
    folder = fresh_dir(spark, "records")
    names = [f.name for f in B.CUSTOMERS.clean_schema().fields if f.name != B.CUSTOMERS.target]
    rows = B.customers(spark, sf).withColumn("extra", F.lit("x,\"y\""))
    layouts = (names, ["extra", *reversed(names)], [n for n in names[3:] + names[:3] if n not in B.OPTIONAL])
    part = F.col("customerID").cast("bigint") % len(layouts)
    for i, layout in enumerate(layouts):
        rows.where(part == i).select(*layout).write.mode("append").option("header", True).csv(folder)
    defaults = clean.column_defaults(B.CUSTOMERS)
    records = tables.read_records(spark, folder, B.CUSTOMERS.clean_schema(), "csv", defaults)
    scored = B.score_from_profile(clean.scoring_input(records, B.CUSTOMERS))
    return scored.select(
        *names, C.threshold_label(F.col("probability")).alias("label"),
        C.round_half_even(F.col("probability"), 4).alias("churn_probability"),
    )


@query
def normalize_ground_truth(spark, sf):
    raw = B.raw_customers(spark, sf)
    word = C.strip(F.col("PaperlessBilling"))
    return raw.select(
        C.strip(F.col("customerID")).alias("customerID"),
        C.ground_truth(word).alias("label"),
        C.ground_truth_int(word).alias("label_int"),
    )


@query
def threshold_label(spark, sf):
    p = B.predictions(spark, sf)
    # A request may bring its own threshold; otherwise the default counts.
    asked = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 10 / 10.0)
    used = F.coalesce(asked, F.lit(0.5))
    score = F.col("churn_probability") / 3.0
    return p.select(
        "event_id",
        C.round_half_even(score, 4).alias("churn_probability"),
        used.alias("threshold"),
        C.threshold_label(score, used).alias("prediction"),
    )


@query
def parse_timestamps(spark, sf):
    e = B.table(spark, sf, "events")
    i = F.col("event_id")
    text = (
        F.when(i % 5 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"))
        .when(i % 5 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(i % 5 == 3, F.lit("yesterday"))
        .when(i % 5 == 4, F.date_format("ts", "yyyy"))
        .otherwise(C.iso_second(F.col("ts")))
    )
    return e.select("event_id", C.iso_second(C.parse_timestamp(text)).alias("parsed"))


def _messages(spark, sf):
    return _messages_from(B.table(spark, sf, "events"))


def _messages_from(e):
    """Prediction messages with both spellings of the alternate keys, and unusable rows."""
    p = B.as_predictions(e)
    i = F.col("event_id")
    return p.select(
        "event_id",
        F.when(i % 2 == 0, F.col("customer_id")).alias("customerID"),
        F.when((i % 2 == 1) & (i % 41 != 0), F.col("customer_id")).alias("customer_id"),
        F.when(i % 43 != 0, F.format_string("%.4f", "churn_probability")).alias("churn_probability"),
        "prediction",
        F.when(i % 4 == 0, "Yes").when(i % 4 == 1, "0").when(i % 4 == 2, "Maybe").alias("actual_churn"),
        F.when(i % 10 != 0, C.iso_second(F.col("processed_ts"))).alias("processed_ts"),
        F.when(i % 3 == 0, F.col("contract")).alias("Contract"),
    )


@query
def message_to_row(spark, sf):
    messages = _messages(spark, sf)
    typed = merge.message_to_row(messages)
    return typed.select(
        "event_id",
        "row.customer_id",
        "row.churn_probability",
        "row.actual_churn",
        C.iso_second(F.col("row.processed_ts")).alias("processed_ts"),
        "row.contract",
        "row_error",
    )


@query
def risk_band(spark, sf):
    p = B.predictions(spark, sf)
    score = F.when(F.col("event_id") % 50 != 0, F.col("churn_probability"))
    return p.groupBy(C.risk_band(score).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query
def segment_filter(spark, sf):
    chosen = views.segment_filter(B.predictions(spark, sf), "contract", ["click", "view"])
    return chosen.select("event_id", "contract")


@query
def encode_events(spark, sf):
    p = B.predictions(spark, sf)
    odd = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.lit(0.5))
    rows = p.select("customer_id", F.col("contract"), F.col("actual_churn"), odd.alias("p"), "event_id")
    return events.encode(rows, "customer_id", F.lit(PROCESSED))


def _routed(spark, sf):
    return events.route(
        B.raw_events(spark, sf), B.CUSTOMERS, B.score_from_charges, processed_ts=_stamp()
    )


@query
def route_events(spark, sf):
    return _routed(spark, sf).select(
        "event_id",
        "event_key",
        C.round_half_even(F.col("probability"), 4).alias("churn_probability"),
        "prediction",
        "actual",
        "error",
    )


@query
def dead_letters(spark, sf):
    letters = events.dead_letters(_routed(spark, sf), keep=("event_id",))
    return letters.select("event_id", "key", "error", "failed_ts")


@query
def stream_counters(spark, sf):
    batch = F.floor(F.col("event_id") / 1000).alias("batch")
    return events.counters(_routed(spark, sf).withColumn("batch", batch), ("batch",))


@query
def resume_publish(spark, sf):
    p = B.predictions(spark, sf)
    done, _ = B.windows(spark, sf)
    rows = p.select("event_id", "customer_id", "contract")
    pending = tables.after_position(rows, "event_id", done)
    return events.encode(pending, "customer_id", F.lit(PROCESSED))


# Splits ---------------------------------------------------------------------------------


@query
def stratified_split(spark, sf):
    return split.hash_split(B.customers(spark, sf), "customerID").select("customerID", "split")


@query
def stratified_split_exact(spark, sf):
    return split.stratified_split(B.customers(spark, sf), "customerID", "churn").select(
        "customerID", "churn", "split"
    )


@query
def split_stats(spark, sf):
    return split.split_stats(split.hash_split(B.customers(spark, sf), "customerID"), "churn")


@query
def split_overlap(spark, sf):
    p = split.hash_split(B.predictions(spark, sf), "customer_id")
    return split.split_overlap(p, "customer_id")


@query
def sample_fraction(spark, sf):
    return split.sample_fraction(B.customers(spark, sf), 0.1, key="customerID").select("customerID", "churn")


@query
def class_weights(spark, sf):
    return split.class_weights(B.customers(spark, sf), "churn").select(
        "churn", "n", F.round("weight", 6).alias("weight")
    )


# Metrics --------------------------------------------------------------------------------


@query
def confusion_matrix(spark, sf):
    s = B.scored_labels(spark, sf)
    return metrics.confusion(s, F.col("y"), F.col("predicted"))


@query
def classification_metrics(spark, sf):
    s = B.scored_labels(spark, sf)
    out = metrics.classification_metrics(s, F.col("y"), F.col("predicted"))
    return out.select(*[F.round(c, 6).alias(c) for c in metrics.METRICS])


@query
def roc_auc(spark, sf):
    s = B.scored_labels(spark, sf)
    return metrics.roc_auc(s, F.col("y"), F.col("p")).select(F.round("roc_auc", 6).alias("roc_auc"))


@query
def roc_auc_events(spark, sf):
    p = B.predictions(spark, sf)
    out = metrics.roc_auc(p, F.col("actual_churn"), F.col("churn_probability"))
    return out.select(F.round("roc_auc", 6).alias("roc_auc"))


@query
def average_precision(spark, sf):
    s = B.scored_labels(spark, sf)
    out = metrics.pr_auc(s, F.col("y"), F.col("p"))
    return out.select(F.round("pr_auc", 6).alias("average_precision"))


@query
def pr_auc_trapezoid(spark, sf):
    s = B.scored_labels(spark, sf)
    out = metrics.pr_auc(s, F.col("y"), F.col("p"), method="trapezoid")
    return out.select(F.round("pr_auc", 6).alias("pr_auc"))


@query
def roc_curve(spark, sf):
    points = metrics.roc_curve(B.scored_labels(spark, sf), F.col("y"), F.col("p"))
    return points.select(*[F.round(c, 6).alias(c) for c in points.columns])


@query
def pr_curve(spark, sf):
    points = metrics.pr_curve(B.scored_labels(spark, sf), F.col("y"), F.col("p"))
    return points.select(*[F.round(c, 6).alias(c) for c in points.columns])


@query
def performance_report(spark, sf):
    report = metrics.performance_report(B.predictions(spark, sf), baseline_roc_auc=0.80)
    rounded = {c: F.round(c, 6) for c in (*metrics.METRICS, "roc_auc")}
    return _text(report.withColumns(rounded), "window_start", "window_end").drop(
        "reason", "model_version"
    )


@query
def performance_rows(spark, sf):
    report = metrics.performance_report(B.predictions(spark, sf))
    rows = metrics.performance_rows(report)
    return rows.select("metric_name", F.round("metric_value", 6).alias("metric_value"), "sample_size")


@query
def quality_gate(spark, sf):
    return metrics.quality_gate(B.metric_history(spark, sf), MINIMUMS)


# Drift ----------------------------------------------------------------------------------


@query
def drift_numeric_psi(spark, sf):
    psi = drift.numeric_psi(*B.windows(spark, sf), NUMERIC)
    banded = drift.with_band(psi)
    return banded.select("feature", F.round("psi", 6).alias("psi"), "psi_band", "n_reference", "n_current")


@query
def drift_sketched_psi(spark, sf):
    """PSI from daily sketches, merged by window, beside the exact one: is it within its own error?"""
    log = B.predictions(spark, sf).withColumn("day", F.to_date("processed_ts"))
    days = sketches.daily(log, NUMERIC, ["day", "model_version"])
    cut = F.lit(B.CURRENT_FROM).cast("date")
    found = sketches.psi(days.where(F.col("day") < cut), days.where(F.col("day") >= cut))
    exact = drift.numeric_psi(*B.windows(spark, sf), NUMERIC).select("feature", F.col("psi").alias("exact"))
    near = F.abs(F.col("psi") - F.col("exact")) <= F.col("psi_error")
    return found.join(exact, "feature").select(
        "feature", "n_reference", "n_current", F.round("exact", 6).alias("exact_psi"), near.alias("within_error")
    )


@query
def drift_categorical_psi(spark, sf):
    psi = drift.categorical_psi(*B.windows(spark, sf), ["contract", "model_version"])
    return psi.select("feature", F.round("psi", 6).alias("psi"))


@query
def drift_ks(spark, sf):
    out = drift.ks_test(*B.windows(spark, sf), NUMERIC)
    return out.select("feature", F.round("ks_d", 6).alias("ks_d"), "n_reference", "n_current")


@query
def drift_ks_p(spark, sf):
    out = drift.ks_test(*B.windows(spark, sf), NUMERIC)
    return out.select("feature", F.round("p_value", 6).alias("p_value"))


@query
def drift_chi_square(spark, sf):
    out = drift.chi_square(*B.windows(spark, sf), ["contract", "model_version"])
    return out.select(
        "feature", F.round("chi_square", 6).alias("chi_square"), "dof", F.round("p_value", 6).alias("p_value")
    )


_SHOWN = ("feature_name", "drift_type", "statistic_name", "statistic_value", "threshold", "is_drifted")


@query
def prediction_drift(spark, sf):
    rows = drift.prediction_drift(*B.windows(spark, sf))
    return rows.select(*_SHOWN, F.round("p_value", 6).alias("p_value"), "current_window")


@query
def data_drift(spark, sf):
    rows = drift.data_drift(*B.windows(spark, sf), ["churn_probability"], ["contract", "model_version"])
    return rows.select(*_SHOWN, F.round("p_value", 6).alias("p_value"))


@query
def drift_report(spark, sf):
    reference, current = B.windows(spark, sf)
    rows = drift.prediction_drift(reference, current).unionByName(
        drift.data_drift(reference, current, ["churn_probability"], ["contract", "model_version"])
    )
    return rows.groupBy("drift_type", "statistic_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_drifted").alias("n_drifted")
    )


@query
def drift_matrix(spark, sf):
    return views.drift_matrix(B.drift_metrics(spark, sf))


@query
def latest_drift(spark, sf):
    m = B.drift_metrics(spark, sf).withColumn("feature_name", F.coalesce("feature_name", F.lit("")))
    return views.recent(m, 20, "computed_at", ("feature_name", "statistic_name"))


@query
def latest_performance(spark, sf):
    return views.newest_set(B.metric_history(spark, sf))


@query
def alert_rules(spark, sf):
    return alerts.evaluate(
        B.drift_metrics(spark, sf),
        B.performance_reports(spark, sf),
        B.daily_volume(spark, sf),
        ALERTS,
        keep=("computed_at",),
    ).withColumn("metric_value", F.round("metric_value", 6))


@query
def active_alerts(spark, sf):
    fired = alert_rules(spark, sf).withColumnRenamed("computed_at", "fired_at")
    marked = fired.withColumn("acknowledged", F.col("severity") == "info")
    return views.active_alerts(marked, 50, tiebreak=("message",))


@query
def latest_run(spark, sf):
    volume = B.daily_volume(spark, sf)
    day = B.drift_metrics(spark, sf).groupBy("computed_at").agg(
        F.bool_or("is_drifted").alias("drift_detected")
    )
    runs = volume.join(day, "computed_at").withColumn("status", F.lit("ok"))
    return views.latest_run(runs, "computed_at")


# Views over the prediction log ----------------------------------------------------------


@query
def batch_summary(spark, sf):
    return views.routed_summary(_routed(spark, sf))


@query
def segment_rate_events(spark, sf):
    return views.segment_rate_events(B.predictions(spark, sf))


@query
def churn_rate_by_segment(spark, sf):
    return views.churn_rate_by_segment(B.predictions(spark, sf), tiebreak=B.TIEBREAK)


@query
def prediction_volume(spark, sf):
    return views.volume(B.predictions(spark, sf))


@query
def prediction_volume_daily(spark, sf):
    return views.volume(B.predictions(spark, sf), "day")


@query
def prediction_count(spark, sf):
    return views.row_count(B.predictions(spark, sf))


@query
def overview_kpis(spark, sf):
    kpis = views.overview_kpis(B.predictions(spark, sf), window=40, tiebreak=B.TIEBREAK)
    return kpis.select(*[F.round(c, 6).alias(c) if "total" not in c and "count" not in c else c for c in kpis.columns])


@query
def score_batch_summary(spark, sf):
    return views.score_batch_summary(B.predictions(spark, sf))


@query
def probability_histogram(spark, sf):
    h = views.probability_histogram(B.predictions(spark, sf))
    return h.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@query
def current_model_version(spark, sf):
    return views.current_model_version(B.predictions(spark, sf), tiebreak=B.TIEBREAK)


@query
def latest_per_customer(spark, sf):
    latest = views.latest_per_key(B.predictions(spark, sf), "customer_id", tiebreak=B.TIEBREAK)
    return latest.select("customer_id", "event_id", "churn_probability", "prediction")


@query
def topk_events(spark, sf):
    top = views.top_events(B.predictions(spark, sf), 10, arrival=B.TIEBREAK)
    return top.select("event_id", "customer_id", "churn_probability", "prediction")


@query
def topk_customers(spark, sf):
    top = views.top_customers(
        B.predictions(spark, sf), 10, tiebreak=B.TIEBREAK, where=F.col("contract").isin("click", "view", "error")
    )
    return top.select("customer_id", "churn_probability", "contract", "risk")


@query
def recent_predictions(spark, sf):
    rows = views.recent(B.predictions(spark, sf), 200, tiebreak=B.TIEBREAK)
    return _text(rows, "processed_ts").select("event_id", "customer_id", "churn_probability", "processed_ts")


# Merge, registry, benchmark ---------------------------------------------------------------


@query
def upsert_new_rows(spark, sf):
    p = B.predictions(spark, sf)
    # Second resolution of an hour makes keys collide inside the batch; some have no time.
    hour = F.when(F.col("event_id") % 25 != 0, F.date_trunc("hour", "processed_ts"))
    p = p.withColumn("processed_ts", hour)
    stored, _ = B.windows(spark, sf)
    stored = stored.withColumn("processed_ts", hour).dropDuplicates(["customer_id", "processed_ts"])
    new = merge.new_rows(p, stored, ["event_id"])
    return new.select("event_id", "customer_id", C.iso_second(F.col("processed_ts")).alias("processed_ts"))


@query
def backfill_segment(spark, sf):
    p = B.predictions(spark, sf)
    log = p.withColumn("contract", F.when(F.col("event_id") % 4 == 0, F.col("contract")))
    _, raw = B.windows(spark, sf)
    out = merge.backfill(log, raw, arrival=["event_id"])
    return out.select("event_id", "customer_id", "contract")


@query
def champion_selection(spark, sf):
    table = registry.version_table(*B.versions(spark, sf))
    return registry.champion(table)


@query
def benchmark_pivot(spark, sf):
    o = B.table(spark, sf, "orders")
    rows = o.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.round(F.avg("o_totalprice"), 2).alias("fit_s"), F.count(F.lit(1)).alias("n")
    )
    return views.pair_table(rows, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], ["fit_s", "n"])


# Features, training, scoring ----------------------------------------------------------------


@query
def standardize(spark, sf):
    return features.standardize(B.customers(spark, sf), B.CUSTOMERS)


@query
def features_fit(spark, sf):
    df = B.customers(spark, sf)
    model = features.feature_pipeline(B.CUSTOMERS).fit(df)
    return features.explode_vector(model.transform(df), "customerID")


def _split_customers(spark, sf):
    return split.hash_split(B.customers(spark, sf), "customerID")


@query
def train_eval(spark, sf):
    fitted = models.train(_split_customers(spark, sf), B.CUSTOMERS, "logistic_regression")
    return models.metric_rows(spark, fitted)


@query
def train_eval_random_forest(spark, sf):
    fitted = models.train(_split_customers(spark, sf), B.CUSTOMERS, "random_forest")
    return models.metric_rows(spark, fitted)


@query
def score_batch(spark, sf):
    df = _split_customers(spark, sf)
    fitted = models.train(df, B.CUSTOMERS, "logistic_regression", evaluate=())
    return models.score(df, B.CUSTOMERS, fitted.model, model_source="local", model_version="1")


@query
def feature_importance(spark, sf):
    df = _split_customers(spark, sf)
    fitted = models.train(df, B.CUSTOMERS, "logistic_regression", evaluate=())
    return models.feature_importance(spark, fitted.model, df, top=10)


@query
def monitoring_cycle(spark, sf):
    """What a cycle has published: its metric rows, its run row, and whether all alerts are there."""
    reference, current = B.windows(spark, sf)
    store = Store(spark, fresh_dir(spark, "cycle"))
    config = cycle.CycleConfig(numeric=("churn_probability",), categorical=("contract", "model_version"))
    cycle.run_cycle(
        spark, window=current, reference_scores=reference, raw_window=current, reference=reference,
        config=config, store=store,
    )
    none = F.lit(None)
    drifts = store.committed("drift_metrics").select(
        F.concat_ws("/", "drift_type", "statistic_name", "feature_name").alias("name"),
        F.round("statistic_value", 4).alias("value"), F.col("is_drifted").alias("flag"), none.cast("bigint").alias("n"),
    )
    measured = store.committed("performance_metrics").select(
        F.concat(F.lit("performance/"), "metric_name").alias("name"),
        F.round("metric_value", 4).alias("value"), none.cast("boolean").alias("flag"), F.col("sample_size").alias("n"),
    )
    alerted = store.committed("alerts").select(F.count(F.lit(1)).alias("there")).scalar()
    run = store.committed("monitoring_runs").select(
        F.concat(F.lit("run/"), "status").alias("name"), none.cast("double").alias("value"),
        ((F.col("alerts_fired") == alerted) & F.col("drift_detected")).alias("flag"), F.col("records_processed").alias("n"),
    )
    return drifts.union(measured).union(run)


# Streaming -------------------------------------------------------------------------------


def _scored_stream(spark, sf):
    source = B.as_messages(B.event_stream(spark, sf))
    return flows.run_score_table(
        spark, source, B.CUSTOMERS, B.score_from_charges, processed_ts=_stamp()
    )


@query
def stream_route_events(spark, sf):
    run = _scored_stream(spark, sf)
    return run["predictions"].select(
        "customerID", "churn_probability", "prediction", "event_ts", "processed_ts", "actual_churn", "Contract"
    )


#: Records of a topic file, about: the topic gets more files as it grows, not larger ones.
TOPIC_RECORDS_PER_FILE = 250_000


def write_topic(messages: DataFrame, path: str) -> None:
    """The messages as JSON-lines files by key, two at least, each about TOPIC_RECORDS_PER_FILE
    records at most, so that no task writes a share of the whole topic."""
    files = max(2, -(-messages.count() // TOPIC_RECORDS_PER_FILE))
    messages.repartition(files, "key").write.json(path)


@query
def consume_records(spark, sf):
    """The messages as topic files, consumed in windows that end inside files; whether every record
    has come from one place of its own."""
    out = fresh_dir(spark, "consume")
    messages = B.raw_events(spark, sf).select("key", "value")
    write_topic(messages, f"{out}/topic")
    topic = records.Topic(spark, f"{out}/topic", f"{out}/position")
    third = spark.read.text(f"{out}/topic").count() // 3 + 1
    while flows.score_records(topic, B.CUSTOMERS, B.score_from_charges, f"{out}/t", max_records=third, processed_ts=_stamp()):
        pass
    place = F.struct("partition", "offset")
    parts = []
    for name in ("predictions", "dead_letters"):
        rows = flows.read_output(spark, f"{out}/t", name)
        parts.append(rows.select(F.lit(name).alias("table"), "batch_id", F.col("error" if name == "dead_letters" else "prediction").alias("outcome"), place.alias("place")))
    whole = parts[0].union(parts[1])
    return whole.groupBy("table", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("n_places")
    )


@query
def stream_observed(spark, sf):
    """Counters of the scored stream, observed while its batches were written."""
    counted = _scored_stream(spark, sf)["counters"]
    return counted.agg(*[F.sum(c).alias(c) for c in ("consumed", "predicted", "dead_lettered")])


@query
def stream_distinct(spark, sf):
    """Of a user's events of one type that follow each other within six hours, the first by position."""
    out = fresh_dir(spark, "distinct")
    source = B.event_stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    flows.distinct_stream(
        source, ["user_id", "event_type"], "ts", "6 hours", f"{out}/t", f"{out}/_checkpoint", place=["event_id"]
    ).awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{out}/t").select("event_id", "user_id", "event_type")


@query
def ordered_topic(spark, sf):
    """Events by user as topic files of equal size; how many of a user's come before an earlier one."""
    out = fresh_dir(spark, "ordered")
    rows = B.table(spark, sf, "events").select("event_id", "user_id").repartition(8, "event_id")
    sinks.write_ordered(rows, "user_id", ["event_id"], F.col("event_id").cast("string"), f"{out}/topic", 8)
    read = records.Topic(spark, f"{out}/topic", f"{out}/position").next().rows
    read = read.select("key", "partition", "offset", F.col("value").cast("bigint").alias("event_id"))
    earlier = F.lag("event_id").over(Window.partitionBy("partition", "key").orderBy("offset")) > F.col("event_id")
    files = read.withColumn("wrong", earlier).groupBy("key", "partition").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("wrong"),
        F.min("event_id").alias("low"), F.max("event_id").alias("high"),
    )
    # A user's files are few: their rows are a file and key each.
    across = F.lag("high").over(Window.partitionBy("key").orderBy("partition")) > F.col("low")
    return files.withColumn("across", across).groupBy("key").agg(
        F.sum("n").alias("n"), (F.sum("wrong") + F.count_if("across")).alias("n_out_of_order")
    )


@query
def external_scores(spark, sf):
    """Events scored by a numpy model that each worker loads once, with its lineage."""

    def load():
        import numpy as np

        weights = np.array([0.03, -0.02])
        return lambda cells: 1.0 / (1.0 + np.exp(-(np.nan_to_num(cells) @ weights)))

    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = B.table(spark, sf, "events").select("event_id", "value", F.when(k % 7 != 0, k).alias("k"))
    scored = models.external_scorer(load, ("value", "k"), "numpy", "1")(rows)
    return scored.select("event_id", F.round("probability", 6).alias("probability"), "model_source", "model_version")


@query
def stream_dead_letters(spark, sf):
    run = _scored_stream(spark, sf)
    return run["dead_letters"].groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_ingest(spark, sf):
    """The log after the message stream was read, and then read again from the start."""
    out = fresh_dir(spark, "ingest")
    log = Store(spark, f"{out}/log")
    for attempt in ("first", "again"):
        messages = _messages_from(B.event_stream(spark, sf))
        keyed = messages.select(F.to_json(F.struct(*messages.columns)).alias("value"))
        flows.ingest_stream(keyed, log, f"{out}/{attempt}", f"{out}/quarantine-{attempt}").awaitTermination()
    stored = log.read("predictions")
    return stored.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("processed_ts").isNull()).alias("n_no_time"),
        F.round(F.sum("churn_probability"), 4).alias("sum_probability"),
    )


@query
def stream_publish(spark, sf):
    out = fresh_dir(spark, "publish")
    rows = B.event_stream(spark, sf).select("event_id", "user_id", "event_type", F.lit(PROCESSED).alias("sent"))
    sink = flows.Endpoint("json", f"{out}/topic")
    flows.publish_stream(rows, "user_id", sink, f"{out}/_checkpoint").awaitTermination()
    sent = spark.read.schema(flows.KEYED).json(f"{out}/topic")
    return sent.select("key", F.regexp_replace("value", ',"event_ts".*', "}").alias("value"))


@query
def stream_volume(spark, sf):
    out = fresh_dir(spark, "volume")
    source = B.event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"))
    flows.volume_stream(source, "ts", f"{out}/t", f"{out}/_checkpoint", complete=True).awaitTermination()
    hours = spark.read.parquet(f"{out}/t/batch_id=all")
    return hours.select(C.iso_second(F.col("start")).alias("start"), "count")


@query
def stream_volume_closed(spark, sf):
    """Hours that the watermark has closed, as their state is let go."""
    out = fresh_dir(spark, "volume")
    source = B.event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"))
    flows.volume_stream(source, "ts", f"{out}/t", f"{out}/_checkpoint").awaitTermination()
    hours = spark.read.parquet(f"{out}/t")
    return hours.select(C.iso_second(F.col("start")).alias("start"), "count")


@query
def stream_late_rows(spark, sf):
    """The events in three portions, one after the other: rows that come after their hour has closed
    go to a table of their own, and the counts of the closed hours hold all others."""
    out = fresh_dir(spark, "late")
    rows = B.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for portion in range(3):
        rows.where(F.col("event_id") % 3 == portion).write.mode("append").parquet(f"{out}/source")
        source = spark.readStream.schema(rows.schema).parquet(f"{out}/source")
        flows.split_late(source, "ts", f"{out}/split", f"{out}/_split").awaitTermination()
        on_time = spark.readStream.schema(rows.schema).parquet(f"{out}/split/on_time")
        flows.volume_stream(on_time, "ts", f"{out}/volume", f"{out}/_volume").awaitTermination()
    late = spark.read.schema(rows.schema).parquet(f"{out}/split/late")
    hours = spark.read.parquet(f"{out}/volume").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("hours"))
    by_portion = late.groupBy(F.concat(F.lit("late "), F.col("event_id") % 3).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return by_portion.union(hours.select(F.concat(F.lit("closed hours "), "hours"), "n"))
