"""Command line jobs, for spark-submit or `python -m scoreline.plans.jobs <job> ...`.

The session comes from the launcher; nothing here sets masters, partitions or memory.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.operators import clean, models, quality, registry, split, views
from scoreline.plans.cycle import CycleConfig, run_cycle
from scoreline.session import fresh_dir
from scoreline.sources import records, sinks, tables
from scoreline.sources.store import Store
from scoreline.spec import TELCO
from scoreline.streaming import events, flows

JSON_SOURCE = "json files, or kafka with --option kafka.bootstrap.servers=... --option subscribe=..."


def _endpoint(fmt: str, path: str | None, options: list[str]) -> flows.Endpoint:
    return flows.Endpoint(fmt, path, dict(o.split("=", 1) for o in options))


def build_dataset(spark: SparkSession, a) -> None:
    """Raw CSV to validated, split parquet."""
    cleaned = clean.clean(tables.read_raw_csv(spark, a.input, TELCO), TELCO)
    quality.assert_valid(cleaned, TELCO)
    ratios = (a.train, a.val, a.test)
    if a.exact:
        parted = split.stratified_split(cleaned, TELCO.id, TELCO.target, ratios, a.seed)
    else:
        parted = split.hash_split(cleaned, TELCO.id, ratios, a.seed)
    sinks.write_splits(parted, a.output)
    split.split_stats(spark.read.parquet(a.output), TELCO.target).show(truncate=False)


def train(spark: SparkSession, a) -> None:
    """Fit, evaluate, save and register a classifier."""
    fitted = models.train(spark.read.parquet(a.input), TELCO, a.model, seed=a.seed)
    models.save(fitted.model, a.output)
    if a.store:
        models.register(Store(spark, a.store), fitted, a.output, a.version, a.run_id or str(a.version))
    print(json.dumps(fitted.metrics, indent=2))


def benchmark(spark: SparkSession, a) -> None:
    """Fit and inference time and quality of all classifiers."""
    rows = models.compare(spark.read.parquet(a.input), TELCO, list(models.ESTIMATORS))
    table = spark.createDataFrame(rows)
    sinks.write_table_csv(table, a.output)
    table.show(truncate=False)


def predict(spark: SparkSession, a) -> None:
    """Score a file of cleaned records to CSV."""
    records = tables.read_records(spark, a.input, TELCO.clean_schema(), a.format, clean.column_defaults(TELCO))
    scored = models.score(records, TELCO, models.load(a.model), threshold=a.threshold)
    sinks.write_predictions_csv(scored, a.output, TELCO)
    views.score_batch_summary(scored.withColumn("prediction", F.col("label"))).show()


def publish(spark: SparkSession, a) -> None:
    """A raw CSV folder as keyed JSON events, resumable by its checkpoint."""
    sink = _endpoint(a.sink, a.output, a.option)
    flows.publish_csv(
        spark, a.input, TELCO, sink, a.checkpoint, files_per_batch=a.files_per_batch, dry_run=a.dry_run
    ).awaitTermination()


def consume(spark: SparkSession, a) -> None:
    """Score events: all available ones with a report, continuously, or a bounded number of records."""
    scorer = models.as_scorer(models.load(a.model))
    checkpoint = fresh_dir(spark, "dry-run") if a.dry_run else a.checkpoint
    if a.max_records:
        topic = records.Topic(spark, a.input, checkpoint)
        n = flows.score_records(
            topic, TELCO, scorer, a.output, max_records=a.max_records, threshold=a.threshold,
            include_ground_truth=not a.no_ground_truth, dry_run=a.dry_run,
        )
        print(f"{n} records")
        return
    source = flows.read_events(spark, _endpoint(a.source, a.input, a.option), a.per_batch)
    trigger = {"processingTime": a.every} if a.every else None
    query = flows.score_stream(
        source, TELCO, scorer, a.output, checkpoint,
        threshold=a.threshold, include_ground_truth=not a.no_ground_truth, trigger=trigger, dry_run=a.dry_run,
    )
    query.awaitTermination()
    if a.dry_run or a.every:
        return
    scored = flows.read_output(spark, a.output, "predictions")
    dead = flows.read_output(spark, a.output, "dead_letters")
    document = sinks.summary_document(
        views.batch_summary(scored, dead),
        views.segment_rate_events(scored, TELCO.segment),
        views.top_events(scored, a.top_k, arrival=[TELCO.id]).select(TELCO.id, "churn_probability", "prediction"),
        TELCO.segment,
    )
    sinks.write_report(spark, document, f"{a.output}/report")
    print(sinks.summary_markdown(document))


def ingest(spark: SparkSession, a) -> None:
    """Prediction messages into the log, each (customer, time) once."""
    if a.max_records:
        topic = records.Topic(spark, a.input, a.checkpoint)
        print(f"{flows.ingest_records(topic, Store(spark, a.store), f'{a.store}/_quarantine', a.max_records)} records")
        return
    source = flows.read_events(spark, _endpoint(a.source, a.input, a.option), a.per_batch)
    flows.ingest_stream(source, Store(spark, a.store), a.checkpoint, f"{a.store}/_quarantine").awaitTermination()


def monitor(spark: SparkSession, a) -> None:
    """One monitoring cycle over the newest predictions of the log."""
    store = Store(spark, a.store)
    window = views.recent(store.read("predictions"), a.window, tiebreak=["customer_id"])
    reference = tables.read_split(spark, a.reference, "train")
    model = models.load(a.model) if a.model else None
    raw: DataFrame | None = None
    segments: DataFrame | None = None
    if a.raw_events:
        raw, _ = events.feature_rows(spark.read.schema(flows.KEYED).json(a.raw_events), TELCO)
        segments = raw.select(F.col(TELCO.id).alias("customer_id"), F.col(TELCO.segment).alias("contract"))
    scores: DataFrame | None = None
    if model and a.model_version:  # scored once for each version
        scores = store.kept(f"reference_scores/{a.model_version}", lambda: models.reference_scores(reference, TELCO, model))
    elif model:
        scores = models.reference_scores(reference, TELCO, model)
    result = run_cycle(
        spark,
        window=window,
        reference_scores=scores,
        raw_window=raw,
        segments=segments,
        model_version=a.model_version,
        reference=reference,
        config=CycleConfig(retrain_enabled=a.retrain),
        store=store,
        dry_run=a.dry_run,
    )
    for part in (result.run, result.drift, result.performance, result.alerts):
        part.show(truncate=False)


def promote(spark: SparkSession, a) -> None:
    """Which registered version should be in production."""
    rows = Store(spark, a.store).read("model_versions")
    chosen = rows.where((F.col("split") == a.split) & (F.col("metric_name") == a.metric))
    history = chosen.select("run_id", F.col("saved_at").alias("step"), F.col("metric_value").alias("value"))
    current = spark.createDataFrame([("production", v) for v in a.current], "alias string, version bigint")
    versions = rows.select("version", "run_id").distinct()
    registry.champion(registry.version_table(versions, history, current), force=a.force).show(truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scoreline")
    jobs = top.add_subparsers(required=True)

    def job(f, *required: str) -> argparse.ArgumentParser:
        p = jobs.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        p.set_defaults(run=f)
        for name in required:
            p.add_argument(f"--{name}", required=True)
        return p

    p = job(build_dataset, "input", "output")
    p.add_argument("--train", type=float, default=0.70)
    p.add_argument("--val", type=float, default=0.15)
    p.add_argument("--test", type=float, default=0.15)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--exact", action="store_true", help="exact class shares instead of expected ones")

    p = job(train, "input", "output")
    p.add_argument("--model", default="logistic_regression", choices=list(models.ESTIMATORS))
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--store")
    p.add_argument("--version", type=int, default=1)
    p.add_argument("--run-id")

    job(benchmark, "input", "output")

    p = job(predict, "input", "output", "model")
    p.add_argument("--format", choices=["csv", "json", "parquet"])
    p.add_argument("--threshold", type=float, default=0.5)

    p = job(publish, "input", "checkpoint")
    p.add_argument("--output")
    p.add_argument("--sink", default="json")
    p.add_argument("--option", action="append", default=[])
    p.add_argument("--files-per-batch", type=int, default=100)
    p.add_argument("--dry-run", action="store_true")

    p = job(consume, "output", "model", "checkpoint")
    p.add_argument("--input", help=JSON_SOURCE)
    p.add_argument("--source", default="json")
    p.add_argument("--option", action="append", default=[])
    p.add_argument("--per-batch", type=int)
    p.add_argument("--max-records", type=int, help="stop after exactly so many records of JSON files")
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--no-ground-truth", action="store_true")
    p.add_argument("--every", help="trigger interval of a continuous run, such as '10 seconds'")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--dry-run", action="store_true")

    p = job(ingest, "store", "checkpoint")
    p.add_argument("--input", help=JSON_SOURCE)
    p.add_argument("--source", default="json")
    p.add_argument("--option", action="append", default=[])
    p.add_argument("--per-batch", type=int)
    p.add_argument("--max-records", type=int, help="stop after exactly so many records of JSON files")

    p = job(monitor, "store", "reference")
    p.add_argument("--model")
    p.add_argument("--model-version", help="kept with the metrics; reference scores are made once for each")
    p.add_argument("--raw-events")
    p.add_argument("--window", type=int, help="newest rows only; default is the whole log")
    p.add_argument("--retrain", action="store_true")
    p.add_argument("--dry-run", action="store_true")

    p = job(promote, "store")
    p.add_argument("--current", type=int, action="append", default=[])
    p.add_argument("--split", default="test")
    p.add_argument("--metric", default="roc_auc")
    p.add_argument("--force", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    arguments = parser().parse_args(argv)
    arguments.run(SparkSession.builder.getOrCreate(), arguments)


if __name__ == "__main__":
    main()
