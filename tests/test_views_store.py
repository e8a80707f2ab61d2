from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scoreline.operators import merge, registry, views
from scoreline.operators import drift, metrics
from scoreline.plans.cycle import CycleConfig, run_cycle
from scoreline.sources.store import TABLES, Store

T0 = datetime(2024, 3, 1, 12, 0, 0)
SCHEMA = (
    "customer_id string, churn_probability double, prediction string, actual_churn bigint, event_ts timestamp, "
    "processed_ts timestamp, model_source string, model_version string, contract string, arrival bigint"
)


def log(spark, rows):
    """(customer, probability, minutes or None, contract)"""
    data = [
        (c, p, "Yes" if p >= 0.5 else "No", None, None, None if m is None else T0 + timedelta(minutes=m), "local", "v1", k, i)
        for i, (c, p, m, k) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_latest_per_key_and_rates(spark):
    df = log(spark, [("a", 0.95, 0, "M"), ("a", 0.90, 1, "M"), ("a", 0.85, 2, "M"), ("b", 0.9, 0, "M"), ("b", 0.1, 5, "M"),
                     ("c", 0.9, 0, ""), ("d", 0.2, None, None), ("d", 0.7, 0, None)])
    latest = {r.customer_id: r.churn_probability for r in views.latest_per_key(df, "customer_id").collect()}
    assert latest == {"a": 0.85, "b": 0.1, "c": 0.9, "d": 0.7}
    rates = {r.contract: (r.total, r.churn_rate_pct) for r in views.churn_rate_by_segment(df).collect()}
    assert rates == {"M": (2, 50.0), "Unknown": (2, 100.0)}
    segment = log(spark, [("a", 0.9, 0, "M"), ("b", 0.8, 0, "M"), ("c", 0.1, 0, "M"), ("d", 0.9, 0, "T")])
    assert {r.contract: r.churn_rate_pct for r in views.churn_rate_by_segment(segment).collect()} == {"M": 66.67, "T": 100.0}
    # The limit counts events, before one row per customer is kept.
    assert views.churn_rate_by_segment(df, limit=1).first().total == 1


def test_latest_per_key_limits_before_the_shuffle(spark):
    df = log(spark, [("a", 0.5, i, "M") for i in range(10)]).repartition(4)
    plan = views.latest_per_key(df, "customer_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_customers_filters_before_the_cut(spark):
    df = log(spark, [(c, p, 0, k) for c, p, k in [("a", 0.1, "M"), ("b", 0.9, "M"), ("c", 0.5, "T"), ("d", 0.7, "M"), ("e", 0.3, "T")]])
    assert [r.churn_probability for r in views.top_customers(df, 3).collect()] == [0.9, 0.7, 0.5]
    only = views.top_customers(df, 3, where=F.col("contract") == "T").collect()
    assert [(r.customer_id, r.risk) for r in only] == [("c", "medium"), ("e", "low")]
    assert [r.customer_id for r in views.top_events(df, 2, arrival=["arrival"]).collect()] == ["b", "d"]


def test_kpis(spark):
    df = log(spark, [(f"c{i}", p, i, "M") for i, p in enumerate([0.92, 0.81, 0.15, 0.55, 0.05])])
    one = views.overview_kpis(df, window=5).first()
    assert (one.total, one.high_risk_count, one.churn_rate_pct, one.delta_total) == (5, 2, 60.0, None)
    two = views.overview_kpis(df, window=3).first()
    assert (two.total, two.delta_total, two.high_risk_count, two.delta_high_risk_count) == (3, 1, 0, -2)
    empty = views.overview_kpis(df.limit(0)).first()
    assert (empty.total, empty.churn_rate_pct, empty.high_risk_count, empty.delta_total) == (0, None, None, None)


def test_summaries(spark):
    df = log(spark, [("A", 0.9, 0, "M"), ("B", 0.2, 0, "M"), ("C", 0.8, 0, "T")])
    one = views.batch_summary(df, df.limit(1)).first()
    assert (one.consumed, one.predicted, one.dead_lettered) == (4, 3, 1)
    assert (one.overall_churn_pct, one.mean_churn_probability) == (66.67, 0.6333)
    assert {r.contract: r.churn_rate_pct for r in views.segment_rate_events(df).collect()} == {"M": 50.0, "T": 100.0}
    none = views.batch_summary(df.limit(0)).first()
    assert (none.consumed, none.overall_churn_pct, none.mean_churn_probability) == (0, 0.0, 0.0)
    bars = views.probability_histogram(df).collect()
    assert len(bars) == 30 and sum(b["count"] for b in bars) == 3
    assert views.probability_histogram(df.limit(0)).count() == 30


def test_volume_and_versions(spark):
    df = log(spark, [("a", 0.1, 0, "M"), ("b", 0.1, 59, "M"), ("c", 0.1, 60, "M"), ("d", 0.1, None, "M")])
    assert {r.bucket: r["count"] for r in views.volume(df).collect()} == {"2024-03-01 12:00": 2, "2024-03-01 13:00": 1}
    assert {r.bucket: r["count"] for r in views.volume(df, "day").collect()} == {"2024-03-01": 3}
    assert views.current_model_version(df).first().asDict() == {"model_version": "v1", "source": "predictions"}
    assert views.current_model_version(df.limit(0)).first().source == "unknown"


def test_merge_rules(spark):
    empty = log(spark, [])
    batch = log(spark, [("a", 0.3, 0, "M"), ("a", 0.9, 0, "M"), ("b", 0.1, None, "M"), ("b", 0.2, None, "M")])
    new = {r.customer_id: r.churn_probability for r in merge.new_rows(batch, empty, ["arrival"]).collect()}
    assert new == {"a": 0.9, "b": 0.2}
    assert merge.new_rows(batch, batch, ["arrival"]).count() == 0


def test_backfill(spark):
    table = log(spark, [("a", 0.1, 0, None), ("a", 0.1, 1, "M"), ("b", 0.1, 0, None)])
    source = log(spark, [("a", 0.1, 0, "T"), ("a", 0.1, 0, "O"), ("a", 0.1, 0, None)])
    got = sorted((r.customer_id, r.arrival, r.contract) for r in merge.backfill(table, source, arrival=["arrival"]).collect())
    assert got == [("a", 0, "O"), ("a", 1, "M"), ("b", 2, None)]


def test_champion(spark):
    versions = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3")], "version bigint, run_id string")
    history = spark.createDataFrame([("r1", 0, 0.99), ("r1", 1, 0.82), ("r2", 0, 0.87)], "run_id string, step bigint, value double")

    def decide(production, **options):
        names = spark.createDataFrame(production, "alias string, version bigint")
        return registry.champion(registry.version_table(versions, history, names), **options).first()

    first = decide([])
    assert (first.best_version, first.new_production, first.new_staging, first.promote) == (2, 2, 3, True)
    better = decide([("production", 1), ("staging", 1)])
    assert better.promote and better.current_metric == 0.82
    same = decide([("production", 2)])
    assert not same.promote and same.new_production == 2 and same.new_staging is None
    assert decide([("production", 2)], force=True).promote
    assert decide([("production", 3)]).promote  # the current version has no metric


def test_store_merges_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.init()
    store.init()
    assert all(store.read(t).count() == 0 for t in TABLES)
    rows = log(spark, [("a", 0.3, 0, None), ("a", 0.9, 0, None), ("b", 0.1, None, None), ("c", 0.2, 60 * 24 * 40, None)])
    assert store.merge_predictions(rows, ["arrival"]) == 3
    assert store.merge_predictions(rows, ["arrival"]) == 0
    more = log(spark, [("a", 0.5, 0, "M"), ("d", 0.5, 0, "M")])
    assert store.merge_predictions(more, ["arrival"]) == 1
    assert store.merge_predictions(rows.limit(0), ["arrival"]) == 0
    source = log(spark, [("a", 0.1, 0, "One year")])
    assert store.backfill_predictions(source, ["arrival"]) == 1
    assert store.backfill_predictions(source, ["arrival"]) == 0
    stored = {r.customer_id: (r.churn_probability, r.contract) for r in store.read("predictions").collect()}
    assert stored == {"a": (0.9, "One year"), "b": (0.1, None), "c": (0.2, None), "d": (0.5, "M")}


def scored(spark, n, shift=0.0, labels=True):
    return spark.range(n).select(
        F.concat(F.lit("c"), "id").alias("customer_id"),
        F.least(F.lit(1.0), (F.col("id") % 97) / 100.0 + shift).alias("churn_probability"),
        F.when(F.col("id") % 97 >= 50, "Yes").otherwise("No").alias("prediction"),
        (F.when(F.col("id") % 97 >= 40, 1).otherwise(0) if labels else F.lit(None)).cast("bigint").alias("actual_churn"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("processed_ts"),
        F.when(F.col("id") % 2 == 0, "M").otherwise("T").alias("contract"),
    )


CONFIG = CycleConfig(numeric=("churn_probability",), categorical=("contract",), retrain_enabled=True)


def test_cycle_writes_and_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    shifted, reference = scored(spark, 400, 0.5), scored(spark, 1000)
    result = run_cycle(spark, window=shifted, reference_scores=reference, raw_window=shifted, reference=reference,
                       config=CONFIG, store=store, run_id="r1", run_ts=T0)
    run = result.run.first()
    assert (run.records_processed, run.drift_detected, run.retrain, run.status) == (400, True, True, "ok")
    assert not run.performance_degraded and run.alerts_fired == result.alerts.count() >= 2
    assert store.committed("drift_metrics").count() == 5
    assert store.committed("performance_metrics").count() == 5
    assert store.read("alerts").where("not acknowledged").count() == run.alerts_fired
    # Metrics of a cycle that was not published stay invisible.
    store.stage("unfinished", {"alerts": result.alerts.withColumn("run_id", F.lit("unfinished"))})
    assert store.committed("alerts").count() == store.read("alerts").count() == run.alerts_fired


def test_cycle_degrades_to_skipped(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    few = scored(spark, 3, labels=False)
    run = run_cycle(spark, window=few, reference_scores=None, config=CONFIG, store=store).run.first()
    assert (run.records_processed, run.drift_detected, run.alerts_fired) == (3, False, 1)
    assert "prediction_drift=skipped: no reference scores" in run.notes
    assert "performance=no labels" in run.notes
    empty = run_cycle(spark, window=few.limit(0), reference_scores=few, config=CONFIG, dry_run=True)
    assert empty.alerts.first().severity == "critical" and empty.run.first().records_processed == 0
    assert store.read("monitoring_runs").count() == 1
    broken = few.withColumn("churn_probability", F.raise_error(F.lit("boom")).cast("double"))
    step = run_cycle(spark, window=broken, reference_scores=scored(spark, 50), config=CONFIG, dry_run=True)
    assert "prediction_drift=failed" in step.run.first().notes and step.run.first().status == "partial"


def test_cycle_records_its_failure(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    bad = scored(spark, 3).where(F.raise_error(F.lit("boom")).isNull())
    with pytest.raises(Exception, match="boom"):
        run_cycle(spark, window=bad, reference_scores=None, config=CONFIG, store=store)
    assert store.read("monitoring_runs").first().status == "error"


STEPS = {
    "prediction_drift": (drift, "prediction_drift"),
    "data_drift": (drift, "data_drift"),
    "performance": (metrics, "performance_report"),
    "backfill": (Store, "backfill_predictions"),
}


def whole_cycle(spark, store, run_id="r"):
    window = scored(spark, 400, 0.5)
    segments = log(spark, [("c1", 0.1, 0, "One year"), ("c2", 0.1, 0, "Two year")])
    return run_cycle(spark, window=window, reference_scores=scored(spark, 500), raw_window=window, reference=scored(spark, 500),
                     config=CONFIG, store=store, run_id=run_id, segments=segments)


@pytest.mark.parametrize("step", list(STEPS))
def test_a_failing_step_makes_the_cycle_partial(spark, tmp_path, monkeypatch, step):
    def fail(*_, **__):
        raise RuntimeError(step)

    monkeypatch.setattr(*STEPS[step], fail)
    store = Store(spark, str(tmp_path / "store"))
    whole_cycle(spark, store)
    run = store.committed("monitoring_runs").first()
    assert (run.status, run.records_processed) == ("partial", 400) and f"{step}=failed: RuntimeError" in run.notes
    kinds = {r.drift_type for r in store.committed("drift_metrics").collect()}
    assert kinds == {"prediction", "data"} - {step.replace("_drift", "")}
    assert (store.committed("performance_metrics").count() == 0) == (step == "performance")
    assert store.committed("alerts").count() == run.alerts_fired


@pytest.mark.parametrize("at", ["drift_metrics", "performance_metrics", "alerts", "monitoring_runs", "publish"])
def test_a_failing_write_shows_no_half_of_a_cycle(spark, tmp_path, monkeypatch, at):
    store, failed = Store(spark, str(tmp_path / "store")), []
    stage, publish = Store.stage, Store.publish

    def staged(self, attempt, tables):
        for table, df in tables.items():
            if table == at and not failed:
                failed.append(table)
                raise OSError(f"no space for {table}")
            stage(self, attempt, {table: df})

    def published(self, *args):
        if at == "publish" and not failed:
            failed.append(at)
            raise OSError("no manifest")
        publish(self, *args)

    monkeypatch.setattr(Store, "stage", staged)
    monkeypatch.setattr(Store, "publish", published)
    with pytest.raises(OSError):
        whole_cycle(spark, store)
    assert failed == [at]
    for table in ("drift_metrics", "performance_metrics", "alerts"):
        assert store.committed(table).count() == store.read(table).count() == 0
    assert store.committed("monitoring_runs").count() == 0
    row = store.read("monitoring_runs").first()
    assert (row.status, row.records_processed, row.drift_detected) == ("error", 400, True)
    assert row.alerts_fired >= 2 and "cycle=stopped by OSError" in row.notes
    whole_cycle(spark, store, "again")  # the next one is not touched by what the failed one left
    assert [r.run_id for r in store.committed("monitoring_runs").collect()] == ["again"]
    assert {r.run_id for r in store.committed("alerts").collect()} == {"again"}


def test_a_store_that_cannot_be_written_raises_the_first_error(spark, tmp_path, monkeypatch):
    def fail(self, *_):
        raise OSError("read only")

    monkeypatch.setattr(Store, "stage", fail)
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(OSError, match="read only"):
        whole_cycle(spark, store)
    assert store.read("monitoring_runs").count() == 0


def test_a_cycle_fills_segments_of_the_log(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.merge_predictions(log(spark, [("c1", 0.3, 0, None), ("c1", 0.4, 60, None), ("c2", 0.3, 0, "M"), ("c9", 0.3, 0, None)]), ["arrival"])
    result = whole_cycle(spark, store)
    assert "backfill=2 rows" in result.run.first().notes
    rows = sorted((r.customer_id, r.contract) for r in store.read("predictions").collect())
    assert rows == [("c1", "One year"), ("c1", "One year"), ("c2", "M"), ("c9", None)]


def test_reference_scores_are_made_once_for_each_version(spark, tmp_path):
    store, made = Store(spark, str(tmp_path / "store")), []

    def make():
        made.append(1)
        return scored(spark, 5)

    assert [store.kept("reference_scores/v1", make).count() for _ in range(2)] == [5, 5] and len(made) == 1
    store.kept("reference_scores/v2", make)
    assert len(made) == 2
