"""One monitoring cycle: drift, performance, alerts and the run row."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline.functions.columns import psi_band
from scoreline.operators import alerts, drift, metrics, views
from scoreline.session import require_utc
from scoreline.sources.store import TABLES, Store

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class CycleConfig:
    # Defaults of the monitoring rules.
    numeric: tuple[str, ...] = ("tenure", "MonthlyCharges", "TotalCharges")
    categorical: tuple[str, ...] = ("Contract", "InternetService", "PaymentMethod")
    moderate: float = 0.10
    significant: float = 0.25
    ks_alpha: float = 0.05
    psi_threshold: float = 0.25
    chi_square_alpha: float = 0.05
    min_sample: int = 30
    buckets: int = 10
    baseline_roc_auc: float = 0.80
    tolerance: float = 0.05
    min_labeled: int = 20
    retrain_enabled: bool = False
    data_drift_enabled: bool = True
    alerts: alerts.AlertConfig = field(default_factory=alerts.AlertConfig)


@dataclass
class CycleResult:
    drift: DataFrame
    performance: DataFrame
    alerts: DataFrame
    run: DataFrame


def _columns(table: str, *without: str) -> T.StructType:
    return T.StructType([f for f in TABLES[table].fields if f.name not in without])


def run_cycle(
    spark: SparkSession,
    *,
    window: DataFrame,
    reference_scores: DataFrame | None,
    raw_window: DataFrame | None = None,
    reference: DataFrame | None = None,
    config: CycleConfig = CycleConfig(),
    store: Store | None = None,
    run_ts: datetime | None = None,
    run_id: str | None = None,
    model_version: str | None = None,
    segments: DataFrame | None = None,
    dry_run: bool = False,
) -> CycleResult:
    """Monitors `window` (scored rows) and `raw_window` (feature rows) against their references.

    The heavy work is one Spark job per statistic family over the windows; what comes to the
    driver are metric rows, a few per monitored column. `segments` (customer_id, contract, in order
    of `arrival`) fills null segments of the stored log at the end; a window that is read from the log
    has to be read anew after that.

    A step that fails is named in the notes and makes the cycle `partial`; the others go on. All
    tables of the cycle are published by one manifest row at its end, so a reader sees all of it or
    nothing. Where the cycle itself fails, at whatever point, a run row of status `error` is
    published in its place, with what had been counted until then, and the error is raised.
    """
    require_utc(spark)
    at = run_ts or datetime.now(timezone.utc).replace(microsecond=0)
    run = run_id or uuid.uuid4().hex
    if not dry_run and store is None:
        raise ValueError("a store is needed unless dry_run is set")
    notes: dict[str, str] = {}
    broken: list[str] = []
    known = {"n": 0, "drifted": False, "degraded": False, "fired": 0}
    metric_schema = _columns("drift_metrics", "run_id", "computed_at")

    def attempt(step: str, ready: bool, why: str, job: Callable[[], list]) -> list:
        if not ready:
            notes[step] = f"skipped: {why}"
            return []
        try:
            return job()
        except Exception as error:  # a failing step must not lose the others
            logger.warning("step %s failed", step, exc_info=True)
            notes[step] = f"failed: {type(error).__name__}"
            broken.append(step)
            return []

    try:
        n = known["n"] = views.row_count(window).first()["n"]

        predicted = attempt(
            "prediction_drift",
            n > 0 and reference_scores is not None,
            "empty window" if n == 0 else "no reference scores",
            lambda: drift.prediction_drift(
                reference_scores,
                window,
                significant=config.significant,
                ks_alpha=config.ks_alpha,
                min_sample=config.min_sample,
                buckets=config.buckets,
            ).collect(),
        )
        observed = attempt(
            "data_drift",
            config.data_drift_enabled and raw_window is not None and reference is not None,
            "no raw window" if config.data_drift_enabled else "disabled",
            lambda: drift.data_drift(
                reference,
                raw_window,
                config.numeric,
                config.categorical,
                psi_threshold=config.psi_threshold,
                chi_square_alpha=config.chi_square_alpha,
                min_sample=config.min_sample,
                buckets=config.buckets,
            ).collect(),
        )
        measured = attempt(
            "performance",
            n > 0,
            "empty window",
            lambda: metrics.performance_report(
                window,
                baseline_roc_auc=config.baseline_roc_auc,
                tolerance=config.tolerance,
                min_labeled=config.min_labeled,
                model_version=model_version,
            ).collect(),
        )

        drift_rows = spark.createDataFrame(
            [tuple(r[f.name] for f in metric_schema.fields) for r in predicted + observed],
            metric_schema,
        )
        report = None
        if measured:
            fields = "has_ground_truth boolean, sample_size bigint, accuracy double, precision double, " \
                "recall double, f1 double, roc_auc double, degraded boolean, reason string, " \
                "baseline_roc_auc double, degradation_tolerance double, window_start timestamp, " \
                "window_end timestamp, model_version string"
            report = spark.createDataFrame([tuple(measured[0])], fields)
            notes["performance"] = measured[0]["reason"] if measured[0]["has_ground_truth"] else "no labels"
        performance = (
            metrics.performance_rows(report)
            if report is not None
            else spark.createDataFrame([], _columns("performance_metrics", "run_id", "computed_at"))
        )
        volume = spark.createDataFrame([(n,)], "records_processed bigint")
        fired_rows = alerts.evaluate(drift_rows, report, volume, config.alerts).collect()
        fired = spark.createDataFrame(
            [tuple(r) for r in fired_rows],
            "severity string, category string, message string, metric_value double, threshold double",
        )
        for r in predicted:
            if r["statistic_name"] == "psi":
                value = spark.range(1).select(psi_band(F.lit(r["statistic_value"]), config.moderate, config.significant))
                notes["prediction_drift"] = value.first()[0]
        if observed:
            notes["data_drift"] = "computed"
        for step, rows in (("prediction_drift", predicted), ("data_drift", observed)):
            if not rows:
                notes.setdefault(step, f"skipped: fewer than {config.min_sample} records")
        # Last, since it rewrites days of the log that the window may be read from.
        if segments is not None and not dry_run:
            order = ["arrival"] if "arrival" in segments.columns else []
            filled = attempt("backfill", True, "", lambda: [store.backfill_predictions(segments, order)])
            if filled:
                notes["backfill"] = f"{filled[0]} rows"
        drifted = known["drifted"] = any(
            r["is_drifted"]
            for r in predicted + observed
            if not (r["drift_type"] == "prediction" and r["statistic_name"] == "ks")
        )
        degraded = known["degraded"] = bool(measured and measured[0]["degraded"])
        known["fired"] = len(fired_rows)
        status = "partial" if broken else "ok"
        result = _result(
            spark, at, run, drift_rows, performance, fired,
            (n, drifted, degraded, len(fired_rows), config.retrain_enabled and drifted, status,
             _text(notes)),
        )
        if not dry_run:
            store.commit(
                {
                    "drift_metrics": result.drift,
                    "performance_metrics": result.performance,
                    "alerts": result.alerts,
                    "monitoring_runs": result.run,
                },
                run,
                status,
            )
        return result
    except Exception as error:
        if not dry_run:
            notes["cycle"] = f"stopped by {type(error).__name__}"
            counted = (known["n"], known["drifted"], known["degraded"], known["fired"], False, "error", _text(notes))
            try:
                store.commit({"monitoring_runs": _run_row(spark, at, run, counted)}, run, "error")
            except Exception:  # the store itself may be what fails; the first error is the one to raise
                logger.exception("the failed cycle could not be recorded")
        raise


def _text(notes: dict[str, str]) -> str:
    return "; ".join(f"{k}={v}" for k, v in sorted(notes.items()))


def _run_row(spark: SparkSession, at: datetime, run: str, values: tuple) -> DataFrame:
    return spark.createDataFrame([(run, at, *values)], TABLES["monitoring_runs"])


def _result(spark, at, run, drift_rows, performance, fired, run_values) -> CycleResult:
    def stamp(df: DataFrame, column: str) -> DataFrame:
        return df.select(F.lit(run).alias("run_id"), F.lit(at).cast("timestamp").alias(column), "*")

    return CycleResult(
        drift=stamp(drift_rows, "computed_at"),
        performance=stamp(performance, "computed_at"),
        alerts=stamp(fired, "fired_at").withColumn("acknowledged", F.lit(False)),
        run=_run_row(spark, at, run, run_values),
    )
