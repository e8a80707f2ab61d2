"""Quality of a binary classifier from labelled, scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.functions.columns import count_where, four_digits, guarded_ratio
from scoreline.operators import prefix

CELLS = ("tn", "fp", "fn", "tp")
METRICS = ("accuracy", "precision", "recall", "f1")


def _cells(label: Column, predicted: Column) -> dict[str, Column]:
    return {
        "tn": (label == 0) & (predicted == 0),
        "fp": (label == 0) & (predicted == 1),
        "fn": (label == 1) & (predicted == 0),
        "tp": (label == 1) & (predicted == 1),
    }


def confusion(
    df: DataFrame, label: Column, predicted: Column, groups: Sequence[str | Column] = ()
) -> DataFrame:
    """tn, fp, fn, tp in one aggregate."""
    return df.groupBy(*groups).agg(
        *[count_where(test).alias(name) for name, test in _cells(label, predicted).items()]
    )


def rates() -> dict[str, Column]:
    """Positive-class metrics over confusion cells; an empty denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "accuracy": guarded_ratio(tp + tn, tn + fp + fn + tp),
        "precision": guarded_ratio(tp, tp + fp),
        "recall": guarded_ratio(tp, tp + fn),
        "f1": guarded_ratio(2 * tp, 2 * tp + fp + fn),
    }


def classification_metrics(
    df: DataFrame, label: Column, predicted: Column, groups: Sequence[str | Column] = ()
) -> DataFrame:
    return confusion(df, label, predicted, groups).withColumns(rates())


def score_counts(
    df: DataFrame,
    label: Column,
    score: Column,
    groups: Sequence[str] = (),
    predicted: Column | None = None,
    at: str | None = None,
) -> DataFrame:
    """One row per distinct score: pos, neg, and on request the confusion cells and time span.

    Combined on the map side before the only shuffle of the labelled rows.
    """
    flat = df.select(
        *groups,
        score.cast("double").alias("score"),
        label.cast("int").alias("label"),
        *([predicted.cast("int").alias("predicted")] if predicted is not None else []),
        *([F.col(at).alias("at")] if at else []),
    )
    wanted = [count_where(F.col("label") == 1).alias("pos"), count_where(F.col("label") == 0).alias("neg")]
    if predicted is not None:
        cells = _cells(F.col("label"), F.col("predicted"))
        wanted += [count_where(test).alias(name) for name, test in cells.items()]
    if at:
        wanted += [F.min("at").alias("first"), F.max("at").alias("last")]
    usable = F.col("score").isNotNull() & ~F.isnan("score")
    return flat.where(usable).groupBy(*groups, "score").agg(*wanted)


def running_scores(
    df: DataFrame, label: Column, score: Column, groups: Sequence[str] = ()
) -> DataFrame:
    """`groups` are a few known windows or model versions, see prefix.cumulative()."""
    return prefix.cumulative(
        score_counts(df, label, score, groups), "score", ["pos", "neg"], groups
    )


def _area_roc() -> Column:
    """Mann-Whitney: pairs ordered rightly, ties count half. Null with a single class."""
    pairs = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0))
    whole = F.max("total_pos").cast("double") * F.max("total_neg")
    return F.when(whole > 0, pairs / F.when(whole > 0, whole))


def roc_auc(
    df: DataFrame, label: Column, score: Column, groups: Sequence[str] = ()
) -> DataFrame:
    running = running_scores(df, label, score, groups)
    return running.groupBy(*groups).agg(_area_roc().alias("roc_auc"))


def _curve_columns() -> dict[str, Column]:
    """Hits at or above the row's score."""
    return {
        "tps": F.col("total_pos") - F.col("cum_pos") + F.col("pos"),
        "fps": F.col("total_neg") - F.col("cum_neg") + F.col("neg"),
    }


def _average_precision() -> Column:
    precision = guarded_ratio(F.col("tps"), F.col("tps") + F.col("fps"))
    gain = F.col("pos") / F.when(F.col("total_pos") > 0, F.col("total_pos"))
    return F.sum(gain * precision)


def _trapezoid_pr() -> Column:
    """Area under the straight-line precision/recall curve."""
    precision = guarded_ratio(F.col("tps"), F.col("tps") + F.col("fps"))
    above_tp, above_fp = F.col("tps") - F.col("pos"), F.col("fps") - F.col("neg")
    above = F.when(above_tp + above_fp == 0, precision).otherwise(
        guarded_ratio(above_tp, above_tp + above_fp)
    )
    gain = F.col("pos") / F.when(F.col("total_pos") > 0, F.col("total_pos"))
    return F.sum(gain * (precision + above) / 2.0)


def pr_auc(df: DataFrame, label: Column, score: Column, method: str = "step") -> DataFrame:
    """method "step" is average precision, "trapezoid" the straight-line area."""
    area = {"step": _average_precision, "trapezoid": _trapezoid_pr}[method]
    points = running_scores(df, label, score).withColumns(_curve_columns())
    return points.agg(area().alias("pr_auc"))


def roc_curve(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """One point per distinct score."""
    points = running_scores(df, label, score).withColumns(_curve_columns())
    return points.select(
        F.col("score").alias("threshold"),
        guarded_ratio(F.col("fps"), F.col("total_neg")).alias("fpr"),
        guarded_ratio(F.col("tps"), F.col("total_pos")).alias("tpr"),
    )


def pr_curve(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """One point per distinct score, with the share of positives as baseline."""
    points = running_scores(df, label, score).withColumns(_curve_columns())
    return points.select(
        F.col("score").alias("threshold"),
        guarded_ratio(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
        guarded_ratio(F.col("tps"), F.col("total_pos")).alias("recall"),
        guarded_ratio(F.col("total_pos"), F.col("total_pos") + F.col("total_neg")).alias("prevalence"),
    )


def full_metrics(
    df: DataFrame, label: Column, predicted: Column, score: Column, groups: Sequence[str] = ()
) -> DataFrame:
    """Cells, rates and areas per group in one row each.

    A single scan for all groups: everything is first summed per distinct score. `groups` are
    a few known splits or windows, see prefix.cumulative().
    """
    counts = score_counts(df, label, score, groups, predicted)
    running = prefix.cumulative(counts, "score", ["pos", "neg"], groups)
    running = running.withColumns(_curve_columns())
    one = running.groupBy(*groups).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CELLS],
        _area_roc().alias("roc_auc"),
        _average_precision().alias("pr_auc"),
        _trapezoid_pr().alias("pr_auc_trapezoid"),
    )
    return one.withColumns(rates()).withColumn(
        "n_samples", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    )


def performance_report(
    df: DataFrame,
    *,
    baseline_roc_auc: float = 0.80,
    tolerance: float = 0.05,
    min_labeled: int = 20,
    label: str = "actual_churn",
    score: str = "churn_probability",
    predicted: str = "prediction",
    at: str = "processed_ts",
    model_version: str | None = None,
) -> DataFrame:
    """One row: metrics of the labelled part of a window and whether they degraded.

    Metrics are null when fewer than `min_labeled` rows carry a label.
    """
    counts = score_counts(
        df.where(F.col(label).isNotNull()),
        F.col(label),
        F.col(score),
        predicted=F.col(predicted) == "Yes",
        at=at,
    )
    one = prefix.cumulative(counts, "score", ["pos", "neg"]).agg(
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("sample_size"),
        F.min("first").alias("window_start"),
        F.max("last").alias("window_end"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CELLS],
        _area_roc().alias("roc_auc"),
    )
    enough = F.col("sample_size") >= min_labeled
    floor = baseline_roc_auc - tolerance
    checked = {k: F.when(enough, v) for k, v in rates().items()}
    checked["roc_auc"] = F.when(enough, F.col("roc_auc"))
    degraded = enough & F.col("roc_auc").isNotNull() & (F.col("roc_auc") < floor)
    verdict = F.when(degraded, "DEGRADED").otherwise("ok")
    reason = (
        F.when(
            ~enough,
            F.format_string(
                f"%d labels, too few to judge (at least {min_labeled} needed)",
                F.col("sample_size"),
            ),
        )
        .when(
            F.col("roc_auc").isNull(),
            "one class alone, no area to judge",
        )
        .otherwise(
            F.format_string(
                f"area %s, baseline {baseline_roc_auc:.4f}, floor {floor:.4f}: %s",
                four_digits(F.col("roc_auc")),
                verdict,
            )
        )
    )
    return one.select(
        (F.col("sample_size") > 0).alias("has_ground_truth"),
        F.col("sample_size"),
        *[v.alias(k) for k, v in checked.items()],
        F.coalesce(degraded, F.lit(False)).alias("degraded"),
        reason.alias("reason"),
        F.lit(float(baseline_roc_auc)).alias("baseline_roc_auc"),
        F.lit(float(tolerance)).alias("degradation_tolerance"),
        F.col("window_start"),
        F.col("window_end"),
        F.lit(model_version).cast("string").alias("model_version"),
    )


def performance_rows(report: DataFrame) -> DataFrame:
    """The report's metrics as long rows; undefined metrics give no row."""
    long = report.unpivot(
        ["sample_size", "window_start", "window_end", "model_version"],
        [*METRICS, "roc_auc"],
        "metric_name",
        "metric_value",
    )
    return long.where("metric_value IS NOT NULL")


def quality_gate(metric_rows: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """Every metric that has a minimum, and whether it reaches it."""
    floor = F.lit(None).cast("double")
    for name, value in minimums.items():
        floor = F.when(F.col("metric_name") == name, F.lit(float(value))).otherwise(floor)
    rows = metric_rows.withColumn("minimum", floor).where(F.col("minimum").isNotNull())
    return rows.withColumn("passed", F.col("metric_value") >= F.col("minimum"))
