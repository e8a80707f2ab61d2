"""Distribution drift between a reference and a current window.

All monitored columns go through one job: the windows are unpivoted to (feature, value) rows
and counted per distinct value and side before anything is shuffled, so a value that fills a
third of the table arrives as one row per task. Quantile buckets, PSI and KS then come from the
same table of counts and its running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.functions.columns import count_where, psi_band
from scoreline.functions.pvalues import chi_square_p, ks_p
from scoreline.operators import prefix

# Fixed value: shares are clipped here before the logarithm.
SHARE_FLOOR = 1e-6

# How stored metric rows name their windows.
REFERENCE_SCORES = "training-set predicted distribution"
REFERENCE_ROWS = "training split"
NEWEST = {"prediction": ("last ", " predictions"), "data": ("last ", " raw events")}

METRIC_COLUMNS = (
    "feature_name",
    "drift_type",
    "statistic_name",
    "statistic_value",
    "threshold",
    "is_drifted",
    "p_value",
    "reference_window",
    "current_window",
)


def _long(df: DataFrame, columns: Sequence[str], kind: str, current: int) -> DataFrame:
    wide = df.select(*[F.col(c).cast(kind).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "value").withColumn("side", F.lit(current))


def value_counts(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], kind: str
) -> DataFrame:
    """(feature, value, ref_n, cur_n). A null value row keeps the number of missing cells."""
    both = _long(reference, columns, kind, 0).unionByName(_long(current, columns, kind, 1))
    if kind == "double":
        both = both.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    counts = both.groupBy("feature", "value").agg(
        count_where(F.col("side") == 0).alias("ref_n"), count_where(F.col("side") == 1).alias("cur_n")
    )
    return prefix.settle(counts, "value")


def _psi_term(ref_n: Column, cur_n: Column, ref_total: Column, cur_total: Column) -> Column:
    r = F.greatest(ref_n / F.when(ref_total > 0, ref_total), F.lit(SHARE_FLOOR))
    c = F.greatest(cur_n / F.when(cur_total > 0, cur_total), F.lit(SHARE_FLOOR))
    return (c - r) * F.log(c / r)


def _feature_totals(counts: DataFrame) -> DataFrame:
    """One row per monitored column: windows with all cells missing still appear."""
    present = F.col("value").isNotNull()
    return counts.groupBy("feature").agg(
        F.sum("ref_n").alias("ref_rows"),
        F.sum("cur_n").alias("cur_rows"),
        F.sum(F.when(present, F.col("ref_n")).otherwise(0)).alias("ref_values"),
        F.sum(F.when(present, F.col("cur_n")).otherwise(0)).alias("cur_values"),
        count_where(present & (F.col("ref_n") + F.col("cur_n") > 0)).alias("n_values"),
    )


def _profile(counts: DataFrame, buckets: int) -> DataFrame:
    """Per feature: inner reference quantiles, widest gap of the distributions, sizes."""
    present = counts.where(F.col("value").isNotNull())
    running = prefix.cumulative(present, "value", ["ref_n", "cur_n"], ["feature"])
    gap = F.expr(
        "max(abs(cum_ref_n / if(total_ref_n > 0, total_ref_n, null)"
        " - cum_cur_n / if(total_cur_n > 0, total_cur_n, null)))"
    )
    extra = [
        gap.alias("gap"),
        F.max("total_ref_n").alias("ref_values"),
        F.max("total_cur_n").alias("cur_values"),
    ]
    out = prefix.quantiles(running, "value", "ref_n", buckets, ["feature"], extra)
    # The outer two points are open ends; fewer than three leave a single bucket, whose PSI is 0.
    return out.withColumn("points", F.array_distinct("quantiles")).select(
        "feature",
        F.expr("slice(points, 2, greatest(size(points) - 2, 0))").alias("inner"),
        "gap",
        "ref_values",
        "cur_values",
    )


def numeric_drift(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], buckets: int = 10
) -> DataFrame:
    """feature, psi, ks_d, n_reference, n_current, cur_rows for all columns in one job.

    Buckets lie between the reference quantiles, half-open with open ends: a value's bucket is
    the number of inner points <= value. psi is 0 where a side is empty or the reference has
    fewer than 3 distinct quantiles; ks_d is 0 when a side has fewer than 2 values.
    """
    counts = value_counts(reference, current, columns, "double")
    # One row per monitored column, with at most `buckets` numbers.
    placed = counts.join(F.broadcast(_profile(counts, buckets)), "feature", "left")
    bucket = F.expr("if(value is not null, size(filter(inner, p -> p <= value)), null)")
    per_bucket = placed.groupBy("feature", bucket.alias("bucket"), "gap", "ref_values", "cur_values").agg(
        F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n")
    )
    term = _psi_term(F.col("ref_n"), F.col("cur_n"), F.col("ref_values"), F.col("cur_values"))
    usable = F.expr("bucket is not null and ref_values > 0 and cur_values > 0")
    return per_bucket.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(usable, term)), F.lit(0.0)).alias("psi"),
        F.expr("coalesce(max(if(ref_values >= 2 and cur_values >= 2, gap, null)), 0D)").alias("ks_d"),
        F.expr("coalesce(max(ref_values), 0L)").alias("n_reference"),
        F.expr("coalesce(max(cur_values), 0L)").alias("n_current"),
        F.sum("cur_n").alias("cur_rows"),
    )


def numeric_psi(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], buckets: int = 10
) -> DataFrame:
    stats = numeric_drift(reference, current, columns, buckets)
    return stats.select("feature", "psi", "n_reference", "n_current")


def ks_statistic(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = numeric_drift(reference, current, columns)
    return stats.select("feature", "ks_d", "n_reference", "n_current")


def ks_test(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], method: str = "limit"
) -> DataFrame:
    stat = ks_statistic(reference, current, columns)
    p = ks_p(F.col("ks_d"), F.col("n_reference"), F.col("n_current"), method)
    return stat.withColumn("p_value", p)


def _categorical(counts: DataFrame) -> DataFrame:
    """feature, psi, chi_square, dof.

    Missing cells are no category, but they do count in the PSI shares. The chi-square is null
    for fewer than two categories or an empty side; with one degree of freedom it carries
    Yates' correction.
    """
    # One row per monitored column.
    rows = counts.join(F.broadcast(_feature_totals(counts)), "feature")
    present = F.col("value").isNotNull()
    term = _psi_term(
        F.col("ref_n"),
        F.col("cur_n"),
        F.greatest("ref_rows", F.lit(1)),
        F.greatest("cur_rows", F.lit(1)),
    )
    both = F.col("ref_values") + F.col("cur_values")
    whole = F.when(both > 0, both)

    def cell(observed: Column, side_total: Column) -> Column:
        expected = (F.col("ref_n") + F.col("cur_n")) * side_total / whole
        gap = F.abs(observed - expected)
        gap = F.when(F.col("n_values") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return gap * gap / F.when(expected > 0, expected)

    chi = cell(F.col("ref_n"), F.col("ref_values")) + cell(F.col("cur_n"), F.col("cur_values"))
    usable = (F.col("n_values") >= 2) & (F.col("ref_values") > 0) & (F.col("cur_values") > 0)
    return rows.groupBy("feature", "n_values", "cur_rows").agg(
        F.coalesce(F.sum(F.when(present, term)), F.lit(0.0)).alias("psi"),
        F.sum(F.when(present & usable, chi)).alias("chi_square"),
        F.max(F.when(usable, F.col("n_values") - 1)).alias("dof"),
    )


def categorical_psi(
    reference: DataFrame, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    return _categorical(value_counts(reference, current, columns, "string")).select("feature", "psi")


def chi_square(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    stat = _categorical(value_counts(reference, current, columns, "string"))
    p = chi_square_p(F.col("chi_square"), F.col("dof"))
    return stat.select("feature", "chi_square", "dof", p.alias("p_value"))


def _metric(
    drift_type: str,
    statistic: str,
    value: Column,
    threshold: float,
    drifted: Column,
    p_value: Column | None = None,
) -> Column:
    return F.struct(
        F.lit(drift_type).alias("drift_type"),
        F.lit(statistic).alias("statistic_name"),
        F.round(value, 6).alias("statistic_value"),
        F.lit(float(threshold)).alias("threshold"),
        drifted.alias("is_drifted"),
        (p_value if p_value is not None else F.lit(None).cast("double")).alias("p_value"),
    )


def _newest(kind: str) -> Column:
    before, after = NEWEST[kind]
    return F.concat(F.lit(before), F.col("cur_rows"), F.lit(after))


def _window_names(df: DataFrame, reference_window: str, current_window: Column) -> DataFrame:
    return df.withColumns(
        {"reference_window": F.lit(reference_window), "current_window": current_window}
    )


def prediction_drift(
    reference: DataFrame,
    current: DataFrame,
    column: str = "churn_probability",
    *,
    significant: float = 0.25,
    ks_alpha: float = 0.05,
    min_sample: int = 30,
    buckets: int = 10,
    reference_window: str = REFERENCE_SCORES,
    current_window: str | None = None,
    ks_method: str = "limit",
) -> DataFrame:
    """Metric rows psi and ks of the score distribution.

    Too small a current window gives no rows. The psi row alone decides about drift overall.
    """
    p = ks_p(F.col("ks_d"), F.col("n_reference"), F.col("n_current"), ks_method)
    one = numeric_drift(reference, current, [column], buckets)
    one = one.where(F.col("cur_rows") >= min_sample).withColumn("p", p)
    rows = F.array(
        _metric("prediction", "psi", F.col("psi"), significant, F.col("psi") >= significant),
        _metric("prediction", "ks", F.col("ks_d"), ks_alpha, F.col("p") < ks_alpha, F.col("p")),
    )
    window = (
        F.lit(current_window)
        if current_window
        else _newest("prediction")
    )
    long = one.select(
        F.lit(None).cast("string").alias("feature_name"), "cur_rows", F.inline(rows)
    )
    return _window_names(long, reference_window, window).select(*METRIC_COLUMNS)


def data_drift(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    *,
    psi_threshold: float = 0.25,
    chi_square_alpha: float = 0.05,
    min_sample: int = 30,
    buckets: int = 10,
    reference_window: str = REFERENCE_ROWS,
    current_window: str | None = None,
) -> DataFrame:
    """Metric rows per monitored column: psi, and chi_square for categories.

    Columns absent on either side are left out; too small a current window gives no rows.
    The chi_square row stores the statistic against alpha and is drifted by its p-value.
    """
    shared = [c for c in reference.columns if c in current.columns]
    numeric = [c for c in numeric if c in shared]
    categorical = [c for c in categorical if c in shared]
    parts: list[DataFrame] = []
    if numeric:
        psi = numeric_drift(reference, current, numeric, buckets)
        rows = F.array(_metric("data", "psi", F.col("psi"), psi_threshold, F.col("psi") >= psi_threshold))
        parts.append(psi.select("feature", "cur_rows", F.inline(rows)))
    if categorical:
        stat = _categorical(value_counts(reference, current, categorical, "string"))
        stat = stat.withColumn("p", chi_square_p(F.col("chi_square"), F.col("dof")))
        psi_row = _metric(
            "data", "psi", F.col("psi"), psi_threshold, F.col("psi") >= psi_threshold
        )
        chi_row = _metric(
            "data",
            "chi_square",
            F.col("chi_square"),
            chi_square_alpha,
            F.col("p") < chi_square_alpha,
            F.col("p"),
        )
        rows = F.array_compact(F.array(psi_row, F.when(F.col("chi_square").isNotNull(), chi_row)))
        parts.append(stat.select("feature", "cur_rows", F.inline(rows)))
    if not parts:
        raise ValueError("no monitored column is present in both windows")
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    window = (
        F.lit(current_window)
        if current_window
        else _newest("data")
    )
    named = _window_names(
        long.where(F.col("cur_rows") >= min_sample).withColumnRenamed("feature", "feature_name"),
        reference_window,
        window,
    )
    return named.select(*METRIC_COLUMNS)


def overall_drifted(metric_rows: DataFrame) -> DataFrame:
    """One row: any data row, or the prediction psi row, is drifted (ks rows only inform)."""
    counted = ~((F.col("drift_type") == "prediction") & (F.col("statistic_name") == "ks"))
    return metric_rows.agg(
        F.coalesce(F.bool_or(F.col("is_drifted") & counted), F.lit(False)).alias("drift_detected")
    )


def with_band(df: DataFrame, psi: str = "psi") -> DataFrame:
    return df.withColumn("psi_band", psi_band(F.col(psi)))
