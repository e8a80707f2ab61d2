"""Quantile sketches that are kept and merged: drift of any window without its rows.

A sketch of each numeric column is stored for each day and model version. A window's distribution is
the merge of its sketches, a few rows a day, whatever the number of rows behind them. The exact
statistics of drift.py stay the default; these have a rank error, which is stated with them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.operators.drift import SHARE_FLOOR

#: Size of a sketch: about 50 KB for a column, day and version with very many rows.
SIZE = 2048


def rank_error(size: int = SIZE) -> float:
    """The error of a share of values between two points, as a share of all, that is exceeded in
    about 1 of 100 sketches. Fixed values: the published fit for this kind of sketch."""
    return 2.446 / size**0.9433


def daily(df: DataFrame, columns: Sequence[str], groups: Sequence[str], size: int = SIZE) -> DataFrame:
    """groups, feature, n_rows, n_values and sketch: one row for each group and column.

    Rows are sketched where they are read; tasks send a sketch for each group and column, so that a
    hot group is no more work than others. Null and NaN values count as rows only.
    """
    wide = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot(list(groups), list(columns), "feature", "value")
    long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return long.groupBy(*groups, "feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("value").alias("n_values"),
        F.kll_sketch_agg_double("value", size).alias("sketch"),
    )


def merged(sketches: DataFrame, groups: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """Sketches of one window: those of all its days and versions as one for each feature."""
    return sketches.groupBy(*groups, "feature").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_values").alias("n_values"),
        F.kll_merge_agg_double(F.when(F.col("n_values") > 0, F.col("sketch")), size).alias("sketch"),
    )


def quantiles(sketch: Column, parts: int) -> Column:
    """The points that cut a distribution into equal parts, both ends included."""
    shares = F.array(*[F.lit(i / parts) for i in range(parts + 1)])
    return F.kll_sketch_get_quantile_double(sketch, shares)


def _shares(windows: DataFrame, points: dict[str, list[float]]) -> dict[tuple[str, str], list[float]]:
    """By feature and side, the shares of the values between its points. Spark asks a sketch for the
    ranks of given numbers only, and a rank counts the point itself: the next smaller number is given.
    """
    ranks = F.lit(None).cast("array<double>")
    for feature, inner in points.items():
        given = F.array(*[F.lit(math.nextafter(p, -math.inf)) for p in inner])
        asked = F.kll_sketch_get_rank_double("sketch", given)
        ranks = F.when((F.col("feature") == feature) & (F.col("n_values") > 0), asked).otherwise(ranks)
    out = {}
    for r in windows.select("feature", "side", ranks.alias("ranks")).collect():  # a row a feature and side
        if r.ranks is not None:
            ends = [0.0, *r.ranks, 1.0]
            out[r.feature, r.side] = [max(b - a, SHARE_FLOOR) for a, b in zip(ends, ends[1:])]
    return out


def psi(reference: DataFrame, current: DataFrame, buckets: int = 10, size: int = SIZE) -> DataFrame:
    """feature, psi, psi_error, n_reference, n_current and cur_rows from sketches of two windows.

    Buckets lie between the reference's quantiles as in drift.numeric_drift. psi_error is what an
    error of rank_error() in every share, and as much by every bucket's edges, makes of psi, to first
    order. psi is 0 where a side has no value or the reference has fewer than 3 distinct quantiles.
    Merging is Spark's; a row a feature comes to the driver, of as many numbers as there are buckets.
    """
    sides = [merged(s, size=size).withColumn("side", F.lit(n)) for s, n in ((reference, "ref"), (current, "cur"))]
    windows = sides[0].unionByName(sides[1]).persist()
    try:
        asked = F.when((F.col("side") == "ref") & (F.col("n_values") > 0), quantiles(F.col("sketch"), buckets))
        rows = windows.select("feature", "side", "n_rows", "n_values", asked.alias("points")).collect()
        points = {r.feature: sorted(set(r.points))[1:-1] for r in rows if r.points}
        shares = _shares(windows, {f: inner for f, inner in points.items() if inner})
    finally:
        windows.unpersist()
    sizes = {(r.feature, r.side): r for r in rows}
    out = []
    for feature in sorted({r.feature for r in rows}):
        ref, cur = sizes.get((feature, "ref")), sizes.get((feature, "cur"))
        total = slope = 0.0
        for r, c in zip(shares.get((feature, "ref"), []), shares.get((feature, "cur"), [])):
            total += (c - r) * math.log(c / r)
            slope += abs(math.log(c / r) + 1 - r / c) + abs(math.log(c / r) + c / r - 1)
        error = 2 * rank_error(size) * slope
        out.append((feature, total, error, ref.n_values if ref else 0, cur.n_values if cur else 0, cur.n_rows if cur else 0))
    return reference.sparkSession.createDataFrame(
        out, "feature string, psi double, psi_error double, n_reference bigint, n_current bigint, cur_rows bigint"
    )
