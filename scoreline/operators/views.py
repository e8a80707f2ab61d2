"""Analytic views over the prediction log and the metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.functions.columns import count_where, risk_band, round_half_even

UNKNOWN = "Unknown"


def _newest(at: str, tiebreak: Sequence[str]) -> list[Column]:
    return [F.col(at).desc_nulls_last(), *[F.col(c).desc() for c in tiebreak]]


def recent(
    df: DataFrame, limit: int | None, at: str = "processed_ts", tiebreak: Sequence[str] = ()
) -> DataFrame:
    """The newest rows; None means the whole log. Every task keeps only its own top rows."""
    return df if limit is None else df.orderBy(*_newest(at, tiebreak)).limit(limit)


def latest_per_key(
    df: DataFrame, key: str, at: str = "processed_ts", tiebreak: Sequence[str] = ()
) -> DataFrame:
    """One row per key, the newest.

    Rank-and-keep-first is planned as a group limit before the shuffle: each task sends at most
    one row per key, so a key that owns a third of the log moves as few rows as any other.
    """
    newest = Window.partitionBy(key).orderBy(*_newest(at, tiebreak))
    ranked = df.withColumn("__rank", F.row_number().over(newest))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def _share(test: Column, digits: int = 2) -> Column:
    """Percent of rows, null for no rows."""
    n = F.count(F.lit(1))
    return round_half_even(count_where(test) / F.when(n > 0, n) * 100, digits)


def _segment(segment: str) -> Column:
    return F.coalesce(F.when(F.col(segment) != "", F.col(segment)), F.lit(UNKNOWN))


def churn_rate_by_segment(
    df: DataFrame,
    segment: str = "contract",
    key: str = "customer_id",
    limit: int | None = None,
    at: str = "processed_ts",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Share of Yes per segment, one vote per customer (the latest)."""
    votes = latest_per_key(recent(df, limit, at, tiebreak), key, at, tiebreak)
    return votes.groupBy(_segment(segment).alias(segment)).agg(
        F.count(F.lit(1)).alias("total"),
        _share(F.col("prediction") == "Yes").alias("churn_rate_pct"),
    )


def segment_rate_events(df: DataFrame, segment: str = "contract") -> DataFrame:
    """Share of Yes per segment over all scored events."""
    return df.groupBy(F.coalesce(F.col(segment), F.lit(UNKNOWN)).alias(segment)).agg(
        F.count(F.lit(1)).alias("total"),
        _share(F.col("prediction") == "Yes").alias("churn_rate_pct"),
    )


def top_customers(
    df: DataFrame,
    k: int = 10,
    key: str = "customer_id",
    score: str = "churn_probability",
    limit: int | None = None,
    at: str = "processed_ts",
    tiebreak: Sequence[str] = (),
    where: Column | None = None,
) -> DataFrame:
    """Customers with the highest latest score; `where` filters before the cut."""
    latest = latest_per_key(recent(df, limit, at, tiebreak), key, at, tiebreak)
    chosen = latest if where is None else latest.where(where)
    return (
        chosen.withColumn("risk", risk_band(F.col(score)))
        .orderBy(F.col(score).desc(), F.col(key).asc())
        .limit(k)
    )


def top_events(
    df: DataFrame, k: int = 10, score: str = "churn_probability", arrival: Sequence[str] = ()
) -> DataFrame:
    """Events with the highest score, earlier arrival first among equals."""
    return df.orderBy(F.col(score).desc(), *[F.col(c).asc() for c in arrival]).limit(k)


def volume(df: DataFrame, bucket: str = "hour", at: str = "processed_ts", limit: int | None = None) -> DataFrame:
    """Rows per hour or day of a timestamp."""
    text = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd"}[bucket]
    rows = recent(df.select(at).where(F.col(at).isNotNull()), limit, at)
    counted = rows.groupBy(F.date_trunc(bucket, F.col(at)).alias("b")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.date_format("b", text).alias("bucket"), "count")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def batch_summary(df: DataFrame, dead_letters: DataFrame | None = None) -> DataFrame:
    """Counters, share of Yes and mean score of a scored run; zeros when nothing was scored."""
    ok = df.select(F.lit(True).alias("ok"), "prediction", "churn_probability")
    if dead_letters is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("prediction", "string"), ("churn_probability", "double"))]
        ok = ok.unionByName(dead_letters.select(F.lit(False).alias("ok"), *none))
    return _summary(ok)


def routed_summary(routed: DataFrame) -> DataFrame:
    """batch_summary() of routed events in one pass, before they are parted."""
    score = round_half_even(F.col("probability"), 4).alias("churn_probability")
    return _summary(routed.select(F.col("error").isNull().alias("ok"), "prediction", score))


def _summary(ok: DataFrame) -> DataFrame:
    n = count_where(F.col("ok"))
    yes = count_where(F.col("prediction") == "Yes")
    return ok.agg(
        F.count(F.lit(1)).alias("consumed"),
        n.alias("predicted"),
        count_where(~F.col("ok")).alias("dead_lettered"),
        F.coalesce(round_half_even(yes / F.when(n > 0, n) * 100, 2), F.lit(0.0)).alias("overall_churn_pct"),
        F.coalesce(round_half_even(F.avg("churn_probability"), 4), F.lit(0.0)).alias(
            "mean_churn_probability"
        ),
    )


def score_batch_summary(df: DataFrame) -> DataFrame:
    """Share of Yes as a fraction, and mean score."""
    yes = count_where(F.col("prediction") == "Yes")
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("count"),
        round_half_even(yes / F.when(n > 0, n), 4).alias("churn_rate"),
        round_half_even(F.avg("churn_probability"), 4).alias("mean_probability"),
    )


KPIS = ("total", "churn_rate_pct", "avg_probability", "high_risk_count")


def overview_kpis(
    df: DataFrame,
    window: int = 500,
    high_risk: float = 0.70,
    key: str = "customer_id",
    at: str = "processed_ts",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """KPIs of the newest `window` customers and their change against the window before.

    The 2 * window newest rows are the feature's own bound; the rank below runs over those.
    """
    latest = latest_per_key(recent(df, 2 * window, at, tiebreak), key, at, tiebreak)
    order = Window.orderBy(*_newest(at, tiebreak))
    ranked = latest.withColumn("__rank", F.row_number().over(order))

    def stats(prefix: str, inside: Column) -> list[Column]:
        n = count_where(inside)
        some = F.when(n > 0, n)
        score = F.when(inside, F.col("churn_probability"))
        return [
            n.alias(f"{prefix}total"),
            (count_where(inside & (F.col("prediction") == "Yes")) / some * 100).alias(
                f"{prefix}churn_rate_pct"
            ),
            F.avg(score).alias(f"{prefix}avg_probability"),
            F.when(n > 0, count_where(score > high_risk)).alias(f"{prefix}high_risk_count"),
        ]

    both = ranked.agg(
        *stats("", F.col("__rank") <= window), *stats("previous_", F.col("__rank") > window)
    )
    had = F.col("previous_total") > 0
    deltas = [F.when(had, F.col(k) - F.col(f"previous_{k}")).alias(f"delta_{k}") for k in KPIS]
    return both.select(*KPIS, *deltas)


def current_model_version(
    df: DataFrame, at: str = "processed_ts", tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Newest model version that is not null, and where it was read from."""
    order = F.struct(F.col(at), *[F.col(c) for c in tiebreak])
    known = df.where(F.col("model_version").isNotNull())
    found = known.agg(F.max_by("model_version", order).alias("model_version"))
    source = F.when(F.col("model_version").isNull(), "unknown").otherwise("predictions")
    return found.withColumn("source", source)


def probability_histogram(df: DataFrame, column: str = "churn_probability", bins: int = 30) -> DataFrame:
    """Equal bins over [0, 1], the last one closed; empty bins appear with 0.

    Only the `bins` counters leave the tasks; the zero bins come from a bounded sequence.
    """
    p = F.col(column)
    bin_ = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("bigint")
    counts = df.where(p.between(0.0, 1.0)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    packed = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    every = packed.select(
        "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin")
    )
    return every.select(
        "bin",
        (F.col("bin") / bins).alias("low"),
        ((F.col("bin") + 1) / bins).alias("high"),
        F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0).cast("bigint")).alias("count"),
    )


STATISTICS = ("psi", "ks", "chi_square")


def drift_matrix(df: DataFrame, at: str = "computed_at") -> DataFrame:
    """feature x statistic, newest value per cell; overall rows have no feature and stay out."""
    return (
        df.where(F.col("feature_name").isNotNull())
        .groupBy("feature_name")
        .pivot("statistic_name", list(STATISTICS))
        .agg(F.max_by("statistic_value", at))
    )


def newest_set(df: DataFrame, at: str = "computed_at") -> DataFrame:
    """All rows of the newest computation."""
    return df.where(F.col(at) == df.agg(F.max(at)).scalar())


def active_alerts(
    df: DataFrame,
    limit: int = 50,
    unacknowledged_only: bool = True,
    at: str = "fired_at",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    rows = df.where(~F.col("acknowledged")) if unacknowledged_only else df
    return recent(rows, limit, at, tiebreak)


def latest_run(df: DataFrame, at: str = "run_ts") -> DataFrame:
    return recent(df, 1, at)


def segment_filter(df: DataFrame, segment: str, chosen: Sequence[str] | None) -> DataFrame:
    """Rows of the chosen segments; nothing chosen means all."""
    return df.where(F.col(segment).isin(*chosen)) if chosen else df


def pair_table(
    df: DataFrame, pair: str, framework: str, frameworks: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """One row per pair, the values of each framework side by side."""
    return (
        df.groupBy(pair)
        .pivot(framework, list(frameworks))
        .agg(*[F.max(v).alias(v) for v in values])
    )
