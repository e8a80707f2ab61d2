"""Model versions as a table: which one is, and which one should be, in production."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def version_table(versions: DataFrame, history: DataFrame, aliases: DataFrame) -> DataFrame:
    """version, run_id, metric_value (last in the run's history), aliases (sorted)."""
    last = history.groupBy("run_id").agg(F.max_by("value", "step").alias("metric_value"))
    names = aliases.groupBy("version").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return (
        versions.join(last, "run_id", "left")
        .join(names, "version", "left")
        .withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    )


def champion(table: DataFrame, alias: str = "production", force: bool = False) -> DataFrame:
    """One row: best and current version, the decision and its reason.

    A version without metric cannot win. A tie does not replace the current version unless
    forced; a current version without metric always gives way. Staging follows the newest.
    """
    is_current = F.array_contains("aliases", alias)
    rank = F.struct(F.col("metric_value"), -F.col("version"))
    scored = F.col("metric_value").isNotNull()
    one = table.agg(
        F.count(F.lit(1)).alias("n_versions"),
        F.max_by("version", F.when(scored, rank)).alias("best_version"),
        F.max("metric_value").alias("best_metric"),
        F.max(F.when(is_current, F.col("version"))).alias("current_version"),
        F.max_by("metric_value", F.when(is_current, F.col("version"))).alias("current_metric"),
        F.max("version").alias("newest_version"),
    )
    beaten = F.col("current_metric").isNull() | (F.col("best_metric") > F.col("current_metric"))
    promote = F.col("best_version").isNotNull() & (beaten | F.lit(force))
    reason = (
        F.when(F.col("n_versions") == 0, "no versions")
        .when(F.col("best_version").isNull(), "no version has the metric")
        .when(promote, "promoted")
        .otherwise("best does not beat current production")
    )
    return one.select(
        "best_version",
        "best_metric",
        "current_version",
        "current_metric",
        promote.alias("promote"),
        F.when(promote, F.col("best_version")).otherwise(F.col("current_version")).alias(
            "new_production"
        ),
        F.when(promote, F.col("newest_version")).alias("new_staging"),
        reason.alias("reason"),
    )
