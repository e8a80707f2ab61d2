"""Batch sinks and the small reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.spec import FeatureSpec


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One directory per split; rewriting gives the same result."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_events(keyed: DataFrame, path: str, mode: str = "append") -> None:
    """(key, value) rows as JSON lines. Partitions and their order stay as they are: moving all
    rows of a key together would leave a frequent key to one task."""
    keyed.write.mode(mode).json(path)


def ordered_by_key(df: DataFrame, key: str, position: Sequence[str], partitions: int) -> DataFrame:
    """Rows so that those of a key follow each other by position, over adjacent partitions if many.

    Partitions are ranges of (hash of the key, position), so a frequent key fills several of about
    equal size, and no other arrangement of the input changes the order of a key's records.
    """
    order = [F.xxhash64(key), F.col(key), *[F.col(c) for c in position]]
    return df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)


def write_ordered(df: DataFrame, key: str, position: Sequence[str], value: Column, path: str, partitions: int) -> None:
    """Keyed JSON lines; read file by file in order of name, a key's records come by position."""
    rows = ordered_by_key(df, key, position, partitions)
    rows.select(F.col(key).cast("string").alias("key"), value.alias("value")).write.mode("overwrite").json(path)


def write_predictions_csv(scored: DataFrame, path: str, spec: FeatureSpec) -> None:
    columns = [c for c in (spec.id, "prediction", "label", "churn_probability") if c in scored.columns]
    scored.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def summary_document(
    summary: DataFrame, segments: DataFrame, top: DataFrame, segment: str = "contract"
) -> dict:
    """A run's summary as one document. Inputs are one row, one row per segment, and top-k."""
    s = summary.first().asDict()
    return {
        "counts": {k: s[k] for k in ("consumed", "predicted", "dead_lettered")},
        "overall_churn_pct": s["overall_churn_pct"],
        "mean_churn_probability": s["mean_churn_probability"],
        "churn_pct_by_contract": {
            r[segment]: r["churn_rate_pct"] for r in segments.orderBy(segment).collect()
        },
        "top_k_customers": [r.asDict() for r in top.collect()],
    }


def summary_markdown(document: dict) -> str:
    def table(head: tuple[str, ...], rows: list[tuple]) -> list[str]:
        lines = ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
        return lines + ["| " + " | ".join(str(v) for v in row) + " |" for row in rows]

    counts = list(document["counts"].items())
    counts += [(k, document[k]) for k in ("overall_churn_pct", "mean_churn_probability")]
    top = [tuple(r.values()) for r in document["top_k_customers"]]
    head = tuple(document["top_k_customers"][0]) if top else ("customerID",)
    return "\n".join(
        ["# Batch prediction summary", "", *table(("metric", "value"), counts), ""]
        + ["## By segment", "", *table(("segment", "churn %"), list(document["churn_pct_by_contract"].items())), ""]
        + ["## Highest scores", "", *table(head, top), ""]
    )


def write_report(spark: SparkSession, document: dict, path: str) -> None:
    """JSON and markdown of a summary, through Spark so that any file system works."""
    for name, text in (("json", json.dumps(document, ensure_ascii=False)), ("markdown", summary_markdown(document))):
        one = spark.range(1).select(F.lit(text).alias("value"))
        one.coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def write_table_csv(df: DataFrame, path: str) -> None:
    """Small result tables (benchmark rows, curves) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
