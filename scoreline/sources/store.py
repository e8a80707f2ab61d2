"""The monitoring tables on parquet.

The tables of a cycle become visible together. Each attempt writes its rows into folders of its own,
which no reader looks at; one row in the manifest, a single small file, then publishes all of them.
An attempt that ends before that leaves only folders without a manifest row.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline.operators import merge, sketches
from scoreline.session import fresh_dir

_S, _D, _L, _B, _T = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


TABLES: dict[str, T.StructType] = {
    "predictions": _schema(
        ("customer_id", _S), ("churn_probability", _D), ("prediction", _S), ("actual_churn", _L),
        ("event_ts", _T), ("processed_ts", _T), ("model_source", _S), ("model_version", _S),
        ("contract", _S), ("ingested_at", _T), ("processed_date", T.DateType()),
    ),
    "drift_metrics": _schema(
        ("run_id", _S), ("computed_at", _T), ("feature_name", _S), ("drift_type", _S),
        ("statistic_name", _S), ("statistic_value", _D), ("threshold", _D), ("is_drifted", _B),
        ("p_value", _D), ("reference_window", _S), ("current_window", _S),
    ),
    "performance_metrics": _schema(
        ("run_id", _S), ("computed_at", _T), ("metric_name", _S), ("metric_value", _D),
        ("sample_size", _L), ("window_start", _T), ("window_end", _T), ("model_version", _S),
    ),
    "alerts": _schema(
        ("run_id", _S), ("fired_at", _T), ("severity", _S), ("category", _S), ("message", _S),
        ("metric_value", _D), ("threshold", _D), ("acknowledged", _B),
    ),
    "monitoring_runs": _schema(
        ("run_id", _S), ("run_ts", _T), ("records_processed", _L), ("drift_detected", _B),
        ("performance_degraded", _B), ("alerts_fired", _L), ("retrain", _B), ("status", _S), ("notes", _S),
    ),
    "quantile_sketches": _schema(
        ("processed_date", T.DateType()), ("model_version", _S), ("feature", _S), ("n_rows", _L),
        ("n_values", _L), ("sketch", T.BinaryType()),
    ),
    "model_versions": _schema(
        ("version", _L), ("run_id", _S), ("model_key", _S), ("model_class", _S), ("path", _S),
        ("saved_at", _T), ("split", _S), ("metric_name", _S), ("metric_value", _D),
    ),
}

PARTITIONS = {"predictions": ["processed_date"], "quantile_sketches": ["processed_date"]}

#: Tables that a cycle writes, published by the manifest.
CYCLE_TABLES = ("drift_metrics", "performance_metrics", "alerts", "monitoring_runs")
ATTEMPT = "attempt"
MANIFEST = _schema((ATTEMPT, _S), ("run_id", _S), ("status", _S), ("published_at", _T))
#: How a cycle may end: every step done, some step failed, or the cycle itself failed.
STATUSES = ("ok", "partial", "error")


def _rebalanced(df: DataFrame, table: str) -> DataFrame:
    """Rows of a day together, large days split and small ones joined by their actual size.

    Otherwise every task would write a file into every day.
    """
    return df.hint("rebalance", *[F.col(c) for c in PARTITIONS[table]])


def _shaped(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])


class Store:
    """Tables under one folder of any file system Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def location(self, table: str) -> str:
        if table not in TABLES:
            raise ValueError(f"unknown table: {table}")
        return f"{self.path}/{table}"

    def exists(self, table: str) -> bool:
        return self._there(self.location(table), TABLES[table])

    def _there(self, path: str, schema: T.StructType) -> bool:
        try:
            self.spark.read.schema(schema).parquet(path).schema
            return True
        except AnalysisException:
            return False

    def init(self) -> None:
        """Creates the missing tables; existing ones stay as they are."""
        for table in TABLES:
            if not self.exists(table):
                empty = self.spark.createDataFrame([], TABLES[table])
                if table in CYCLE_TABLES:
                    self.stage("none", {table: empty})
                else:
                    self.append(table, empty)

    def manifest(self) -> DataFrame:
        """A row for each published attempt."""
        path = f"{self.path}/_manifest"
        if not self._there(path, MANIFEST):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(path)

    def read(self, table: str) -> DataFrame:
        """A table that was never written reads as empty; rows that aren't published don't show."""
        return self._published(table, STATUSES) if table in CYCLE_TABLES else self._plain(table)

    def committed(self, table: str) -> DataFrame:
        """Rows of cycles that came to their end, with all steps or with some."""
        if table not in CYCLE_TABLES:
            raise ValueError(f"{table} is not written by cycles")
        return self._published(table, ("ok", "partial"))

    def _plain(self, table: str) -> DataFrame:
        if not self.exists(table):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(self.location(table))

    def _published(self, table: str, statuses: tuple[str, ...]) -> DataFrame:
        if not self.exists(table):
            return self.spark.createDataFrame([], TABLES[table])
        wide = T.StructType([*TABLES[table].fields, T.StructField(ATTEMPT, _S)])
        rows = self.spark.read.schema(wide).parquet(self.location(table))
        shown = self.manifest().where(F.col("status").isin(*statuses)).select(ATTEMPT).distinct()
        return rows.join(shown, ATTEMPT, "left_semi").select(*TABLES[table].fieldNames())

    def stage(self, attempt: str, tables: Mapping[str, DataFrame]) -> None:
        """Writes the rows of an attempt where only publish() makes them visible. Staging the same
        attempt again replaces them."""
        for table, df in tables.items():
            if table not in CYCLE_TABLES:
                raise ValueError(f"{table} is not written by cycles")
            _shaped(df, table).write.mode("overwrite").parquet(f"{self.location(table)}/{ATTEMPT}={attempt}")

    def publish(self, attempt: str, run_id: str, status: str) -> None:
        """Makes all tables of an attempt visible at once."""
        if status not in STATUSES:
            raise ValueError(f"unknown status: {status}")
        row = self.spark.createDataFrame([(attempt, run_id, status)], "attempt string, run_id string, status string")
        row = row.withColumn("published_at", F.current_timestamp()).coalesce(1)
        row.write.mode("append").parquet(f"{self.path}/_manifest")

    def commit(self, tables: Mapping[str, DataFrame], run_id: str, status: str) -> str:
        """Stages and publishes the tables of a cycle; returns the attempt."""
        attempt = uuid.uuid4().hex
        self.stage(attempt, tables)
        self.publish(attempt, run_id, status)
        return attempt

    def append(self, table: str, df: DataFrame) -> None:
        if table in CYCLE_TABLES:
            raise ValueError(f"{table} is written by commit()")
        shaped = _shaped(df, table)
        if table in PARTITIONS:
            by_day = _rebalanced(shaped, table).write.partitionBy(*PARTITIONS[table])
            by_day.mode("append").parquet(self.location(table))
        else:
            shaped.write.mode("append").parquet(self.location(table))

    def kept(self, name: str, make) -> DataFrame:
        """A table made once and read from then on, such as the reference scores of a model version.
        It is written beside its place first, so a failed write leaves nothing that would be read."""
        path = f"{self.path}/_kept/{name}"
        marker = f"{path}/_made"
        if not self._there(marker, MANIFEST):
            make().write.mode("overwrite").parquet(f"{path}/rows")
            done = self.spark.createDataFrame([(name, name, "ok", None)], MANIFEST)
            done.coalesce(1).write.mode("overwrite").parquet(marker)
        return self.spark.read.parquet(f"{path}/rows")

    def merge_predictions(self, rows: DataFrame, arrival: list[str]) -> int:
        """Appends the rows whose (customer_id, processed_ts) is new; returns their number.

        Only the days the batch touches are read back: the log is partitioned by day and the
        bounds are two values. Writing the same batch again adds nothing.
        """
        stamped = rows.withColumns(
            {
                "ingested_at": F.date_trunc("second", F.current_timestamp()),
                "processed_date": F.to_date("processed_ts"),
            }
        )
        span = stamped.agg(
            F.min("processed_date").alias("first"),
            F.max("processed_date").alias("last"),
            F.count(F.lit(1)).alias("n"),
        ).first()
        if not span.n:
            return 0
        day = F.col("processed_date")
        near = day.isNull() | day.between(F.lit(span["first"]), F.lit(span["last"]))
        touched = self.read("predictions").where(near)
        new = merge.new_rows(stamped, touched, arrival).persist()
        try:
            added = new.count()
            if added:
                self.append("predictions", new)
            return added
        finally:
            new.unpersist()

    def sketch_days(self, columns: tuple[str, ...] = ("churn_probability",), days: tuple | None = None) -> None:
        """Keeps the quantile sketches of the log's days, or of some; sketching a day again replaces it."""
        rows = self.read("predictions")
        if days is not None:
            rows = rows.where(F.col("processed_date").isin(*days))
        made = sketches.daily(rows, columns, ["processed_date", "model_version"])
        out = _rebalanced(_shaped(made, "quantile_sketches"), "quantile_sketches").write.mode("overwrite")
        out = out.option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS["quantile_sketches"])
        out.parquet(self.location("quantile_sketches"))

    def backfill_predictions(self, source: DataFrame, arrival: list[str], column: str = "contract") -> int:
        """Fills null cells of the stored log from `source`; returns the number of rows filled.

        Only days that hold a fillable row are rewritten. The new content is written beside the
        table first, so a failed rewrite leaves a complete copy and can be repeated.
        """
        log = self.read("predictions")
        known = source.where(F.col(column).isNotNull()).select("customer_id").distinct()
        open_rows = log.where(F.col(column).isNull()).join(known, "customer_id", "left_semi")
        found = open_rows.groupBy("processed_date").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a day
        days = [r.processed_date for r in found]
        if not days:
            return 0
        day = F.col("processed_date")
        dated = [d for d in days if d is not None]
        chosen = day.isin(*dated) if dated else F.lit(False)
        if None in days:
            chosen = chosen | day.isNull()
        staging = fresh_dir(self.spark, "backfill")
        merge.backfill(log.where(chosen), source, column, arrival=arrival).write.parquet(staging)
        filled = self.spark.read.schema(TABLES["predictions"]).parquet(staging)
        (
            _rebalanced(filled, "predictions")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*PARTITIONS["predictions"])
            .parquet(self.location("predictions"))
        )
        return sum(r.n for r in found)
