"""Structured Streaming flows around the projections of events.py.

Outputs of a micro-batch go to folders named by the batch id and are overwritten when the batch
is repeated after a failure: each input is in exactly one output, however often a batch runs.
Message-queue sinks have no overwrite; there a repeated batch may publish a record again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from scoreline.operators import merge, views
from scoreline.session import fresh_dir
from scoreline.sources import records, tables
from scoreline.sources.store import Store
from scoreline.spec import FeatureSpec
from scoreline.streaming import events

KEYED = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

COUNTERS = "consumed bigint, predicted bigint, dead_lettered bigint"

#: What Spark tells of a file.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


@dataclass(frozen=True)
class Endpoint:
    """Where keyed records come from or go to: a format, a path for files, and its options."""

    format: str = "json"
    path: str | None = None
    options: dict[str, str] = field(default_factory=dict)


def read_events(
    spark: SparkSession, source: Endpoint, per_trigger: int | None = None, places: bool = False
) -> DataFrame:
    """(key, value) records as a stream, from the earliest unless the options say otherwise.

    `per_trigger` bounds a micro-batch: files for file sources, records for queues. `places` adds a
    queue's partition, offset and timestamp; files have them by records.Topic.
    """
    if source.format == "kafka":
        options = {"startingOffsets": "earliest", **source.options}
        if per_trigger:
            options["maxOffsetsPerTrigger"] = str(per_trigger)
        raw = spark.readStream.format("kafka").options(**options).load()
        more = records.PLACE if places else ()
        return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), *more)
    options = dict(source.options)
    if per_trigger:
        options["maxFilesPerTrigger"] = str(per_trigger)
    return spark.readStream.schema(KEYED).format(source.format).options(**options).load(source.path)


def write_keyed(keyed: DataFrame, sink: Endpoint, batch_id: int) -> None:
    if sink.format == "kafka":
        keyed.select("key", "value").write.format("kafka").options(**sink.options).save()
        return
    # No shuffle: records keep the partition and order they were read in, which for a queue is
    # the order of their key; a queue sink partitions by key itself.
    out = keyed.write.mode("overwrite").format(sink.format)
    out.options(**sink.options).save(f"{sink.path}/batch_id={batch_id}")


def _start(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None,
    mode: str = "append",
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()


def score_batch(
    batch: DataFrame,
    batch_id: int,
    spec: FeatureSpec,
    scorer: events.Scorer,
    out: str,
    *,
    threshold: float = 0.5,
    include_ground_truth: bool = True,
    processed_ts: Column | None = None,
    prediction_sink: Endpoint | None = None,
    dead_letter_sink: Endpoint | None = None,
    dry_run: bool = False,
) -> None:
    """Scores one batch of events and writes its tables and messages under its number, once.

    Where the batch knows the place of its records (records.PLACE), the tables keep it.
    """
    keep = tuple(c for c in records.PLACE if c in batch.columns)
    seen = Observation()
    routed = events.route(batch, spec, scorer, threshold=threshold, processed_ts=processed_ts)
    # Counted as the rows are made, by whichever write comes first; no job of their own.
    routed = routed.observe(seen, *events.counts()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if dry_run:
            routed.write.format("noop").mode("overwrite").save()
            return
        scored = events.predictions(routed, spec, include_ground_truth, keep)
        dead = events.dead_letters(routed, keep=keep)
        for name, df in (("predictions", scored), ("dead_letters", dead)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        counted = batch.sparkSession.createDataFrame([seen.get], COUNTERS).coalesce(1)
        counted.write.mode("overwrite").parquet(f"{out}/counters/batch_id={batch_id}")
        if prediction_sink:
            write_keyed(events.encode_predictions(scored.drop(*keep), spec), prediction_sink, batch_id)
        if dead_letter_sink:
            body = F.to_json(F.struct("original", "error", "failed_ts"))
            write_keyed(dead.select("key", body.alias("value")), dead_letter_sink, batch_id)
    finally:
        routed.unpersist()


def score_records(
    topic: records.Topic, spec: FeatureSpec, scorer: events.Scorer, out: str, *, max_records: int | None = None, **options
) -> int:
    """Scores the next window of a topic, at most max_records of it; returns its number of records.

    Outputs are written under the window's number before its position is committed: a run that ends
    in between writes the same window over itself. A dry run commits nothing.
    """
    window = topic.next(max_records)
    if window is None:
        return 0
    score_batch(window.rows, window.id, spec, scorer, out, **options)
    if not options.get("dry_run"):
        topic.commit(window)
    return window.size


def score_stream(
    source: DataFrame,
    spec: FeatureSpec,
    scorer: events.Scorer,
    out: str,
    checkpoint: str,
    *,
    threshold: float = 0.5,
    include_ground_truth: bool = True,
    processed_ts: Column | None = None,
    prediction_sink: Endpoint | None = None,
    dead_letter_sink: Endpoint | None = None,
    trigger: dict | None = None,
    dry_run: bool = False,
) -> StreamingQuery:
    """Scores events continuously, or all available ones with the default trigger.

    Per batch: tables predictions, dead_letters and counters under `out`, and keyed JSON to
    the sinks if given. The batch is scored once and kept for its writes. A dry run scores and
    writes nothing; give it a checkpoint of its own, so that no position moves.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        score_batch(
            batch, batch_id, spec, scorer, out, threshold=threshold, include_ground_truth=include_ground_truth,
            processed_ts=processed_ts, prediction_sink=prediction_sink, dead_letter_sink=dead_letter_sink, dry_run=dry_run,
        )

    return _start(source, handle, checkpoint, trigger)


def read_output(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}")


MESSAGE = (
    "customerID", "customer_id", "churn_probability", "prediction", "actual_churn", "event_ts",
    "processed_ts", "model_source", "model_version", "Contract",
)


def ingest_stream(
    source: DataFrame, store: Store, checkpoint: str, quarantine: str, trigger: dict | None = None
) -> StreamingQuery:
    """Prediction messages into the log, insert-only on (customer_id, processed_ts).

    The log is written before the position moves; a repeated batch finds its rows present and
    adds none. Unusable messages go to `quarantine` instead of failing the window.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, store, quarantine)

    return _start(source, handle, checkpoint, trigger)


def ingest_batch(batch: DataFrame, batch_id: int, store: Store, quarantine: str) -> int:
    """Messages of a batch into the log; returns the number of new rows. The last of equal keys is the
    last by the records' place, where the batch knows it, and else by the order in which it was read."""
    placed = all(c in batch.columns for c in records.PLACE)
    arrival = list(records.PLACE) if placed else ["arrival"]
    if not placed:
        batch = batch.withColumn("arrival", F.monotonically_increasing_id())
    schema = T.StructType([T.StructField(n, T.StringType()) for n in MESSAGE])
    parsed = batch.select("value", *arrival, F.from_json("value", schema).alias("m")).select("value", *arrival, "m.*")
    # The other spelling of the segment differs in case only, so it is no column of its own.
    other = F.get_json_object("value", "$.contract")
    parsed = parsed.withColumn("Contract", F.coalesce(F.nullif("Contract", F.lit("")), other))
    typed = merge.message_to_row(parsed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        bad = typed.where(F.col("row_error").isNotNull()).select("value", "row_error")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
        return store.merge_predictions(merge.log_rows(typed, arrival), arrival)
    finally:
        typed.unpersist()


def ingest_records(topic: records.Topic, store: Store, quarantine: str, max_records: int | None = None) -> int:
    """The next window of a topic into the log, at most max_records of it; returns its number of records."""
    window = topic.next(max_records)
    if window is None:
        return 0
    ingest_batch(window.rows, window.id, store, quarantine)
    topic.commit(window)
    return window.size


def publish_stream(
    table: DataFrame, key: str, sink: Endpoint, checkpoint: str, trigger: dict | None = None,
    dry_run: bool = False,
) -> StreamingQuery:
    """A table (file stream) as keyed JSON events.

    The checkpoint is the position: a restart continues behind the last finished batch, and a
    new checkpoint folder starts over. maxFilesPerTrigger on the source sets the chunk size.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        keyed = events.encode(batch, key)
        if dry_run:
            keyed.write.format("noop").mode("overwrite").save()
        else:
            write_keyed(keyed, sink, batch_id)

    return _start(table, handle, checkpoint, trigger)


def publish_csv(
    spark: SparkSession, path: str, spec: FeatureSpec, sink: Endpoint, checkpoint: str, *,
    files_per_batch: int = 100, blank: str = "keep", trigger: dict | None = None, dry_run: bool = False,
) -> StreamingQuery:
    """A folder of raw CSV files, each read by its own header, as keyed JSON events.

    The stream is one of file names: a micro-batch takes up to files_per_batch new files and reads
    them as a batch does, so that files of different headers keep their columns apart. A repeated
    batch has the same files and overwrites itself.
    """
    names = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch)
    names = names.load(path).select("path")  # no content is read

    def handle(batch: DataFrame, batch_id: int) -> None:
        files = sorted(r.path for r in batch.collect())  # at most files_per_batch
        if not files:
            return
        keyed = events.encode(tables.read_raw_csv(spark, path, spec, blank, files=files), spec.id)
        if dry_run:
            keyed.write.format("noop").mode("overwrite").save()
        else:
            write_keyed(keyed, sink, batch_id)

    return _start(names, handle, checkpoint, trigger)


def distinct_within(
    df: DataFrame, key: Sequence[str], at: str, horizon: str, late: str = "0 seconds", place: Sequence[str] = ()
) -> DataFrame:
    """Rows of a stream without the repeats of a key within a horizon of event time.

    Without `place` a row comes out at once if its key was not seen within the horizon, and which of
    the equal keys of one micro-batch survives is not defined. With `place` (the columns of a
    record's position) repeats that follow each other within the horizon are one group, whose row
    of the smallest place comes out when the watermark has passed the group by the horizon: the
    survivors depend neither on partitions nor on micro-batches. Rows without a time are dropped, and
    so are rows later than `late`; split_late() sets both aside first. A state entry goes when
    the watermark has passed it; keep the state in RocksDB (the session's
    spark.sql.streaming.stateStore.providerClass) where a horizon holds many keys.
    """
    if not place:
        marked = df.where(F.col(at).isNotNull()).withWatermark(at, horizon)
        return marked.dropDuplicatesWithinWatermark(list(key))
    marked = df.where(F.col(at).isNotNull()).withWatermark(at, late)
    row = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in place]))
    grouped = marked.groupBy(*[F.col(c).alias(f"__{c}") for c in key], F.session_window(at, horizon))
    return grouped.agg(row.alias("row")).select("row.*")


def distinct_stream(
    source: DataFrame, key: Sequence[str], at: str, horizon: str, out: str, checkpoint: str, *,
    late: str = "0 seconds", place: Sequence[str] = (), trigger: dict | None = None,
) -> StreamingQuery:
    """Writes the rows of distinct_within(), each micro-batch under its number."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return _start(distinct_within(source, key, at, horizon, late, place), handle, checkpoint, trigger)


def volume(df: DataFrame, at: str, bucket: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per tumbling window of a stream; rows later than `late` no longer count."""
    counted = df.withWatermark(at, late).groupBy(F.window(at, bucket)).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("window.start").alias("start"), "count")


def split_late(
    source: DataFrame, at: str, out: str, checkpoint: str, *, bucket: str = "1 hour", late: str = "1 hour",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Rows of a stream into `out`/on_time and `out`/late, each into one of them.

    A row is late if its window had closed, by the newest time of the batches before less `late`; so
    is a row without a time. volume_stream() over on_time drops no row then: its own watermark is
    never ahead of this one. The newest time of each batch is kept beside the rows, so that a
    repeated batch is split as before.
    """
    spark = source.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        highest = f"{out}/highest"
        try:
            before = spark.read.schema("newest timestamp, batch_id bigint").parquet(highest)
            newest = before.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        except AnalysisException:
            newest = None
        closed = F.col(at).isNull()
        if newest is not None:
            mark = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")
            closed = closed | (F.window(at, bucket)["end"] <= mark)
        rows = batch.withColumn("__late", closed).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name, test in (("on_time", ~F.col("__late")), ("late", F.col("__late"))):
                rows.where(test).drop("__late").write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
            top = rows.agg(F.max(at).cast("timestamp").alias("newest")).coalesce(1)
            top.write.mode("overwrite").parquet(f"{highest}/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return _start(source, handle, checkpoint, trigger)


def volume_stream(
    df: DataFrame, at: str, out: str, checkpoint: str, trigger: dict | None = None,
    complete: bool = False,
) -> StreamingQuery:
    """Writes closed windows as they pass the watermark, or with `complete` the whole series."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        name = "all" if complete else batch_id
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={name}")

    return _start(volume(df, at), handle, checkpoint, trigger, "complete" if complete else "append")


class Progress(StreamingQueryListener):
    """Appends a row for every finished micro-batch to a table of JSON files at `path`.

    At most `every` rows wait in the driver; what waits is written when a stream ends.
    """

    SCHEMA = "run_id string, name string, batch_id bigint, at string, rows bigint, rate double"

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self.spark, self.path, self.every = spark, path, every
        self._waiting: list[tuple] = []

    def _write(self) -> None:
        rows, self._waiting = self._waiting, []
        if rows:
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(self.path)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        row = (str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond))
        self._waiting.append(row)
        if len(self._waiting) >= self.every:
            self._write()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._write()


def run_score_table(
    spark: SparkSession, source: DataFrame, spec: FeatureSpec, scorer: events.Scorer,
    processed_ts: Column | None = None, top_k: int = 10,
) -> dict[str, DataFrame]:
    """A bounded scoring run over everything available: its outputs and its summary tables."""
    out = fresh_dir(spark, "score")
    query = score_stream(
        source, spec, scorer, out, f"{out}/_checkpoint", processed_ts=processed_ts
    )
    query.awaitTermination()
    scored, dead = read_output(spark, out, "predictions"), read_output(spark, out, "dead_letters")
    result = {
        "predictions": scored,
        "dead_letters": dead,
        "counters": read_output(spark, out, "counters"),
        "summary": views.batch_summary(scored, dead),
        "top": views.top_events(scored, top_k, arrival=[spec.id]),
    }
    if spec.segment:
        result["segments"] = views.segment_rate_events(scored, spec.segment)
    return result
