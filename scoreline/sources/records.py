"""A topic of JSON-lines files read by record position.

Spark's file stream counts in whole files. Here a record's place is its file and its number in it,
whatever way the file is split for reading, so a window can end inside a file and the next one goes
on at the next record.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreline.sources.headers import literal_path

#: Columns that tell where a record comes from, in the order of the topic.
PLACE = ("timestamp", "partition", "offset")
RANGES = "window_id bigint, partition string, first bigint, end bigint, total bigint"
KEYED = "key string, value string"
#: Files that are counted at first when a window of a given size is looked for; twice as many each time after.
COUNTED_FIRST = 8


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    rows = spark.read.text([literal_path(f) for f in files]).where(F.trim("value") != "")
    # The id grows by one from record to record of a block: it is given where the block is read.
    return rows.select(
        "value",
        F.col("_metadata.file_path").alias("partition"),
        F.col("_metadata.file_modification_time").alias("timestamp"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )


def _blocks(lines: DataFrame) -> DataFrame:
    """partition, block, the block's first id, its records, and those of the file before it."""
    found = lines.groupBy("partition", "block").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("timestamp")
    )
    before = Window.partitionBy("partition").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def numbered(spark: SparkSession, files: list[str]) -> DataFrame:
    """value, partition (the file), offset (the record's number in it, from 0) and timestamp (the
    file's) of every record; blank lines are none. A file may be read in any number of blocks: they
    are counted first, so no file has to go through one task."""
    lines = _lines(spark, files)
    starts = _blocks(lines).select("partition", "block", "first_id", "before")
    placed = lines.join(starts, ["partition", "block"])
    offset = F.col("before") + F.col("id") - F.col("first_id")
    return placed.select("value", "partition", offset.alias("offset"), "timestamp")


@dataclass(frozen=True)
class Records:
    """A window of a topic: its number, rows and file ranges."""

    id: int
    rows: DataFrame
    ranges: list[tuple[str, int, int, int]]

    @property
    def size(self) -> int:
        return sum(end - first for _, first, end, _ in self.ranges)


class Topic:
    """Windows of the records under a path, each handed out until it is committed.

    A window's ranges are written to the checkpoint before its rows are handed out. A run that ends
    before commit() gets the same window again, whatever files have come since. Files must not change;
    new ones come behind those that are there, by time and name.
    """

    def __init__(self, spark: SparkSession, path: str, checkpoint: str):
        self.spark, self.path, self.checkpoint = spark, path, checkpoint.rstrip("/")

    def _log(self, name: str, schema: str) -> list:
        """Rows of the checkpoint: one for each window, or file of a window."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.checkpoint}/{name}").collect()
        except AnalysisException:
            return []

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.checkpoint}/{name}")

    def next(self, max_records: int | None = None) -> Records | None:
        """The next window: all there is, or exactly max_records if there are as many. None at the end."""
        if max_records is not None and max_records < 1:
            raise ValueError(f"max_records must be positive, is {max_records}")
        planned, done = self._log("planned", RANGES), {r.window_id for r in self._log("committed", "window_id bigint")}
        opened = sorted({r.window_id for r in planned} - done)
        if opened:
            ranges = [(r.partition, r.first, r.end, r.total) for r in planned if r.window_id == opened[0]]
            return self._window(opened[0], ranges)
        ends = {}
        for r in planned:
            ends[r.partition] = max(ends.get(r.partition, (0, 0)), (r.end, r.total))
        ranges, left = [], max_records
        for partition, total in self._sizes({p for p, (end, total) in ends.items() if end >= total}, max_records is not None):
            first = ends.get(partition, (0, 0))[0]
            end = total if left is None else min(total, first + left)
            if first < end or partition not in ends:  # an empty file is noted, so as not to be counted again
                ranges.append((partition, first, end, total))
            if left is not None:
                left -= end - first
                if not left:
                    break
        if not any(first < end for _, first, end, _ in ranges):
            return None
        window_id = 1 + max(done, default=-1)
        self._append("planned", [(window_id, *r) for r in ranges], RANGES)
        return self._window(window_id, ranges)

    def commit(self, window: Records) -> None:
        """The window's outputs are written: the next one begins behind it."""
        self._append("committed", [(window.id,)], "window_id bigint")

    def _sizes(self, finished: set[str], some: bool) -> Iterator[tuple[str, int]]:
        """File and number of its records, in the topic's order, counted a few files at a time where
        only some are wanted. Only names and times of files, and a row for each block, are collected."""
        listed = self.spark.read.format("binaryFile").load(self.path).select("path", "modificationTime").collect()
        files = [r.path for r in sorted(listed, key=lambda r: (r.modificationTime, r.path)) if r.path not in finished]
        step = COUNTED_FIRST if some else max(1, len(files))
        while files:
            part, files = files[:step], files[step:]
            sizes = _blocks(_lines(self.spark, part)).groupBy("partition").agg(F.sum("n").alias("n")).collect()
            by_name = {files_name(unquote(r.partition)): r.n for r in sizes}  # as a URI, unlike the listed path
            yield from ((f, by_name.get(files_name(f), 0)) for f in part)
            step *= 2

    def _window(self, window_id: int, ranges: list[tuple[str, int, int, int]]) -> Records:
        wanted = [r for r in ranges if r[1] < r[2]]
        rows = numbered(self.spark, [r[0] for r in wanted])
        bounds = [(files_name(p), first, end) for p, first, end, _ in wanted]
        bounds = self.spark.createDataFrame(bounds, "partition string, first bigint, end bigint")
        name = F.url_decode(F.replace("partition", F.lit("+"), F.lit("%2B")))
        rows = rows.withColumn("partition", F.regexp_replace(name, "^file:/+", "file:/"))
        inside = (F.col("offset") >= F.col("first")) & (F.col("offset") < F.col("end"))
        rows = rows.join(bounds, "partition").where(inside)
        keyed = F.from_json("value", KEYED)
        rows = rows.select(keyed["key"].alias("key"), keyed["value"].alias("value"), "partition", "offset", "timestamp")
        return Records(window_id, rows, ranges)


def files_name(path: str) -> str:
    """One spelling of a file's path: Spark writes local ones with one slash or three."""
    return "file:/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
