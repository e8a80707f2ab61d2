"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.session import fresh_dir

SPACE = rb"[\x20\x09-\x0D]+"
#: Texts are handled in slices of about this many bytes, so a task never holds much more at a time.
SLICE_BYTES = 1 << 19


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, as --py-files does, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    handle, path = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """The two columns an operator reads, as doc_id and text; a null text becomes empty."""
    ship(df.sparkSession)
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    return df.select(
        df[id_col].alias("doc_id"), text.alias("text"), *[c.alias(k) for k, c in more.items()]
    )


#: Folders of the tables cut within each open `passing`, the innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def cut(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it again: later stages start from the files,
    so a lost executor costs no more than the stage at hand. Within `passing` the table goes at its
    end, or with `stays` at the end of the one around it, if there is one."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    owners = _passing.get()[: -1 if stays else None]
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Removes the tables cut within, also after an error. Nothing that is read later may need them:
    what the block returns is written with `stays`."""
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(token)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)


def row_keys(id_column: Column, text: Column) -> list[Column]:
    """Rows of equal keys have the same id and text."""
    return [F.xxhash64(id_column, text).alias("k1"), F.hash(text, id_column).alias("k2")]


def row_sample(rows: DataFrame, n: int, **more: Column) -> DataFrame:
    """rows: doc_id and text. text and `more` of at most n rows, those of the smallest hash of id and
    text, of equal rows one. Texts are read again by key, so none but these are sorted."""
    keyed = rows.select(*row_keys(F.col("doc_id"), F.col("text")), "text", *[c.alias(k) for k, c in more.items()])
    low = keyed.select("k1", "k2").distinct().orderBy("k1", "k2").limit(n)
    last = low.orderBy(F.desc("k1"), F.desc("k2")).first()  # one row
    if last is None:
        return keyed.drop("k1", "k2").limit(0)
    within = (F.col("k1") < last.k1) | ((F.col("k1") == last.k1) & (F.col("k2") <= last.k2))
    values = [F.max(c).alias(c) for c in keyed.columns[2:]]
    return keyed.where(within).groupBy("k1", "k2").agg(*values).drop("k1", "k2")


def fold(id_column: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def batches_of(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows that hold about `limit` bytes; a longer row stands alone."""
    i = total = 0
    j = 0
    for j, size in enumerate(sizes):
        if total and total + size > limit:
            yield i, j
            i, total = j, 0
        total += size
    if total or i <= j:
        yield i, j + 1


def portions(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that few texts at a time are held as Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def ascii_lower_words(text: str) -> list[bytes]:
    """Words of `[^\\x20\\x09-\\x0D]+` in UTF-8 with A-Z lower-cased, both by byte methods that know
    exactly these characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def partitions_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    return max(1, -(-rows // rows_per_task), int(spark.conf.get("spark.sql.shuffle.partitions")))


def xx_column(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's signed long."""
    return pa.array(values.astype(np.uint64).view(np.int64))


WORD = re.compile(r"[^\x20\x09-\x0D]+")
