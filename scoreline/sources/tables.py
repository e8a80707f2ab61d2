"""Table sources."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline.functions import columns as C
from scoreline.sources import headers
from scoreline.spec import FeatureSpec

SPLITS = ("train", "val", "test")


def read_raw_csv(
    spark: SparkSession, path: str, spec: FeatureSpec, blank: str = "keep", files: Iterable[str] | None = None
) -> DataFrame:
    """Header CSV with the landing schema (all text); typing belongs to cleaning.

    Columns are found by name in each file's header; one that a file lacks is null there. A file
    without the id is refused and, for a whole path, so is a column that no file has; of the files of
    a micro-batch, which are given, any may lack it. blank="null" turns unreadable cells of the
    lenient columns into null instead of leaving them to the cleaner's 0.0, as the event publisher
    needs it.
    """
    if blank not in ("keep", "null"):
        raise ValueError(f"unknown blank: {blank}")
    there = headers.files_of(spark, path) if files is None else list(files)
    named = headers.headers(spark, there)
    for file, names in named.items():
        if spec.id not in names:
            raise ValueError(f"{file}: the header has no {spec.id}")
    found = {n for names in named.values() for n in names}
    absent = [c for c in spec.raw_columns if c not in found and c != spec.target_raw]
    if named and absent and files is None:
        raise ValueError(f"{path}: no file has the columns {', '.join(absent)}")
    raw = headers.read_csv(spark, path, spec.raw_schema(), files=there)
    if blank == "keep":
        return raw
    return raw.withColumns({c: C.strict_double(F.col(c)) for c in spec.lenient})


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a table written by write_splits(); a single directory is read."""
    if split not in SPLITS:
        raise ValueError(f"unknown split '{split}', expected one of {', '.join(SPLITS)}")
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def read_json(
    spark: SparkSession, path: str, schema: T.StructType, defaults: Mapping[str, Column] | None = None
) -> DataFrame:
    """JSON lines with the schema's fields. A field that a record lacks has its default, or null; a
    field that is null stays null. One scan: which fields there are is asked of each record, not of
    the whole input beforehand. A line that is no JSON is a record of nulls, a blank line is none.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", T.ArrayType(schema))  # a line holds one record or a list of them
    is_list = F.ltrim("value").startswith("[")
    raw = F.when(is_list, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    records = lines.select(F.inline_outer(F.arrays_zip(parsed.alias("record"), raw.alias("text"))))
    keys = F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>"))
    cells = []
    for f in schema.fields:
        cell = F.col("record")[f.name]
        default = (defaults or {}).get(f.name)
        if default is not None:
            lacks = F.col("text").isNotNull() & ~F.array_contains(keys, f.name)
            cell = F.when(lacks, default.cast(f.dataType)).otherwise(cell)
        cells.append(cell.alias(f.name))
    return records.select(*cells)


def read_records(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str | None = None,
    defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Scoring input: CSV with header, JSON lines or parquet, by extension or by name.

    All columns of the schema, found by name, in any order. One that a CSV file or a JSON record
    lacks has its default (clean.column_defaults), or null. Parquet comes as it is.
    """
    kind = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    kind = {"jsonl": "json", "ndjson": "json"}.get(kind, kind)
    if kind == "csv":
        return headers.read_csv(spark, path, schema, defaults)
    if kind == "json":
        return read_json(spark, path, schema, defaults)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown input format: {kind}")


def after_position(rows: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """Rows behind the last published key. Nothing published yet means all rows."""
    last = done.agg(F.max(key)).scalar()
    return rows.where(last.isNull() | (F.col(key) > last))
