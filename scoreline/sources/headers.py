"""CSV files read by the names in their own headers.

Spark gives the cells of a CSV file to the columns of a schema by position. Files of one folder may
hold their columns in different orders, lack some or have more, so each distinct header gets a scan
of its own and a projection by name.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files whose first line is fetched at a time. Only these lines come to the driver.
AT_ONCE = 32


def files_of(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files under a path, folder or pattern, as paths that can be read one by one."""
    found = spark.read.format("text").load(path).inputFiles()
    return sorted(unquote(f) for f in found)


def literal_path(path: str) -> str:
    """A path as a pattern that matches only itself."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line that isn't blank, through the session's own file systems and codecs."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).open(where)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
        plain = codec.createInputStream(stream) if codec else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
        while (line := reader.readLine()) is not None:
            if line.strip():
                return line
        return None
    finally:
        stream.close()


def headers(spark: SparkSession, files: Iterable[str]) -> dict[str, tuple[str, ...]]:
    """The header of each file; files without a line are left out."""
    files = list(files)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), files))
    found = {}
    for file, line in zip(files, lines):
        if line is not None:
            names = next(csv.reader([line.removeprefix("﻿")]))
            found[file] = tuple(n.strip() for n in names)
    return found


def _scan(spark: SparkSession, names: tuple[str, ...], files: list[str]) -> DataFrame:
    """All cells as text by position: header names may repeat or differ in case only."""
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    return spark.read.schema(schema).option("header", True).csv([literal_path(f) for f in files])


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    defaults: Mapping[str, Column] | None = None,
    files: Iterable[str] | None = None,
) -> DataFrame:
    """The schema's columns of all files under a path (or of `files`), found by name in each header.

    Order doesn't matter, other columns are ignored, and a column that a file lacks has its default
    there, or null. Cells that don't fit the type are null. A header that names one of the columns
    twice is refused.
    """
    defaults = defaults or {}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, names in headers(spark, files_of(spark, path) if files is None else files).items():
        by_header.setdefault(names, []).append(file)
    parts = []
    for names, members in sorted(by_header.items()):
        twice = [f.name for f in schema.fields if names.count(f.name) > 1]
        if twice:
            raise ValueError(f"{members[0]}: the header names {', '.join(twice)} more than once")
        rows, cells = _scan(spark, names, members), []
        for f in schema.fields:
            if f.name in names:
                text = F.col(f"_{names.index(f.name)}")
                cell = text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)
            else:
                cell = defaults.get(f.name, F.lit(None)).cast(f.dataType)
            cells.append(cell.alias(f.name))
        parts.append(rows.select(*cells))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)
