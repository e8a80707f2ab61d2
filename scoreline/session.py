"""What the library needs from the running session. It never sets masters or partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def require_utc(spark: SparkSession) -> None:
    """Timestamps are compared as UTC instants, so another session zone would shift windows."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, is {zone}")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and stream checkpoints.

    The cluster names it in spark.checkpoint.dir. Only a local session without that setting,
    where all tasks run in one process, gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder all executors can reach")
    return tempfile.gettempdir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scoreline/{name}-{uuid.uuid4().hex}"


def default_slices(spark: SparkSession) -> int:
    """A power of two near twice the session's shuffle partitions, between 16 and 4096."""
    wanted = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 16
    while n < wanted and n < 4096:
        n *= 2
    return n
