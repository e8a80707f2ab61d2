"""Reproducible stratified splits that do not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.operators import prefix

HASH_DIGITS = 8


def _check(ratios: tuple[float, float, float]) -> None:
    if abs(sum(ratios) - 1.0) >= 1e-9:
        raise ValueError(f"the shares of the splits add up to {sum(ratios):g} instead of 1")


def _hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def _hex_cut(share: float) -> str:
    top = 16**HASH_DIGITS
    return format(min(round(share * top), top - 1), f"0{HASH_DIGITS}x")


def hash_split(
    df: DataFrame,
    key: str,
    ratios: tuple[float, float, float] = (0.70, 0.15, 0.15),
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """train/val/test from a hash of the key: one projection, stratified in expectation."""
    _check(ratios)
    digest = F.substring(_hash(key, seed), 1, HASH_DIGITS)
    name = (
        F.when(digest < _hex_cut(ratios[0]), "train")
        .when(digest < _hex_cut(ratios[0] + ratios[1]), "val")
        .otherwise("test")
    )
    return df.withColumn(out, name)


def stratified_split(
    df: DataFrame,
    key: str,
    target: str,
    ratios: tuple[float, float, float] = (0.70, 0.15, 0.15),
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """train/val/test with exact shares in every class.

    Rows are ranked by key hash inside their class. The two hash values at the class's cut
    ranks (two per class) are broadcast back, so the table itself is never sorted or moved.
    All rows of a key share a hash and stay on one side; a repeated key at a cut moves the
    share by its own size.
    """
    _check(ratios)
    position = F.conv(F.substring(_hash(key, seed), 1, 15), 16, 10).cast("bigint")
    ranked = df.withColumn("__pos", position)
    counts = ranked.groupBy(target, "__pos").agg(F.count(F.lit(1)).alias("n"))
    running = prefix.cumulative(counts.where(F.col(target).isNotNull()), "__pos", ["n"], [target])

    def cut(share: float) -> Column:
        rank = F.floor(F.col("total_n") * F.lit(share) + 0.5)
        here = (F.col("cum_n") - F.col("n") < rank) & (rank <= F.col("cum_n"))
        return F.coalesce(F.max(F.when(here, F.col("__pos"))), F.lit(-1))

    cuts = running.groupBy(target).agg(
        cut(ratios[0]).alias("__train"), cut(ratios[0] + ratios[1]).alias("__val")
    )
    name = (
        F.when(F.col("__pos") <= F.col("__train"), "train")
        .when(F.col("__pos") <= F.col("__val"), "val")
        .otherwise("test")
    )
    joined = ranked.join(cuts, target, "left")
    return joined.select(*df.columns, name.alias(out))


def split_stats(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Rows and positive share (percent) per split, and for the whole table."""
    return df.rollup(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(target)).alias("n_positive"),
        F.round(F.avg(F.col(target)) * 100, 4).alias("positive_pct"),
    ).select(F.coalesce(F.col(split), F.lit("total")).alias(split), "n_rows", "n_positive", "positive_pct")


def split_overlap(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split (0 for a disjoint split)."""
    per_key = df.groupBy(key).agg((F.min(split) != F.max(split)).alias("shared"))
    return per_key.agg(F.count_if("shared").alias("shared_keys"), F.count(F.lit(1)).alias("keys"))


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """Rows whose hash of all columns (of `key`, if given) falls into the fraction: the same rows
    whatever the partitioning, and all or none of equal ones."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ([key] if key else df.columns)]
    digest = F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 8)
    return df.where(digest < f"{int(fraction * 2**32):08x}") if fraction < 1 else df


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """n / (classes * n_class): one row per class."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weight = F.col("whole.n") / (F.col("whole.k") * F.col("n"))
    return counts.withColumn("whole", whole).select(target, "n", weight.alias("weight"))
