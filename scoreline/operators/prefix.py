"""Running totals over a global order, without a one-task window.

An unpartitioned ordered window moves every row to one task. Here the order is cut into slices
of similar size; each slice gets its own window and starts from the total of all slices before
it. Input is pre-aggregated to one row per (group, value), so a frequent value is one row and
cannot overload a slice.

The cuts come from a sample chosen by the hash of the value. That makes them a function of the
data alone: a retried stage, or the second branch of the same plan, always sees the same
slices. (Sampled range partitioning or merged quantile sketches would not promise that.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.session import default_slices

SAMPLE_PER_SLICE = 32


def settle(counts: DataFrame, order: str) -> DataFrame:
    """Lets all branches of a plan read the one shuffle that made `counts`.

    The branches filter on the value and need different counters. Pushed below the aggregate,
    that would give each of them its own scan and shuffle of the source. The test on the hash
    always holds (it is a 64-bit number), but it makes every branch need every column, and makes
    the value depend on the counters. The branches then are equal down to the shuffle, and Spark
    reuses it.
    """
    always = F.xxhash64(*counts.columns) >= F.lit(-(2**63))
    return counts.where(always).withColumn(order, F.when(always, F.col(order)))


def _locate(df: DataFrame, cuts: str, value: str, slices: int, out: str) -> DataFrame:
    """Number of cuts <= value by binary search, one generated projection per step."""
    df = df.withColumn(out, F.lit(0))
    step = slices // 2
    while step:
        reached = F.get(F.col(cuts), F.col(out) + (step - 1)) <= F.col(value)
        df = df.withColumn(out, F.col(out) + F.when(reached, step).otherwise(0))
        step //= 2
    return df


def _attach(df: DataFrame, small: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per group beside every row of that group; a single row if there are no groups. Groups
    may be as many as days in a log, so the join is left to Spark, which broadcasts small sides."""
    if groups:
        return df.join(small, list(groups))
    names = small.columns
    packed = df.withColumn("__one", small.select(F.struct(*names)).scalar())
    return packed.select("*", *[F.col(f"__one.{n}").alias(n) for n in names]).drop("__one")


def cumulative(
    counts: DataFrame,
    order: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Adds `cum_<s>` (running total including the row) and `total_<s>` for every s in sums.

    `counts` holds one row per (groups, order); `order` is numeric and not null.
    """
    n = slices or default_slices(counts.sparkSession)
    if n & (n - 1):
        raise ValueError("slices must be a power of two")
    groups, sums = list(groups), list(sums)
    counts = settle(counts, order)

    # Uniform in [0, 1) per value, the same wherever it is evaluated.
    spread = F.expr(f"pmod(xxhash64(`{order}`), {1 << 30}) / {1 << 30}D")
    sizes = counts.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rows"))
    picked = _attach(counts, sizes, groups).where(spread * F.col("__rows") < n * SAMPLE_PER_SLICE)
    sample = picked.groupBy(*groups).agg(F.sort_array(F.collect_list(order)).alias("__sample"))
    cuts = sample.select(
        *groups,
        F.expr(
            f"transform(sequence(1, {max(n - 1, 1)}),"
            f" i -> get(__sample, cast(floor(i * size(__sample) / {n}) as int)))"
        ).alias("__cuts"),
    )
    placed = _locate(_attach(counts, cuts, groups), "__cuts", order, n, "__slice").drop("__cuts")

    # At most `slices` rows per group: these windows are small by construction.
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = placed.groupBy(*groups, "__slice").agg(*[F.sum(s).alias(s) for s in sums])
    offsets = per_slice.select(
        *groups,
        "__slice",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__before_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"total_{s}") for s in sums],
    )
    inside = Window.partitionBy(*groups, "__slice").orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.select("*", *[F.sum(s).over(inside).alias(f"__in_{s}") for s in sums])
    return running.join(offsets, [*groups, "__slice"]).select(
        *counts.columns,
        *[(F.col(f"__in_{s}") + F.col(f"__before_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
    )


def quantiles(
    running: DataFrame,
    order: str,
    count: str,
    buckets: int,
    groups: Sequence[str] = (),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact linear-interpolated quantiles at 0, 1/buckets, ..., 1 per group.

    `running` comes from cumulative(); `count` names the weight whose quantiles are wanted.
    Only the rows that cover one of the needed ranks are gathered, about 2 * buckets per group.
    `extra` aggregates over all rows are computed in the same pass.
    """
    total, after, first = f"total_{count}", f"cum_{count}", f"(cum_{count} - {count})"
    span = f"if({total} > 1, {total} - 1, null)"

    # How many of the lower (upper) ranks of the quantiles are <= x. A row is needed when that
    # number grows across it; one rank of slack on both sides absorbs rounding.
    def lower(x: str) -> str:
        return f"least(ceil(({x} + 1) * {buckets} / {span}) - 1, {buckets})"

    def upper(x: str) -> str:
        return f"least(floor({x} * {buckets} / {span}), {buckets})"

    hit = (
        f"{lower(after)} > {lower(first + ' - 2')} or {upper(after)} > {upper(first + ' - 2')}"
        f" or {total} <= 1 or {first} <= 1 or {after} >= {total} - 1"
    )
    row = f"struct({first} as first, {after} as after, `{order}` as v)"
    packed = running.groupBy(*groups).agg(
        F.expr(f"sort_array(collect_list(if({count} > 0 and ({hit}), {row}, null)))").alias("__rows"),
        F.expr(f"max({total})").alias("__n"),
        *extra,
    )

    def at(rank: str) -> str:
        return f"get(filter(__rows, r -> {rank} >= r.first and {rank} < r.after), 0).v"

    position = "k * (__n - 1)"
    low, part = f"({position}) div {buckets}", f"({position}) % {buckets}"
    high = f"(({low}) + if({part} > 0, 1, 0))"
    value = f"{at(f'({low})')} + ({at(high)} - {at(f'({low})')}) * ({part}) / {buckets}"
    points = F.expr(f"transform(sequence(0L, {buckets}L), k -> {value})")
    return packed.select(*groups, points.alias("quantiles"), *packed.columns[len(groups) + 2 :])
