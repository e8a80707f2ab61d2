from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.operators import prefix, split


@pytest.mark.parametrize("slices", [1, 2, 16, 64])
@pytest.mark.parametrize("partitions", [1, 7])
def test_running_totals_equal_a_single_pass(spark, slices, partitions):
    rng = random.Random(slices)
    rows = [(g, v, rng.randint(0, 5), rng.randint(0, 5)) for g in "ab" for v in rng.sample(range(10**6), 700)]
    rows += [("one", 5, 3, 1)]
    df = spark.createDataFrame(rows, "g string, v bigint, x bigint, y bigint").repartition(partitions)
    got = prefix.cumulative(df, "v", ["x", "y"], ["g"], slices=slices).collect()
    assert len(got) == len(rows)
    for g in ("a", "b", "one"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.v)
        want = sorted(r for r in rows if r[0] == g)
        assert [r.cum_x for r in mine] == list(np.cumsum([r[2] for r in want]))
        assert [r.cum_y for r in mine] == list(np.cumsum([r[3] for r in want]))
        assert {r.total_x for r in mine} == {sum(r[2] for r in want)}


def test_running_totals_without_groups_and_empty(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(500)], "v double, x bigint")
    got = {r.v: r.cum_x for r in prefix.cumulative(df, "v", ["x"]).collect()}
    assert got == {float(i): i + 1 for i in range(500)}
    assert prefix.cumulative(df.limit(0), "v", ["x"]).count() == 0


def test_slices_are_balanced(spark):
    df = spark.range(20_000).select(F.pow("id", F.lit(3.0)).alias("v"), F.lit(1).cast("bigint").alias("x"))
    plan = prefix.cumulative(df, "v", ["x"], slices=16)._jdf.queryExecution().toString()
    assert "__slice" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11, 37, 1000])
def test_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2 if n > 100 else 6)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    counts = df.groupBy(F.lit("f").alias("g"), "v").agg(F.count(F.lit(1)).alias("n"))
    running = prefix.cumulative(counts, "v", ["n"], ["g"])
    got = prefix.quantiles(running, "v", "n", 10, ["g"]).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile(values, np.linspace(0, 1, 11))), abs=1e-12)


def customers(spark, n=4000):
    return spark.range(n).select(
        F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") % 5 == 0, 1).otherwise(0).alias("y")
    )


def test_exact_split_has_exact_shares_and_ignores_partitioning(spark):
    df = customers(spark)
    one = split.stratified_split(df, "id", "y")
    counts = {(r.y, r.split): r["count"] for r in one.groupBy("y", "split").count().collect()}
    assert counts == {(0, "train"): 2240, (0, "val"): 480, (0, "test"): 480,
                      (1, "train"): 560, (1, "val"): 120, (1, "test"): 120}
    again = split.stratified_split(df.repartition(13), "id", "y")
    assert one.exceptAll(again).count() == 0
    other = split.stratified_split(df, "id", "y", seed=7)
    assert one.exceptAll(other).count() > 0


def test_hash_split_is_near_the_shares(spark):
    stats = {r.split: r for r in split.split_stats(split.hash_split(customers(spark), "id"), "y").collect()}
    assert stats["total"].n_rows == 4000 and stats["total"].positive_pct == 20.0
    assert abs(stats["train"].n_rows / 4000 - 0.70) < 0.03
    assert abs(stats["val"].positive_pct - 20.0) < 4
    with pytest.raises(ValueError, match="sum to 1.0"):
        split.hash_split(customers(spark), "id", (0.7, 0.2, 0.2))


def test_a_hot_key_stays_on_one_side(spark):
    df = customers(spark, 1000).unionByName(
        spark.range(500).select(F.lit("hot").alias("id"), F.lit(0).alias("y"))
    )
    for parted in (split.hash_split(df, "id"), split.stratified_split(df, "id", "y")):
        assert parted.count() == 1500
        assert parted.where("id = 'hot'").select("split").distinct().count() == 1
        assert split.split_overlap(parted, "id").first().shared_keys == 0


def test_class_weights(spark):
    got = {r.y: r.weight for r in split.class_weights(customers(spark, 100), "y").collect()}
    assert got == {1: 100 / (2 * 20), 0: 100 / (2 * 80)}
