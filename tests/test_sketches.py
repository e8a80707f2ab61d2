from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from scoreline.operators import drift, sketches
from scoreline.plans import bindings as B
from scoreline.sources.store import Store


def frame(spark, values, day=1, version="v1"):
    rows = [(day, version, None if v is None else float(v)) for v in values]
    return spark.createDataFrame(rows, "day int, version string, x double").repartition(4)


def test_merged_days_have_the_ranks_of_the_whole(spark):
    draw = np.random.default_rng(1)
    parts = [draw.gamma(2, size=n) * scale for n, scale in ((30_000, 1.0), (500, 9.0), (9000, 3.0))]
    days = [frame(spark, p, day) for day, p in enumerate(parts)]
    kept = days[0].unionByName(days[1]).unionByName(days[2])
    rows = sketches.daily(kept, ["x"], ["day", "version"])
    assert {(r.day, r.n_rows) for r in rows.collect()} == {(0, 30_000), (1, 500), (2, 9000)}
    points = sketches.merged(rows).select(sketches.quantiles(F.col("sketch"), 20).alias("q")).first().q
    everything = np.sort(np.concatenate(parts))
    ranks = np.searchsorted(everything, points[1:-1]) / len(everything)
    assert np.abs(ranks - np.arange(1, 20) / 20).max() <= sketches.rank_error()
    assert points[0] == everything[0] and points[-1] == everything[-1]


def test_psi_is_within_its_error_at_a_larger_scale(spark):
    sf = "/root/testdata/sf0.1"
    exact = {r.feature: r for r in drift.numeric_psi(*B.windows(spark, sf), ["churn_probability"]).collect()}
    for size in (200, sketches.SIZE):
        log = B.predictions(spark, sf).withColumn("day", F.to_date("processed_ts"))
        days = sketches.daily(log, ["churn_probability"], ["day", "model_version"], size)
        cut = F.lit(B.CURRENT_FROM).cast("date")
        found = sketches.psi(days.where(F.col("day") < cut), days.where(F.col("day") >= cut), size=size).first()
        want = exact[found.feature]
        assert (found.n_reference, found.n_current) == (want.n_reference, want.n_current)
        assert abs(found.psi - want.psi) <= found.psi_error < 0.5


def test_shifted_tied_and_missing_values(spark):
    base = list(range(100)) * 20

    def psi(reference, current):
        made = [sketches.daily(frame(spark, v), ["x"], ["day"]) for v in (reference, current)]
        return sketches.psi(*made).first()

    same = psi(base, base)
    assert same.psi == 0 and (same.n_reference, same.n_current, same.cur_rows) == (2000, 2000, 2000)
    shifted = psi(base, [v + 30 for v in base])
    want = drift.numeric_psi(frame(spark, base), frame(spark, [v + 30 for v in base]), ["x"]).first().psi
    assert abs(shifted.psi - want) <= shifted.psi_error
    assert psi([0, 1] * 50, [1] * 100).psi == 0  # fewer than three distinct quantiles
    gaps = psi(base, [None, float("nan")])
    assert (gaps.psi, gaps.n_current, gaps.cur_rows) == (0.0, 0, 2)
    assert sketches.psi(*[sketches.daily(frame(spark, []), ["x"], ["day"])] * 2).count() == 0


def test_days_are_kept_and_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    at = [datetime(2024, 1, d, 12) for d in (1, 1, 2)]
    rows = [(f"c{i}", 0.1 * i, "No", t, "v1", i) for i, t in enumerate(at)]
    columns = "customer_id string, churn_probability double, prediction string, processed_ts timestamp, model_version string, arrival int"
    log = spark.createDataFrame(rows, columns)
    for name in ("actual_churn", "event_ts", "model_source", "contract"):
        log = log.withColumn(name, F.lit(None))
    store.merge_predictions(log, ["arrival"])
    for _ in range(2):
        store.sketch_days()
    kept = store.read("quantile_sketches")
    assert sorted((str(r.processed_date), r.n_rows) for r in kept.collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]
    assert sketches.merged(kept).first().n_values == 3
