from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scoreline.functions import columns as C
from scoreline.functions import pvalues


def apply(spark, values, kind, *expressions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", *[e.alias(f"c{n}") for n, e in enumerate(expressions)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(expressions) > 1 else r[1] for r in rows]


def test_strip_takes_all_white_space(spark):
    got = apply(spark, ["\t a b \n", " x　", " ", None], "string", C.strip(F.col("v")))
    assert got == ["a b", "x", "", None]


def test_numbers_from_text(spark):
    values = [" 29.85 ", "", "n/a", "NaN", "1e3", "12d", "12f", "inf", None]
    got = apply(spark, values, "string", C.lenient_double(F.col("v")), C.strict_double(F.col("v")))
    assert [g[0] for g in got] == [29.85, 0.0, 0.0, 0.0, 1000.0, 0.0, 0.0, math.inf, 0.0]
    assert [g[1] for g in got] == [29.85, None, None, None, 1000.0, None, None, math.inf, None]


def test_whole_numbers_and_flags(spark):
    assert apply(spark, ["1", "0.7", "x", "1e30", None], "string", C.whole_number(F.col("v"))) == [
        1, 0, None, None, None
    ]
    assert apply(spark, [" Yes ", "No", "yes", None], "string", C.yes_no(F.col("v"))) == [1, 0, None, None]


def test_ground_truth(spark):
    values = ["Yes", "No", "Maybe", "1", "0", "true", None]
    got = apply(spark, values, "string", C.ground_truth(F.col("v")), C.ground_truth_int(F.col("v")))
    assert got == [("Yes", 1), ("No", 0), (None, None), (None, 1), (None, 0), (None, 1), (None, None)]


def test_bands_keep_their_boundary_rules(spark):
    p = [0.95, 0.70, 0.55, 0.40, None]
    assert apply(spark, p, "double", C.risk_band(F.col("v"))) == ["high", "medium", "medium", "low", "unknown"]
    psi = [0.05, 0.10, 0.24, 0.25]
    assert apply(spark, psi, "double", C.psi_band(F.col("v"))) == ["none", "moderate", "moderate", "significant"]
    assert apply(spark, [0.5, 0.49], "double", C.threshold_label(F.col("v"))) == ["Yes", "No"]


def test_severity(spark):
    df = spark.createDataFrame([(0.30, 0.25), (0.60, 0.25), (1.05, 1.0), (1.5, 1.0), (2.5, 1.0), (3.0, 0.0)], "v double, t double")
    got = [r[0] for r in df.select(C.severity(F.col("v"), F.col("t"))).collect()]
    assert got == ["warning", "critical", "info", "warning", "critical", "warning"]


@pytest.mark.parametrize("digits", [2, 4])
def test_rounding_equals_python(spark, digits):
    rng = random.Random(7)
    values = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 0.00005, 0.00015, 0.12345, 0.99995, 12.5, 0.0]
    values += [rng.randint(0, 10**6) / 10 ** (digits + 1) for _ in range(2000)]
    values += [(rng.randint(0, 10**5) * 10 + 5) / 10 ** (digits + 1) for _ in range(4000)]
    values += [rng.random() * 100 for _ in range(2000)]
    got = apply(spark, values, "double", C.round_half_even(F.col("v"), digits))
    assert got == [round(v, digits) for v in values]


def test_timestamps(spark):
    values = ["2024-01-05T10:00:00Z", "2024-01-05T10:00:00+02:00", "2024-01-05 10:00:00.5", "2024-01-05",
              "yesterday", "2024", "", None]
    got = apply(spark, values, "string", C.parse_timestamp(F.col("v")).cast("string"))
    assert got == ["2024-01-05 10:00:00", "2024-01-05 08:00:00", "2024-01-05 10:00:00.5",
                   "2024-01-05 00:00:00", None, None, None, None]
    stamp = apply(spark, [datetime(2024, 1, 5, 10, 0, 0, 7)], "timestamp_ntz", C.iso_second(F.col("v")))
    assert stamp == ["2024-01-05T10:00:00Z"]


def test_chi_square_tail(spark):
    def tails(rows):
        df = spark.createDataFrame([(i, x, k) for i, (x, k) in enumerate(rows)], "i int, x double, k int")
        found = df.select("i", pvalues.chi_square_p(F.col("x"), F.col("k")).alias("p")).orderBy("i").collect()
        return [r.p for r in found]

    got = tails([(3.841458820694124, 1), (50.0, 4), (0.0, 3), (None, 3), (1.0, None), (1e7, 2)])
    assert got[0] == pytest.approx(0.05, abs=1e-12)
    assert got[1] == pytest.approx(math.exp(-25) * 26, rel=1e-12)
    assert got[2:] == [1.0, None, None, 0.0]
    points = (0.1, 1.0, 2.9, 3.1, 5.0, 20.0, 80.0)
    assert tails([(x, 1) for x in points]) == pytest.approx([math.erfc(math.sqrt(x / 2)) for x in points], rel=1e-10)
    # an even number of degrees of freedom has a finite sum
    for k, x in ((10, 4.0), (10, 30.0), (400, 380.0), (400, 402.0), (400, 500.0), (20_000, 20_100.0)):
        terms = [j * math.log(x / 2) - x / 2 - math.lgamma(j + 1) for j in range(k // 2)]
        assert tails([(x, k)])[0] == pytest.approx(math.fsum(map(math.exp, terms)), rel=1e-8)


def test_ks_tail_against_enumeration(spark):
    from itertools import combinations

    def brute(reach, n, m):
        hits = total = 0
        for chosen in combinations(range(n + m), n):
            i = j = widest = 0
            for k in range(n + m):
                if k in chosen:
                    i += 1
                else:
                    j += 1
                widest = max(widest, abs(i * m - j * n))
            total += 1
            hits += widest >= reach
        return hits / total

    for n, m, reach in [(4, 5, 9), (5, 5, 10), (3, 7, 12), (6, 4, 8), (5, 5, 25)]:
        assert pvalues.ks_exact_tail(reach / (n * m), n, m) == pytest.approx(brute(reach, n, m), rel=1e-12)
    df = spark.createDataFrame([(0, 0.9, 1, 50), (1, 0.02, 9000, 9000), (2, 0.001, 50, 50)], "i int, d double, n long, m long")
    both = [pvalues.ks_p(F.col("d"), F.col("n"), F.col("m"), k).alias(k) for k in pvalues.KS_METHODS]
    one, large, near = df.select("i", *both).orderBy("i").collect()
    assert (one.limit, one.exact, near.limit) == (1.0, 1.0, 1.0)
    assert large.exact == pytest.approx(large.limit, rel=0.02)
