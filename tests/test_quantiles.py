"""Exact quantiles against sorting, in one buffer and by narrowing histograms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockalloc.operators.quantiles import exact_quantiles

POINTS = [0.0, 0.02, 0.5, 0.98, 1.0]


def found(df, **options):
    return {r.g: r.q for r in exact_quantiles(df, ["g"], "x", POINTS, **options).collect()}


@pytest.mark.parametrize("bins", [3, 1024])
def test_histograms_narrow_to_the_sorted_value(spark, bins):
    rng = np.random.default_rng(5)
    groups = {
        "ties": rng.integers(0, 3, 300).astype(float), "same": np.full(70, -0.1), "heavy": np.exp(rng.normal(0, 30, 333)), "signs": rng.normal(0, 1, 200) * 1e308,
        "tiny": rng.integers(0, 9, 120) * 5e-324, "near": 1 + rng.integers(0, 4, 90) * 2.0**-52, "one": np.array([7.0]), None: rng.normal(0, 1, 257),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("ties", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    want, got = found(df, small=1 << 20), found(df, small=0, bins=bins)
    assert want == got and set(got) == set(groups)
    for g, v in groups.items():
        assert got[g][2] == pytest.approx(np.quantile(v / 4, 0.5) * 4, rel=1e-12)


def test_infinities_and_nan_rank_at_the_ends(spark):
    inf, nan = math.inf, math.nan
    rows = [("a", x) for x in (-inf, -inf, -1.0, 2.0, 5.0, inf, nan)] + [("b", x) for x in (inf, inf, -inf)] + [("c", nan)] * 3
    df = spark.createDataFrame(rows, "g string, x double")
    want, got = found(df, small=1 << 20), found(df, small=0, bins=4)
    assert {g: [str(x) for x in q] for g, q in want.items()} == {g: [str(x) for x in q] for g, q in got.items()}


def test_ten_million_values_in_one_group(spark):
    x = F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double") / 7
    df = spark.range(10**7).select(F.lit("hot").alias("g"), x.alias("x"))
    sorted_ = np.sort(df.select("x").toArrow()["x"].to_numpy())
    at = [(len(sorted_) - 1) * p for p in POINTS]
    want = [float(sorted_[int(a)]) if a == int(a) else (math.ceil(a) - a) * sorted_[math.floor(a)] + (a - math.floor(a)) * sorted_[math.ceil(a)] for a in at]
    assert found(df)["hot"] == want


def test_no_rows(spark):
    assert found(spark.createDataFrame([], "g string, x double")) == {}
