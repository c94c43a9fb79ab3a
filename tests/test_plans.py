"""The bounded plan shapes against brute force, with thresholds lowered so that the large-data paths run."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulens.operators import timeseries
from tabulens.plans import order_stats, ordered


def skewed(spark, n=600, seed=3):
    """One key holds a third of the rows and values have long runs of nulls."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, 7, rng.integers(100, 140, n))
    value = np.where(rng.random(n) < 0.7, np.nan, rng.normal(50, 10, n).round(3))
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "t": rng.integers(0, n // 3, n), "v": value})
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).cache()


@pytest.mark.parametrize("values", [
    np.random.default_rng(0).normal(0, 1, 5000),
    np.repeat([1.0, 2.0], [1700, 3300]),
    np.concatenate([np.full(2000, 5.0), np.random.default_rng(1).exponential(1e6, 3001), [-1e12, 1e12]]),
    np.array([3.0]),
])
def test_quantiles_by_brackets(spark, monkeypatch, values):
    monkeypatch.setattr(order_stats, "ACCURACY", 50)
    monkeypatch.setattr(order_stats, "BRACKET_VALUES", 40)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    p = [0.0, 0.08, 0.25, 0.5, 0.75, 1.0]
    got = order_stats.exact_quantiles(df, {"v": F.col("v")}, p, small_values=0)["v"]
    assert np.allclose(got, np.quantile(values, p), rtol=1e-12, atol=1e-12)
    assert order_stats.exact_quantiles(df, {"v": F.col("v")}, p)["v"] == pytest.approx(list(np.quantile(values, p)))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    for small in (0, 100):
        assert order_stats.exact_quantiles(df, {"v": F.col("v")}, [0.5], small_values=small)["v"] == [None]


def test_kth_reports_rows_below(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "ACCURACY", 20)
    v = sorted([1, 1, 1, 2, 3, 3, 8] * 30 + list(range(200)))
    df = spark.createDataFrame([(x,) for x in v], "v long")
    targets = {k: (F.col("v"), k, len(v)) for k in (1, 60, 91, 200, len(v))}
    for k, (value, below) in order_stats.kth_values(df, targets, bracket_values=10).items():
        assert value == v[k - 1] and below == sum(x < value for x in v)


SIZES = {"hot_rows": 60, "range_rows": 17}


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("keys", [["k"], []])
def test_windows_across_ranges(spark, keys):
    df = skewed(spark)
    order = ["t", "id"]

    def build(w):
        return {"mean": F.round(F.avg("v").over(w.rowsBetween(-4, 0)), 9), "n": F.count(F.lit(1)).over(w.rowsBetween(-4, 0)),
                "lag1": F.lag("v", 1).over(w), "lag4": F.lag("id", 4).over(w)}

    plain = ordered.with_windows(df, keys, order, build, 4)
    cut = ordered.with_windows(df, keys, order, build, 4, **SIZES)
    assert "Window" in plain._jdf.queryExecution().toString() and same(plain, cut)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("ahead", [True, False])
def test_fills_across_ranges(spark, keys, ahead):
    df = skewed(spark)
    plain = ordered.fill_ordered(df, keys, ["t", "id"], {"v": ("v", ahead)})
    cut = ordered.fill_ordered(df, keys, ["t", "id"], {"v": ("v", ahead)}, **SIZES)
    assert same(plain, cut)
    extra = ordered.fill_ordered(df, keys, ["t", "id"], {"w": ("v", ahead)}, **SIZES)
    assert same(plain.withColumnRenamed("v", "w").select("id", "w"), extra.select("id", "w"))


def test_null_key_can_be_hot(spark):
    df = skewed(spark).withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    build = lambda w: {"lag": F.lag("id", 2).over(w)}
    assert same(ordered.with_windows(df, ["k"], ["t", "id"], build, 2), ordered.with_windows(df, ["k"], ["t", "id"], build, 2, **SIZES))
    assert same(ordered.fill_ordered(df, ["k"], ["t", "id"], {"v": ("v", True)}), ordered.fill_ordered(df, ["k"], ["t", "id"], {"v": ("v", True)}, **SIZES))


def test_running_sums_across_ranges(spark):
    df = skewed(spark)
    order = [F.col("t").desc(), F.col("id")]
    order = [-F.col("t"), F.col("id")]
    plain = ordered.running_sums(df, order, {"s": F.col("id")})
    cut = ordered.running_sums(df, order, {"s": F.col("id")}, small_rows=10, range_rows=23)
    assert same(plain, cut)
    numbered = ordered.row_numbers(df, order, "rn", small_rows=10, range_rows=23)
    expected = df.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))
    assert same(expected, numbered)


def test_engineering_is_the_same_on_a_hot_key(spark):
    df = skewed(spark)
    plain, _ = timeseries.engineer_features(df, ["t", "id"], ["k"], numeric_cols=["v"])
    cut, _ = timeseries.engineer_features(df, ["t", "id"], ["k"], numeric_cols=["v"], **SIZES)
    num = [c for c in plain.columns if c != "id"]
    a = plain.select("id", *[F.round(c, 8).alias(c) for c in num])
    assert same(a, cut.select("id", *[F.round(c, 8).alias(c) for c in num]))


def test_order_is_required(spark):
    with pytest.raises(ValueError):
        timeseries.add_lags(skewed(spark), "v", ["k"], [])
