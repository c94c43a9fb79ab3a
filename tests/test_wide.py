"""Distinct counts, correlations and densities of many columns against plain numpy."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabulens.operators import charts, facts, stats


def plan(df):
    return df._jdf.queryExecution().toString()


def test_distinct_counts_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(facts, "HELD_VALUES", 20)
    rng = random.Random(1)
    rows = [(rng.randrange(90), rng.choice([0.0, -0.0, 1.5, float("nan"), float("inf"), None]), rng.choice(["a", "A", "", None, "é", "x" * 70 + str(rng.randrange(30))]),
             rng.choice([True, False, None]), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a long, b double, c string, d boolean, e int").withColumns(
        {"f": F.col("a").cast("decimal(10,2)"), "g": F.timestamp_seconds("a"), "h": F.to_date(F.timestamp_seconds(F.col("a") * 20000)), "i.j": F.col("a") % 7}).repartition(5)
    names = df.columns
    want = df.agg(*[F.count_distinct(facts.present(df, c)).alias(f"x{i}") for i, c in enumerate(names)]).first()
    assert facts.exact_distinct(df, names) == {c: want[i] for i, c in enumerate(names)}
    assert facts.exact_distinct(df.limit(0), ["a", "c"]) == {"a": 0, "c": 0} and facts.exact_distinct(df, []) == {}


def test_correlations_with_holes(spark):
    rng = np.random.default_rng(2)
    n, width = 400, 130
    x = rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) * 10.0 ** rng.integers(-3, 6, width) + 1e4 * (rng.random(width) < 0.2)
    x[:, 5], x[:, 6] = 3.7, np.where(np.arange(n) < n // 2, 0.1, np.nan)
    x[rng.random((n, width)) < 0.2] = np.nan
    x[:, 7] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(width)])
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"c{i} double" for i in range(width))).repartition(7)
    got = stats.correlations(df, df.columns)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    got = {(r.pos_x, r.pos_y): r.r for r in got.collect()}
    want = pdf.corr(min_periods=1).to_numpy()
    assert len(got) == width * (width + 1) // 2
    for (i, j), r in got.items():
        w = want[i, j]
        if 5 in (i, j) or 6 in (i, j) or 7 in (i, j) or np.isnan(w):
            assert r is None, (i, j, r)
        else:
            assert abs(r - w) < 1e-6, (i, j, r, w)
    few = stats.correlations(df.limit(0), ["c0", "c1"]).collect()
    assert sorted((r.col_x, r.col_y, r.r) for r in few) == [("c0", "c0", None), ("c0", "c1", None), ("c1", "c1", None)]


def test_density_is_the_sum_over_all_rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(5, 2, 1500), np.r_[rng.exponential(1e-3, 1499), 40.0]
    rows = [(float(x), float(y), 4.0, None) for x, y in zip(a, b)] + [(None, float("inf"), 4.0, None), (float("nan"), None, 4.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, nothing double").repartition(4)
    for cut in (0.0, 3.0):
        got = charts.density_curve(df, df.columns, points=50, cut=cut).collect()
        assert {r.column for r in got} == {"a", "b"} and len(got) == 100
        for name, v in (("a", a), ("b", b)):
            h = v.std(ddof=1) * len(v) ** -0.2
            for r in (r for r in got if r.column == name):
                x = v.min() - cut * h + r.point * (v.max() - v.min() + 2 * cut * h) / 49
                want = np.exp(-((x - v) / h) ** 2 / 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
                assert abs(r.x - x) <= 1e-9 * max(1, abs(x)) and abs(r.density - want) <= 1e-9 / h, (name, r, want)
    assert charts.density_curve(df.limit(0), ["a"]).count() == 0
