"""Growing trees: no pass for the last level, forests of folds one at a time."""

import threading

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulens.ml import boosting, models


def test_last_level_follows_from_the_one_above(monkeypatch):
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 200, (5000, 3)).astype(np.uint8)
    y, w = (bins[:, 0].astype(int) * bins[:, 1] + rng.normal(0, 3000, 5000) > 9000).astype(float), rng.uniform(0.5, 2, 5000)
    passes, plain = [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda *a: passes.append(1) or plain(*a))
    found = boosting.grow_here(boosting.Fit(4, 3, 0.3), bins, y, w, np.arange(5000))
    assert len(passes) == 4 * 3
    margin = np.full(5000, found.start)
    for t in range(4):
        at, p = boosting.leaves(bins, found.feature[t], found.cut[t]), 1 / (1 + np.exp(-margin))
        for leaf in np.unique(at):
            own = at == leaf
            value = -0.3 * (w * (p - y))[own].sum() / ((w * p * (1 - p))[own].sum() + boosting.PENALTY)
            assert found.value[t][leaf] == pytest.approx(value, abs=1e-9)
        margin += found.value[t][at]


def test_one_forest_at_a_time(spark, monkeypatch):
    df = spark.range(300).select("id", (F.col("id") % 2).cast("double").alias("label"), array_to_vector(F.array((F.col("id") % 5).cast("double"))).alias("features"),
                                 (F.col("id") % 3).cast("int").alias("fold"), F.lit(1.0).alias("weight")).cache()
    running, most, lock, plain = [0], [0], threading.Lock(), models.fit_one

    def fit(*a):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return plain(*a)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(models, "fit_one", fit)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=3, maxDepth=2, seed=1)
    assert models.cross_validate(forest, df, 3, folded=df).first()["cv_folds"] == 3 and most[0] == 1
