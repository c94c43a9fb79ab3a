"""The boosted models of a training share their passes."""

import numpy as np
from pyspark.sql import functions as F

from tabulens.ml import boosting, models


def test_models_grow_in_the_same_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    made = [(i, float(a * b > 0.1), [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(made, "id long, label double, v array<double>").select("id", "label", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    passes, plain = [], boosting._level_sums
    monkeypatch.setattr(boosting, "_level_sums", lambda *a: passes.append(1) or plain(*a))
    monkeypatch.setattr(boosting, "TASK_CELLS", 0)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    names = ["Gradient Boosting", "XGBoost", "LightGBM", "CatBoost"]
    t = models.train_supervised(df, "label", "id", models=names, rounds=2)
    assert not t.failures and len(passes) == 2 * 6  # rounds times the deepest tree
    for name in names:
        alone, model = models.registry(t.train.count(), 2, 2)[name].fit(t.train), t.results[name]["model"]
        for a, b in zip(alone.ensembles, model.ensembles):
            assert (a.feature == b.feature).all() and np.abs(a.value - b.value).max() < 1e-9


def test_a_failure_of_the_shared_growth_leaves_each_model_its_own(spark, monkeypatch):
    df = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 + F.col("id") / 500).alias("a"))

    def broken(*a):
        raise RuntimeError("no")

    monkeypatch.setattr(models, "fit_all", broken)
    t = models.train_supervised(df, "label", "id", models=["XGBoost", "CatBoost"], rounds=2)
    assert not t.failures and set(t.results) == {"XGBoost", "CatBoost"}
