"""Fits on many rows: boosted trees in a task, a block of rows at a time; the SVM without a written map; folds without models on the driver; failures."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulens.catalog import modelling
from tabulens.ml import boosting, forest, models, neighbours
from tabulens.ml.metrics import cells_of, metrics_of


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(6)
    made = [(i, float(a * b > 0.1), [float(a), float(b)], float(1 + i % 3), i % 3) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(made, "id long, label double, v array<double>, weight double, fold int")
    return df.withColumn("features", array_to_vector("v")).withColumn("positive_weight", F.lit(2.0)).repartition(3).cache()


def test_a_fit_in_a_task_works_on_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    bins = np.column_stack([rng.integers(0, k, 3000) for k in (200, 5, 7)]).astype(np.uint8)
    y, w, ids = (bins[:, 0] + rng.normal(0, 40, 3000) > 100).astype(float), rng.uniform(0.5, 2, 3000), np.arange(3000)
    fit = boosting.Fit(4, 4, 0.3, "weight", 0.8)
    whole, sizes, plain = boosting.grow_here(fit, bins, y, w, ids), [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda *a: sizes.append(len(a[3])) or plain(*a))
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 256)
    parts = boosting.grow_here(fit, bins, y, w, ids)
    assert max(sizes) <= 256
    assert (whole.feature == parts.feature).all() and (whole.cut == parts.cut).all() and np.abs(whole.value - parts.value).max() < 1e-9


@pytest.mark.parametrize("rows, width, task", [(4_800_000, 9, True), (10_000_001, 2, False), (5_000_000, 60, False)])
def test_a_training_of_millions_fits_a_task(monkeypatch, rows, width, task):
    table = SimpleNamespace(count=lambda: rows, withColumn=lambda *a: table)
    monkeypatch.setattr(boosting, "_boost_in_tasks", lambda t, fits, w: [True for _ in fits])
    monkeypatch.setattr(boosting, "_boost_in_step", lambda t, fits, w: [False for _ in fits])
    monkeypatch.setattr(boosting.F, "lit", lambda v: v)
    assert boosting.boost(table, [boosting.Fit(2, 2, 0.1)] * 2, width) == [task] * 2


def test_a_large_table_is_mapped_on_the_way(train, monkeypatch):
    small, names, plain = models.KernelModel.fit(train), [], models.written
    monkeypatch.setattr("tabulens.plans.workspace.SMALL_WAVES", 0)
    for module in (models, models.written_for_fitting.__globals__):
        put = monkeypatch.setitem if isinstance(module, dict) else monkeypatch.setattr
        put(module, "written", lambda df, name="step": names.append((name, df.columns)) or plain(df, name))
    large = models.KernelModel.fit(train)
    assert [n for n, columns in names if "mapped" in columns] == []
    a, b = (metrics_of(cells_of(m.transform(train), "label", "prediction")) for m in (small, large))
    assert all(abs(a[k] - b[k]) < 0.02 for k in a)


def test_forests_of_folds_make_no_model(train, monkeypatch):
    estimator = models.registry(400, 2, 5, 4)["Random Forest"]
    expected = [metrics_of(cells_of(estimator.fit(train.filter(F.col("fold") != k)).transform(train.filter(F.col("fold") == k)), "label", "prediction"), "weighted") for k in range(3)]
    monkeypatch.setattr(forest, "_model", None)
    found = models.cross_validate(estimator, train, 3, folded=train).first()
    assert found["cv_f1_mean"] == round(sum(e["f1"] for e in expected) / 3, 4)


def test_points_reach_the_driver_as_numbers(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i), float(i % 4)]) for i in range(40)], "id long, vec array<double>")
    monkeypatch.setattr(type(points), "toPandas", None)
    pairs = neighbours.knn(points, points, 2, skip_self=True).collect()
    assert len(pairs) == 80 and {r["nid"] for r in pairs if r["qid"] == 0} == {1, 2}
    assert neighbours.knn(points, points.limit(0), 2).count() == 0


def test_a_failed_model_is_no_shorter_board(spark, monkeypatch):
    board = spark.createDataFrame([(1, "XGBoost")], "rank int, model string")
    monkeypatch.setattr(modelling, "_trained", lambda *a: SimpleNamespace(board=board, failures={"CatBoost": "ValueError: no"}))
    with pytest.raises(RuntimeError, match="CatBoost: ValueError: no"):
        modelling.leaderboard_rows(spark, "")
    monkeypatch.setattr(modelling, "_trained", lambda *a: SimpleNamespace(board=board, failures={}))
    assert modelling.leaderboard_rows(spark, "").count() == 1
