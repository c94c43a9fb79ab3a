"""Boosted trees: growing in tasks and in step, staged rounds, folds on one table, saving."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulens.ml import boosting, models
from tabulens.ml.metrics import cells_of, metrics_of


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 3] + 0.3 * rng.normal(size=600) > 0.2).astype(float) + (x[:, 2] > 1.2)
    rows = [(i, float(k), [float(v) for v in r], float(1 + i % 3)) for i, (k, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id long, label double, v array<double>, weight double")
    return df.withColumn("features", array_to_vector("v")).withColumn("positive_weight", F.lit(2.0)).withColumn("fold", (F.col("id") % 3).cast("int")).repartition(4).cache()


def two(train):
    return train.withColumn("label", F.least("label", F.lit(1.0)))


def test_in_step_is_the_same_as_in_tasks(spark, train, monkeypatch):
    monkeypatch.setattr(boosting, "STORED_ROUNDS", 3)
    edges = boosting.bin_edges(train, "features")
    table = boosting.binned(train, edges, "id", "label", "features", ["weight", "fold"])
    fits = [boosting.Fit(5, 3, 0.3, None, 1.0, 1, 0), boosting.Fit(7, 2, 0.1, "weight", 0.8, 2, 2)]
    a, b = boosting.boost(table, fits, 4, "fold"), boosting.boost(table, fits, 4, "fold", task_cells=0)
    for x, y in zip(a, b):
        assert abs(x.start - y.start) < 1e-12 and (x.feature == y.feature).all() and len(x.feature) in (5, 7)
        assert np.abs(x.value - y.value).max() < 1e-9 and (x.cut[x.feature >= 0] == y.cut[y.feature >= 0]).all()


def test_fewer_rounds_are_the_first_trees(train):
    long, short = boosting.Boosting(20, 3, 0.3), boosting.Boosting(8, 3, 0.3)
    a, b = long.fit(two(train)).ensembles[0], short.fit(two(train)).ensembles[0]
    assert (a.feature[:8] == b.feature).all() and (a.value[:8] == b.value).all()
    bins = np.random.default_rng(2).integers(0, 255, (50, 4)).astype(np.uint8)
    assert (a.margins(bins, [20, 8])[1] == b.margins(bins, [8])[0]).all()


@pytest.mark.parametrize("classes", [2, 3])
def test_grid_is_a_plain_search(train, classes):
    df = two(train) if classes == 2 else train
    points = [boosting.Boosting(r, d, s, "weight", u, classes) for r in (6, 12) for d, s, u in ((2, 0.1, 1.0), (3, 0.3, 0.8))]
    counts = boosting.fold_counts(df, points, 3)
    edges = boosting.bin_edges(df, "features")
    for i, p in enumerate(points):
        for k in range(3):
            table = boosting.binned(df.filter(F.col("fold") != k), edges, "id", "label", "features", ["weight"])
            model = boosting.BoostingModel(edges, boosting.boost(table, p.fits(), 4), p.rounds)
            cells = cells_of(model.transform(df.filter(F.col("fold") == k)), "label", "prediction")
            assert {(int(y), int(z)): n for (y, z), n in cells.items()} == counts[i, k]


def test_learns_saves_and_loads(spark, train, tmp_path):
    model = models.registry(600, 3, rounds=40)["XGBoost"].fit(train)
    found = model.transform(train)
    assert metrics_of(cells_of(found, "label", "prediction"))["accuracy"] > 0.97
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9 and model.featureImportances.toArray().min() > 0
    row = found.first()
    assert abs(sum(row.probability) - 1) < 1e-9 and row.probability[int(row.prediction)] == max(row.probability)
    model.save(str(tmp_path / "m"), spark)
    again = models.load_model(spark, "XGBoost", str(tmp_path / "m"), 4).transform(train)
    assert again.select("id", "prediction").exceptAll(found.select("id", "prediction")).count() == 0
    with pytest.raises(Exception):
        models.registry(600)["CatBoost"].fit(train.limit(0))
    one = models.registry(600, rounds=3)["LightGBM"].fit(train.withColumn("label", F.lit(1.0)))
    assert one.transform(train).filter("prediction <> 1").count() == 0


def test_forest_of_the_first_trees(train):
    model = models.registry(600, rounds=12, full_depth=4)["Random Forest"].fit(two(train))
    part = models.first_trees(model, 5)
    assert part.getNumTrees == 5 and model.getNumTrees == 12
    votes = sum(t.predictRaw(r.features).toArray() / t.predictRaw(r.features).toArray().sum() for r in [train.first()] for t in model.trees[:5])
    assert np.allclose(part.predictRaw(train.first().features).toArray(), votes)


def test_tuning_chooses_what_a_plain_search_chooses(train):
    df, base = two(train), boosting.Boosting(5, 2, 0.1, "positive_weight")
    grid = [{"rounds": r, "step": s} for r in (5, 15) for s in (0.05, 0.3)]
    model, params, scores = models.tune(base, grid, df.drop("fold"))
    folded = models.folded_for(df.drop("fold"), 3)
    plain = []
    for p in grid:
        f1 = [metrics_of(cells_of(replace(base, **p).fit(folded.filter(F.col("fold") != k)).transform(folded.filter(F.col("fold") == k)), "label", "prediction"), "weighted")["f1"] for k in range(3)]
        plain.append(sum(f1) / 3)
    assert max(range(4), key=plain.__getitem__) == grid.index(params) and np.abs(np.array(plain) - scores).max() < 0.05  # a plain fit has bins of its own rows
    assert model.rounds == params["rounds"]
