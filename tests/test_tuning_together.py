"""Tuning: all boosted grids share one growth, the depths of a forest share one forest, rows are added up for one side of a split."""

import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulens import fixed_values as fv
from tabulens.ml import boosting, forest, models
from tabulens.ml.metrics import cells_of


@pytest.fixture
def train(spark):
    rng = np.random.default_rng(5)
    made = [(i, float(a * b + 0.1 * c > 0.2), [float(a), float(b), float(c)], 1.0 + i % 3) for i, (a, b, c) in enumerate(rng.normal(size=(900, 3)))]
    df = spark.createDataFrame(made, "id long, label double, v array<double>, weight double").withColumn("positive_weight", F.lit(2.0))
    return df.withColumn("features", array_to_vector("v")).drop("v").withColumn("fold", (F.col("id") % 3).cast("int"))


def test_grids_of_all_boosted_models_grow_at_once(train, monkeypatch):
    pool = {n: e for n, e in models.registry(900, rounds=4).items() if isinstance(e, boosting.Boosting)}
    grids = {n: [p | {"rounds": r} for p, r in zip(models.tuning_grid(n, e), (2, 2, 4, 4))] for n, e in pool.items()}
    alone = {n: models.tune(pool[n], grids[n], train, folded=train) for n in pool}
    calls, plain = [], boosting.boost
    monkeypatch.setattr(boosting, "boost", lambda *a: calls.append(len(a[1])) or plain(*a))
    together = models.Together(train, train, [(pool[n], grids[n]) for n in pool])
    found, threads = {}, [threading.Thread(target=lambda n=n: found.update({n: models.tune(pool[n], grids[n], train, folded=together)})) for n in pool]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert calls == [4 * 2 * fv.TUNING_FOLDS, 4]
    for n in pool:
        assert found[n][1:] == alone[n][1:]
        for a, b in zip(found[n][0].ensembles, alone[n][0].ensembles):
            assert (a.feature == b.feature).all() and np.abs(a.value - b.value).max() < 1e-9


def test_a_failure_leaves_each_model_its_own_search(train, monkeypatch):
    pool = {n: models.registry(900, rounds=2)[n] for n in ("XGBoost", "CatBoost")}
    grid = [{"rounds": 1}, {"rounds": 2}]

    def broken(*a):
        raise RuntimeError("no")

    monkeypatch.setattr(models.Together, "_all", broken)
    together = models.Together(train, train, [(e, grid) for e in pool.values()])
    assert all(len(models.tune(e, grid, train, folded=together)[2]) == 2 for e in pool.values())


def test_depths_and_sizes_are_cut_from_one_forest(train, monkeypatch):
    monkeypatch.setattr(forest, "TASK_ROWS", 400)
    base = forest.ForestClassifier(labelCol="label", weightCol="weight", numTrees=7, maxDepth=6, seed=3)
    points = [base.copy({base.numTrees: n, base.maxDepth: d}) for n in (4, 7) for d in (6, 3)]
    own, held = train.filter("fold <> 0"), train.filter("fold = 0")
    alone = [e.fit(own) for e in points]
    grown, plain = [], forest._grown
    monkeypatch.setattr(forest, "_grown", lambda *a: grown.append(1) or plain(*a))
    for a, b in zip(alone, forest.forests(points, own)):
        assert a.toDebugString.split("\n", 1)[1] == b.toDebugString.split("\n", 1)[1] and a.getNumTrees == b.getNumTrees
    assert forest.held_cells(points, own, held) == [cells_of(m.transform(held), "label", "prediction") for m in alone]
    assert len(grown) == 2
    models.grid_scores(base, [{"numTrees": n, "maxDepth": d} for n in (4, 7) for d in (6, 3)], train, 3)
    assert len(grown) == 2 + 3


def test_one_side_of_a_split_is_added_up(monkeypatch):
    rng = np.random.default_rng(6)
    bins = np.column_stack([rng.integers(0, n, 4000) for n in (5, 200, 7, 1, 30, 256)]).astype(np.uint8)
    y = (bins[:, 1] * 1.0 + 9 * bins[:, 2] + rng.normal(0, 20, 4000) > 150).astype(float)
    seen, plain = [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda *a: seen.append(len(a[3])) or plain(*a))
    fit = boosting.Fit(3, 4, 0.3, None, 0.8)
    found = boosting.grow_here(fit, bins, y, np.ones(4000), np.arange(4000))
    assert all(n <= 2000 for i, n in enumerate(seen) if i % 4)
    margin = np.full(4000, found.start)
    for number in range(3):
        g, h = boosting._slopes(fit, y, np.ones(4000), margin, np.arange(4000), number)
        tree = boosting.Grower(fit)
        while tree.level < 4:
            at = tree.places(bins)
            tree.split(plain(bins[at >= 0], at[at >= 0], 2**tree.level, g[at >= 0], h[at >= 0]))
        assert (found.feature[number] == tree.feature).all() and (found.cut[number] == tree.cut).all() and np.abs(found.value[number] - tree.value).max() < 1e-9
        margin += tree.value[boosting.leaves(bins, tree.feature, tree.cut)]


def test_fits_in_step_keep_to_the_bound_of_sums(train, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_CELLS", 0)
    monkeypatch.setattr(boosting, "STEP_CELLS", 1)
    sizes, plain = [], boosting._boost_in_step
    monkeypatch.setattr(boosting, "_boost_in_step", lambda t, fits, w: sizes.append(len(fits)) or plain(t, fits, w))
    made = boosting.fit_all([boosting.Boosting(2, 2, 0.1), boosting.Boosting(2, 1, 0.3)], train)
    assert sizes == [1, 1] and [len(m.ensembles[0].feature) for m in made] == [2, 2]
