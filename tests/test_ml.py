"""Preparation, splits, metrics, neighbours, oversampling and detection: brute force and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabulens.ml import metrics, models, neighbours, prep, split, unsupervised
from tabulens.plans import order_stats


def vectors(spark, n=400, d=3, seed=1, copies=0.34):
    """A third of the points are one and the same."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)).round(2)
    x[rng.random(n) < copies] = 0.5
    return x, spark.createDataFrame([(i, row.tolist(), int(i % 3)) for i, row in enumerate(x)], "id long, vec array<double>, label int")


def brute(x, k):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        out += [(i, int(j), r + 1) for r, j in enumerate(np.lexsort((np.arange(len(x)), d))[:k])]
    return out


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_rows": 40}])
def test_neighbours_are_exact(spark, sizes):
    x, df = vectors(spark)
    got = neighbours.knn(df, df, 5, skip_self=True, **sizes)
    assert sorted((r.qid, r.nid, r.rank) for r in got.collect()) == sorted(brute(x, 5))


def test_fewer_points_than_k(spark):
    _, df = vectors(spark, n=3, copies=0)
    assert neighbours.knn(df, df, 5, skip_self=True).count() == 6


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_rows": 20}])
def test_synthetic_rows_lie_between_neighbours(spark, sizes):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (120, 2))
    df = spark.createDataFrame([(i, row.tolist(), int(i < 30), ) for i, row in enumerate(x)], "id long, vec array<double>, label int")
    made = neighbours.smote(df, "label", **sizes).toPandas()
    assert len(made) == 60 and set(made["label"]) == {1} and made["new_id"].is_unique
    for r in made.itertuples():
        a, b = x[r.base_id], x[r.neighbour_id]
        assert r.base_id < 30 and r.neighbour_id < 30 and np.allclose(r.vec, a + r.u * (b - a)) and 0 < r.u < 1


def test_tiny_minorities(spark):
    one = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 0), (2, [3.0], 0)], "id long, vec array<double>, label int")
    assert neighbours.smote(one, "label").count() == 0
    two = spark.createDataFrame([(i, [float(i)], int(i < 2)) for i in range(9)], "id long, vec array<double>, label int")
    assert neighbours.smote(two, "label").count() == 5


def test_split_is_stratified_and_repeatable(spark, monkeypatch):
    df = spark.range(3000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    a = split.stratified_split(df, "y", "id")
    assert {(r.y, r.split): r["count"] for r in a.groupBy("y", "split").count().collect()} == {
        (0, "test"): 540, (0, "train"): 2160, (1, "test"): 60, (1, "train"): 240}
    monkeypatch.setattr(order_stats, "BRACKET_VALUES", 50)
    b = split.stratified_split(df.repartition(5), "y", "id")
    assert a.exceptAll(b).isEmpty()


def test_split_with_colliding_hashes(spark):
    space = 2**32
    df = spark.createDataFrame([(i * space + j, 0) for i in range(50) for j in range(4)], "id long, y int")
    assert {r.split: r["count"] for r in split.stratified_split(df, "y", "id").groupBy("split").count().collect()} == {"test": 40, "train": 160}


def test_folds_are_even(spark):
    df = spark.range(103).withColumn("y", (F.col("id") < 20).cast("int"))
    sizes = split.kfold_assign(df, "y", "id", 5).groupBy("y", "fold").count().collect()
    assert len(sizes) == 10 and {r["count"] for r in sizes if r.y == 1} == {4} and {r["count"] for r in sizes if r.y == 0} <= {16, 17}


def test_sample_is_bounded(spark):
    got = split.bounded_sample(spark.range(500), "id", 40)
    assert got.count() == 40 and split.bounded_sample(spark.range(7), "id", 40).count() == 7


def test_label_codes(spark):
    df = spark.createDataFrame([(v, n) for v, n in zip(["b", None, "a", "b", "c"], [10, 2, 2, 33, 10])], "s string, n int")
    for options in ({}, {"small_rows": 1}):
        d = prep.label_dictionary(df, ["s", "n"], **options)
        codes = {(r.column, r.value): r.code for r in d.collect()}
        assert codes == {("s", "a"): 0, ("s", "b"): 1, ("s", "c"): 2, ("s", "nan"): 3, ("n", "2"): 0, ("n", "10"): 1, ("n", "33"): 2}
        for limit in (0, 1000):
            new = spark.createDataFrame([("zz", 33), ("c", 5)], "s string, n int")
            out = prep.encode(new, d, {"s": 4, "n": 3}, ["s", "n"], broadcast_labels=limit)
            assert sorted(map(tuple, out.collect())) == [(0.0, 2.0), (2.0, 0.0)]


def test_transform_aligns_and_imputes(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "x", 5.0), (3.0, "y", 5.0), (None, "x", 5.0), (5.0, "y", 5.0)], "a double, s string, flat double")
    state = prep.feature_fit(train)
    assert state.medians == {"a": 3.0} and state.spread["flat"] == 1.0
    state.save(spark, str(tmp_path / "state"))
    again = prep.FeatureState.load(spark, str(tmp_path / "state"))
    new = spark.createDataFrame([("new", None, 9)], "s string, a double, extra int")
    for st in (state, again):
        r = prep.feature_transform(new, st).first()
        assert r.a == pytest.approx(0.0) and r.s == pytest.approx(-1.0) and r.flat == pytest.approx(-5.0)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(0, 1)] * 2 + [(1, 0)] + [(0, 0)] * 4, "y int, p int")
    assert tuple(metrics.classification_metrics(df, "y", "p").first()) == (0.7, 0.6, 0.75, 0.6667)
    never = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    assert tuple(metrics.classification_metrics(never, "y", "p").first()) == (0.5, 0.0, 0.0, 0.0)
    three = spark.createDataFrame([(0, 0), (1, 2), (2, 2)], "y int, p int")
    assert len(metrics.confusion_matrix(three, "y", "p").collect()) == 9
    assert tuple(metrics.classification_metrics(three, "y", "p").first()) == (0.6667, 0.5, 0.6667, 0.5556)


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    for sizes in ({}, {"small_rows": 1, "range_rows": 2}):
        assert metrics.roc_auc(df, "y", "s", **sizes).first()[0] == pytest.approx(0.875)
        points = metrics.roc_points(df, "y", "s", **sizes).orderBy(F.desc("threshold")).collect()
        assert [(p.fpr, p.tpr) for p in points] == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]


def test_trees_isolate_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (500, 2))
    x[:10] += 9
    df = spark.createDataFrame(pd.DataFrame({"id": range(500), "a": x[:, 0], "b": x[:, 1]}))
    out = unsupervised.consensus_anomaly(df, "id", contamination=0.08, trees=60, steps=15).toPandas().sort_values("id")
    assert list(out.columns) == ["id", "a", "b", *unsupervised.OUTPUTS]
    assert out["if_anomaly"].sum() == pytest.approx(40, abs=2) and out["ocsvm_anomaly"].sum() == pytest.approx(40, abs=2)
    assert out["if_anomaly"][:10].all() and out["if_score"][:10].max() < out["if_score"][10:].mean()
    assert out["ocsvm_score"][:10].mean() < out["ocsvm_score"][10:].mean()
    assert ((out["if_anomaly"] & out["ocsvm_anomaly"]) == out["consensus_anomaly"]).all()


def training_frame(spark, n=400):
    rng = np.random.default_rng(8)
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    y = (a + b > 1.2).astype(int)
    return spark.createDataFrame(pd.DataFrame({"id": range(n), "a": a, "b": b, "c": ["u", "v"] * (n // 2), "y": y}))


def test_every_model_trains_and_saves(spark, tmp_path):
    t = models.train_supervised(training_frame(spark), "y", "id", use_smote=True, rounds=5)
    board = t.board.orderBy("rank").collect()
    assert t.failures == {} and len(board) == 9 and board[0].f1 > 0.8
    for name in t.results:
        t.best = name
        paths = t.save(spark, str(tmp_path / name.replace(" ", "_")))
        loaded = models.load_model(spark, name, paths["model"], len(t.state.features))
        before, after = (metrics.cells_of(m.transform(t.test), "label", "prediction") for m in (t.results[name]["model"], loaded))
        assert before == after, name


def test_three_classes(spark):
    df = training_frame(spark, 300).withColumn("y", F.when(F.col("a") > 0.5, "hi").when(F.col("a") < -0.5, "lo").otherwise("mid"))
    t = models.train_supervised(df, "y", "id", models=["Decision Tree", "Gradient Boosting", "SVM (RBF)", "Logistic Regression"], rounds=3)
    assert t.failures == {} and t.classes == ["hi", "lo", "mid"]
    t.best = "Decision Tree"
    assert {r.y for r in t.predict(df, "id", "y").select("y").distinct().collect()} == {"hi", "lo", "mid"}


def test_a_failing_model_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(models, "NeighbourModel", lambda *_: 1 / 0)
    t = models.train_supervised(training_frame(spark, 100), "y", "id", models=["Decision Tree", "K-Nearest Neighbors"])
    assert list(t.results) == ["Decision Tree"] and "K-Nearest Neighbors" in t.failures


def test_tuning_and_cross_validation(spark):
    t = models.train_supervised(training_frame(spark), "y", "id", models=["Decision Tree"])
    gbt = models.registry(100)["LightGBM"]
    best, params, scores = models.tune(gbt, [{"rounds": r, "depth": d} for r in (2, 3) for d in (1, 2)], t.train)
    assert len(scores) == 4 and set(params) == {"rounds", "depth"} and max(scores) > 0.7
    forest = models.registry(100, rounds=3)["Random Forest"]
    grid = models.ParamGridBuilder().addGrid(forest.numTrees, [2, 4]).addGrid(forest.maxDepth, [2, 3]).build()
    best, params, scores = models.tune(forest, grid, t.train)
    assert len(scores) == 4 and set(params) == {"numTrees", "maxDepth"} and max(scores) > 0.7 and best.getNumTrees == params["numTrees"]
    cv = models.cross_validate(models.registry(100)["Decision Tree"], t.train).first()
    assert cv.cv_folds == 5 and 0.7 < cv.cv_f1_mean <= 1 and cv.cv_f1_std >= 0


def test_baseline(spark):
    df = training_frame(spark).withColumn("a", F.when(F.col("id") % 9 != 0, F.col("a")))
    c = models.train_baseline(df, "id", "y")
    assert c["problem_type"] == "classification" and c["metrics"]["f1"] > 0.7 and set(c["importances"]) == {"a", "c"}  # b is all-unique, so an identifier
    r = models.train_baseline(df, "id", "b")
    assert r["problem_type"] == "regression" and set(r["metrics"]) == {"rmse", "r2"}
    assert not models.train_baseline(df.limit(9), "id", "b")["success"]


def test_vectors_are_dense(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),)], ["features"])
    assert len(df.first()["features"]) == 2


def test_lists_reach_their_recall(spark, monkeypatch):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 32)) * 2
    x = middles[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 32))
    x[:300] = x[0]  # a heap of equal rows
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>").repartition(6)
    asked = df.filter("id % 50 = 0")
    exact = neighbours.knn(asked, df, 5, skip_self=True)
    found = neighbours.knn_lists(asked, df, 5, skip_self=True, list_rows=100)
    total = neighbours.recall_of(found, exact).agg(F.sum("n_found") / F.sum("n")).first()[0]
    assert total >= 0.9 and found.groupBy("qid").count().filter("count <> 5").count() == 0
    assert found.join(exact, ["qid", "nid"]).filter(F.abs(found["dist"] - exact["dist"]) > 1e-9).count() == 0
    assert neighbours.knn_lists(asked, df.limit(0), 5).count() == 0 and neighbours.knn_lists(asked.limit(0), df, 5).count() == 0
    assert neighbours.knn_lists(asked, df.filter("id < 3"), 5).groupBy("qid").count().filter("count <> 3").count() == 0


def test_one_class_svm_is_proved_by_its_gap(spark):
    from tabulens.ml.kernel import fourier_map
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 3))
    x[:120] += 6
    x[200:260] = x[200]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in x], "a double, b double, c double").repartition(5)
    nu = 0.08
    fit = unsupervised.fit_one_class(df, ["a", "b", "c"], nu)
    assert fit.gap <= 1e-3 and fit.passes <= 2 * unsupervised.SVM_STEPS + 1
    z = fourier_map(3, 1 / 3, 128, 42)(x)
    margins = z @ fit.weights
    low = np.sort(margins)[:int(nu * len(x))].mean()
    assert (fit.weights @ fit.weights - low) / (fit.weights @ fit.weights) <= 1.2e-3  # the gap, computed from all margins
    assert abs((margins < np.quantile(margins, nu)).mean() - nu) < 0.01
    assert unsupervised.fit_one_class(df.limit(0), ["a", "b", "c"], nu).passes == 1
