"""Forests: as many passes for deep trees as for flat ones, the same trees in step as in tasks, splits as a plain search finds them."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulens.ml import forest, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 3] + 0.3 * rng.normal(size=3000) > 0.2).astype(float) + (x[:, 2] > 1.2)
    made = [([float(v) for v in r], float(k), float(r[0] + r[1] ** 2), float(1 + i % 3)) for i, (r, k) in enumerate(zip(x, y))]
    df = spark.createDataFrame(made, "v array<double>, label double, number double, weight double")
    return df.withColumn("features", array_to_vector("v")).repartition(4).cache()


def test_depth_adds_no_jobs(spark, rows):
    context, jobs = spark.sparkContext, []
    for depth in (3, 12):
        context.setJobGroup(f"depth-{depth}", "forest")
        models.registry(3000, rounds=5, full_depth=depth)["Random Forest"].fit(rows)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"depth-{depth}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[1] - jobs[0]) <= 3


@pytest.mark.parametrize("label", ["label", "number"])
def test_in_step_is_the_same_as_in_tasks(spark, rows, monkeypatch, label):
    estimator = (forest.ForestClassifier if label == "label" else forest.ForestRegressor)(labelCol=label, weightCol="weight", numTrees=6, maxDepth=7, maxBins=40, seed=3)
    a = estimator.fit(rows)
    monkeypatch.setattr(forest, "TASK_ROWS", 300)
    monkeypatch.setattr(forest, "SENT_BYTES", 1)  # a tree at a time
    monkeypatch.setattr(forest, "CELLS", 500)
    b = estimator.fit(rows)
    assert a.getNumTrees == b.getNumTrees == 6 and abs(a.totalNumNodes - b.totalNumNodes) <= 6
    assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), atol=1e-3)
    same = a.transform(rows).select("v", F.col("prediction").alias("p")).join(b.transform(rows).select("v", "prediction"), "v")
    assert same.filter(F.abs(F.col("p") - F.col("prediction")) > 1e-6).count() <= 15  # sums of another order may break a tie


def test_splits_are_the_best_of_a_plain_search():
    rng = np.random.default_rng(2)
    bins, y, w = rng.integers(0, 6, (400, 3)).astype(np.uint8), rng.integers(0, 3, 400).astype(np.int32), rng.uniform(0.5, 2, 400)
    for classes, label in ((3, y), (0, y + rng.normal(size=400))):
        g = forest.Growth(1, 1, 3, 6, classes, 3, 1)
        found = forest.finish(g, 0, 0, bins, label, np.ones(400, np.uint8), w)

        def mixed(own):
            if classes:
                p = np.bincount(label[own], w[own], 3) / w[own].sum()
                return 1 - (p**2).sum()
            m = np.average(label[own], weights=w[own])
            return np.average((label[own] - m) ** 2, weights=w[own])

        gains = {}
        for j in range(3):
            for c in range(5):
                left = bins[:, j] <= c
                if left.any() and not left.all():
                    gains[j, c] = mixed(left | True) - sum(w[s].sum() / w.sum() * mixed(s) for s in (left, ~left))
        best = max(gains, key=gains.get)
        assert (found["feature"].iloc[0], found["cut"].iloc[0]) == best and found["gain"].iloc[0] == pytest.approx(gains[best])
        assert found["raw"].tolist()[0] == 400 == sum(found["raw"].tolist()[1:])


def test_bags_and_thresholds_and_one_class(spark, rows):
    counts = np.array([c for _, c in forest.drawn(7, 20_000, [0, 1, 5], 3)])
    assert np.allclose(counts.mean(axis=1), 1, atol=0.03) and np.allclose(counts.var(axis=1), 1, atol=0.06)
    assert abs(np.corrcoef(counts)[0, 1]) < 0.03
    assert (counts[1][5:] == next(forest.drawn(12, 19_995, [1], 3))[1]).all()  # a row is drawn alike in any block
    few = spark.createDataFrame([([1.0, 7.0], 1.0), ([2.0, 7.0], 1.0), ([4.0, 7.0], 1.0)], "v array<double>, w double")
    assert [e.tolist() for e in forest.thresholds(few, 2, 32, 3, 1)] == [[1.5, 3.0], []]
    one = models.registry(3000, rounds=3, full_depth=4)["Random Forest"].fit(rows.withColumn("label", F.lit(1.0)))
    assert one.transform(rows).filter("prediction <> 1").count() == 0
    with pytest.raises(ValueError):
        models.registry(3000, rounds=3)["Random Forest"].fit(rows.limit(0))
