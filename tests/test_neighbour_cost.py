"""Neighbours: exact on odd points, without measuring most pairs, holding all pairs or sending all classes to the driver."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tabulens.ml import neighbours


def brute(q, qid, p, pid, k, skip_self):
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(2))
    if skip_self:
        d[qid[:, None] == pid[None]] = np.inf
    order = [np.lexsort((pid, row))[:k] for row in d]
    return [[int(pid[j]) for j in o if d[i, j] < np.inf] for i, o in enumerate(order)]


@pytest.mark.parametrize("kind", ["plain", "grid", "copies", "one"])
@pytest.mark.parametrize("skip_self", [True, False])
def test_nearest_is_exact(kind, skip_self, monkeypatch):
    monkeypatch.setattr(neighbours, "HELD_PAIRS", 3000)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 40)
    rng = np.random.default_rng(3)
    x = {"plain": rng.normal(size=(700, 3)), "grid": rng.integers(0, 4, (700, 3)).astype(float), "copies": np.ones((700, 2)), "one": np.ones((1, 2))}[kind]
    ids = rng.permutation(len(x))
    points = neighbours.Points(x, ids)
    got = {int(i): points.pid[rows].tolist() for i, rows, _ in neighbours.nearest(x, ids, points, 5, skip_self)}
    assert [got.get(i, []) for i in range(len(x))] == brute(x, ids, x, ids, 5, skip_self)


def test_few_pairs_are_measured(monkeypatch):
    x = np.random.default_rng(1).normal(size=(60_000, 2))
    pairs, plain = [], neighbours._measured
    monkeypatch.setattr(neighbours, "_measured", lambda q, qid, points, seen, *rest: pairs.append((seen * points.sizes).sum()) or plain(q, qid, points, seen, *rest))
    assert sum(1 for _ in neighbours.nearest(x[:3000], np.arange(3000), neighbours.Points(x, np.arange(60_000)), 5, True)) == 3000
    assert sum(pairs) < 0.1 * 3000 * 60_000


def test_memory_does_not_follow_the_points():
    x = np.random.default_rng(2).normal(size=(100_000, 4))
    points = neighbours.Points(x, np.arange(len(x)))
    tracemalloc.start()
    assert sum(1 for _ in neighbours.nearest(x[:2000], np.arange(2000), points, 5, True)) == 2000
    assert tracemalloc.get_traced_memory()[1] < 100e6  # 256 queries by all points are 200 MB
    tracemalloc.stop()


def test_lists_of_blocks_come_in_parts():
    x, blocks = np.zeros((5000, 2)), np.arange(300)
    b = pd.DataFrame({"id": range(5000), "vec": list(x), "block": 0, "bound": [1.0] * 4999 + [None]})
    found = list(neighbours._reached(iter([b]), blocks, np.zeros((300, 2)), np.ones((300, 2))))
    assert max(len(f) for f in found) <= neighbours.QUERY_ROWS and sum(len(f) for f in found) == 5000
    assert all(len(row) == 299 for f in found for row in f["blocks"])


def test_classes_share_what_is_sent(spark, monkeypatch):
    limits, plain = [], neighbours.knn
    monkeypatch.setattr(neighbours, "knn", lambda *a, **b: limits.append(b["broadcast_bytes"]) or plain(*a, **b))
    rows = [(i, [float(i % 7), float(i)], min(i % 8, 4)) for i in range(80)]
    made = neighbours.smote(spark.createDataFrame(rows, "id long, vec array<double>, label int"), "label")
    assert len(limits) == 4 and sum(limits) <= neighbours.BROADCAST_BYTES and made.count() == 4 * 30
