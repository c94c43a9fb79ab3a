"""Near-duplicates against all pairs of full sets."""

import random

import numpy as np
import pytest

from tabulens.llm import near
from tests.llm import brute


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [w, f"n{rng.randrange(10**6)}"] if x < 2 * rate / 3 else [f"r{rng.randrange(10**6)}"] if x < rate else [w]
    return out


def corpus(seed, families, size):
    rng = random.Random(seed)
    shared = [f"common{i}" for i in range(12)]
    docs = []
    for f in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 7, 40, 120]))]
        for _ in range(size):
            w = edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05, 0.08]))
            if rng.random() < 0.3:
                k = rng.randrange(len(w) + 1)
                w[k:k] = shared
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def compare(spark, docs, extra=()):
    rows = near.near_duplicates(spark.createDataFrame([(i, t, "k", 5) for i, t in [*docs, *extra]], "doc_id long, text string, kept string, node int").repartition(5)).collect()
    want = brute.near_components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id in want}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return rows


def test_random_families(spark):
    docs = corpus(1, 30, 8) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "A b"), (9004, "a B"), (9005, "a b c"), (9006, "long " * 20_000), (9007, "É b"), (9008, "é b")]
    rows = compare(spark, docs)
    assert len({r.component_id for r in rows}) < len(rows)


def test_large_group_in_small_chunks(spark, monkeypatch):
    for name, value in (("CHUNK", 16), ("BLOCK", 12), ("QUERIES", 10)):
        monkeypatch.setattr(near, name, value)
    compare(spark, corpus(2, 3, 90))


def test_repeats_and_nulls(spark):
    docs = corpus(4, 5, 5)
    text = docs[0][1]
    rows = near.near_duplicates(spark.createDataFrame([*docs, docs[0], docs[0], (None, text), (None, None), (docs[1][0], "quite other words than before")], "doc_id long, text string")).collect()
    assert len(rows) == len(docs) + 5
    assert len({r.component_id for r in rows if r.doc_id == docs[0][0]}) == 1
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().kept


def test_estimate_is_precise():
    rng = np.random.default_rng(1)
    for j in (0.75, 0.85, 0.95):
        errors = []
        for _ in range(60):
            n = 400
            common = int(round(2 * n * j / (1 + j)))
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[:common], rng.integers(0, 2**63, n - common, dtype=np.uint64)])
            x, y = (np.frombuffer(near.signature(np.unique(s))[1], np.uint64) for s in (a, b))
            errors.append(near.estimated(np.bitwise_count(x ^ y).sum().astype(float)) - j)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.label for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got and all(find(n) == label for n, label in got.items())
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_keep_their_links(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "abc")
    for one, two in ((a, b), (b, a)):  # whichever digest is smaller
        rows = near.near_duplicates(spark.createDataFrame([(5, one), (5, two), (9, two), (12, two + " more"), (20, c), (21, one)], "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(5, 5, True), (5, 5, True), (9, 5, False), (12, 5, False), (20, 20, True), (21, 5, False)]
