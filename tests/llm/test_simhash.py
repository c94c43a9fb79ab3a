"""SimHash links against all pairs of fingerprints."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from tabulens.llm import simhash
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def plain_print(text):
    w = brute.words(text)
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{(doc_id, fingerprint): smallest id reachable} over rows of (doc_id, fingerprint)."""
    nodes = sorted({p for _, p in prints})
    root = {p: p for p in nodes}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return {(i, p): least.get(find(p)) for i, p in prints}


def check(rows, texts):
    prints = [(i, plain_print(t)) for i, t in texts]
    want = plain_components(prints)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == sorted((str(i), f"{p:016x}", str(want[i, p])) for i, p in prints)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_masks_cover_every_pair():
    rng = random.Random(1)
    for masks, free in [(simhash.MASKS, range(64)), *[(s, [p for p in range(64) if not m >> p & 1]) for m, s in zip(simhash.MASKS, simhash.FINER)]]:
        for _ in range(3000):
            flip = sum(1 << p for p in rng.sample(list(free), rng.randint(1, 3)))
            assert any(not flip & m for m in masks)
    assert simhash.FREE <= 16 and min(m.bit_count() for m in simhash.MASKS) >= 32


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = simhash.simhash_duplicates(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert len({r.component_id for r in rows}) < len(rows)


def test_edges_of_the_input(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 100)
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(3000))
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "oNE"), (6, "one two"), (7, long), (8, long + " x"), (7, long), (7, "one"), (None, "one"), (None, None),
             (None, "no other has these words"), (9, "É é"), (10, "é é"), (11, "x " * 5000), (12, "a" * 100_000)]
    make = lambda rows: spark.createDataFrame([(i, t, "k", "f", 5) for i, t in rows], "doc_id long, text string, kept string, fp string, bucket int")
    check(simhash.simhash_duplicates(make(texts)).collect(), texts)
    check(simhash.simhash_duplicates(make([(5, "alone")])).collect(), [(5, "alone")])
    assert simhash.simhash_duplicates(make([])).count() == 0


def test_refined_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(120):  # a chain of small steps, so that most of it shares its buckets
            prints.add(p)
            p ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 7])))
    base = rng.getrandbits(64)
    prints |= {base ^ sum(1 << b for b in rng.sample(range(20), 3)) for _ in range(400)}
    nodes = spark.createDataFrame([(simhash._long(p),) for p in prints], "fp long")
    links = simhash.fingerprint_links(nodes, len(prints)).collect()
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in links:
        a, b = r.a % 2**64, r.b % 2**64
        root[find(a)] = find(b)
    want = plain_components([(p, p) for p in prints])
    groups = {}
    for p in prints:
        groups.setdefault(want[p, p], set()).add(find(p))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(p) for p in prints})


def test_forest_reaches_every_node():
    nodes = np.array([0, 7, 7 << 3, (7 << 3) | (7 << 6), 1 << 40, -1], np.int64)
    a, b = simhash.forest(nodes)
    assert set(zip(a.tolist(), b.tolist())) == {(0, 7), (0, 56), (0, 504), (0, 1 << 40)}
