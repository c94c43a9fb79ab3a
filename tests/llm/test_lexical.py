"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from tabulens.llm import lexical
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.ascii_lower(text or ""))


def plain(docs, items):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        own, scored = Counter(plain_terms(text)), []
        for i, b, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // length
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t, k in own.items() if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(str(item), k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:10])]
    return sorted(out, key=str)


def rows_of(df):
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_whole_table_against_every_document(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 3000)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(lexical.ranked_search(docs, items)) == want
    monkeypatch.setattr(lexical, "ITEMS", 9)
    assert rows_of(lexical.ranked_search(docs, items)) == want


def test_edges_of_the_input(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("a b c d É é x9".split()) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    docs += [(3, "a b"), (3, "a b"), (None, "rare a"), (None, "rare a"), (70, None), (71, ""), (72, "-- \x00 !"), (73, "b " * 50_000), (74, "rare a")]
    items = [(1, "A a b"), (1, "A a b"), (1, "c"), (None, "rare"), (2, None), (3, ""), (4, "nowhere"), (5, "é É x9 d"), (6, " ".join(f"t{i}" for i in range(200)) + " a")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, terms string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert rows_of(lexical.ranked_search(d, q)) == plain(docs, items)
    assert lexical.ranked_search(d.limit(0), q).count() == 0 and lexical.ranked_search(d, q.limit(0)).count() == 0
    assert lexical.ranked_search(d, q.filter("text IS NULL")).count() == 0


def test_masks_below_the_tenth_score_are_left_alone():
    rng = np.random.default_rng(2)
    gains = np.where(rng.random((12, 4000)) < 0.15, rng.integers(1, 100, (12, 4000)), 0)
    worth, ids = rng.integers(1, 1000, 12), np.arange(4000)
    best = lexical.Best()
    scored = lexical.judge(gains, worth, ids, best)
    scores = worth @ gains
    order = np.lexsort((ids, -scores))[:10]
    assert (best.scores == scores[order]).all() and (best.ids == ids[order]).all() and scored < 1000
    masks, of = lexical.masks_of(gains > 0)
    assert (masks[of].T == (gains > 0)).all() and len(np.unique(masks, axis=0)) == len(masks)
