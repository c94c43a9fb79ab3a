"""Deleted interpolation against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.llm import interpolation as lm
from tabulens.llm.queries import Q
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*brute.words(text), None]


def plain(docs, train, fold, order=2):
    """{(id, text): (n_tokens, n_known, base, score)} with the weights fitted token by token on exact ratios."""
    grams = lambda t: [tuple((["<"] * order + t)[i + order - k + 1:i + order + 1]) for i in range(len(t)) for k in (1,)]
    count, ctx = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for i, t in docs:
        if train(i):
            padded = ["<"] * (order - 1) + tokens(t)
            for at in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    g = tuple(padded[at - k + 1:at + 1])
                    count[k][g] += 1
                    ctx[k][g[:-1]] += 1
    total, kinds = sum(count[1].values()), len(count[1])

    def parts(t, less):
        padded = ["<"] * (order - 1) + tokens(t)
        for at in range(order - 1, len(padded)):
            p, has, first = [], [], None
            for k in range(order, 0, -1):
                g = tuple(padded[at - k + 1:at + 1])
                under = ctx[k][g[:-1]] - less
                first = under if first is None else first
                p.append((count[k][g] - less) / under if under > 0 else 0.0)
                has.append(under > 0)
            yield [*p, 1 / (kinds + 1)], [*has, True], 1 + int(math.log2(first)) if first > 0 else 0

    events = [x for i, t in docs if train(i) and fold(i) for x in parts(t, 1)]
    m = order + 1
    pooled = [1 / m] * m
    for _ in range(lm.ROUNDS if events else 0):
        sums = [0.0] * m
        for p, _, _ in events:
            q = [a * b for a, b in zip(p, pooled)]
            for j in range(m):
                sums[j] += q[j] / sum(q)
        pooled = [s / sum(sums) for s in sums]
    weights = {b: pooled for b in range(lm.BUCKETS)}
    for _ in range(lm.ROUNDS if events else 0):
        sums = {b: [lm.PRIOR_EVENTS * x for x in pooled] for b in range(lm.BUCKETS)}
        for p, _, b in events:
            q = [x * y for x, y in zip(p, weights[b])]
            for j in range(m):
                sums[b][j] += q[j] / sum(q)
        weights = {b: [x / sum(s) for x in s] for b, s in sums.items()}
    out = {}
    for i, t in docs:
        score = 0.0
        for p, has, b in parts(t, 0):
            w = [x * h for x, h in zip(weights[b], has)]
            score += math.log10(sum(x * y for x, y in zip(w, p)) / sum(w))
        base = sum(math.log10((count[1][(x,)] + 1) / (total + kinds + 1)) for x in tokens(t))
        out[i, t] = (len(tokens(t)), sum(count[1][(x,)] > 0 for x in tokens(t)), base, score)
    return out, total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match(spark, monkeypatch, order):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").orderBy("doc_id").limit(80).collect()]
    docs += [(5000, None), (5001, ""), (5002, "NEVER seen words É"), (5003, "the the the"), (5003, "the the the"), (None, "the of")]
    train = lambda i: i is not None and brute.remainder(i, 7) != 2
    fold = lambda i: brute.remainder(i, 7) == 0
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, score string").repartition(3)
    r = F.crc32(F.col("doc_id").cast("string")) % 7
    got = lm.interpolated_scores(df, r != 2, r == 0, order=order).collect()
    want, total = plain(docs, train, fold, order)
    assert len(got) == len(docs) and {x.train_tokens for x in got} == {total}
    rows = sorted(got, key=lambda x: (str(x.doc_id), x.n_tokens))
    for x, d in zip(rows, sorted(docs, key=lambda d: (str(d[0]), len(tokens(d[1]))))):
        n, known, base, score = want[d]
        assert (str(x.doc_id), x.n_tokens, x.n_known) == (str(d[0]), n, known)
        assert x.base_score == pytest.approx(base, abs=1e-6) and x.score == pytest.approx(score, rel=5e-3)


def test_small_blocks_agree_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r.doc_id: r for r in Q["op7_lm_score"](spark, SF).collect()}
    r = F.crc32(F.col("doc_id").cast("string")) % 7
    two = lm.interpolated_scores(docs.repartition(16), r != 2, r == 0).collect()
    assert len(one) == len(two) == docs.count()
    for x in two:
        assert x.score == pytest.approx(one[x.doc_id].score, rel=1e-6) and x.base_score == pytest.approx(one[x.doc_id].base_score, rel=1e-9)
    assert lm.interpolated_scores(docs.limit(0), r != 2, r == 0).count() == 0
    none = lm.interpolated_scores(docs.limit(3), F.lit(None).cast("boolean"), r == 0).collect()
    assert all(x.train_tokens == 0 and x.base_score == 0 for x in none)


def test_better_than_base_on_held_out(spark):
    rows = [r for r in Q["op7_lm_score"](spark, SF.replace("0.001", "0.01")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(brute.remainder(r.doc_id, 7) == 2 for r in rows)


def test_packing():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, np.uint64))
    assert (lm.unpack_sorted(lm.pack_sorted(x)) == x).all() and (lm.unpack(lm.pack(x)) == x).all() and len(lm.unpack(lm.pack(x[:0]))) == 0
