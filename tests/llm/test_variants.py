"""Spelling variants against plain string comparison."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabulens.llm import variants

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    import re
    counts = {}
    for i, text in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            run = m[0].translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_near(w, counts):
    out = set()
    for i in range(len(w) + 1):
        out |= {w[:i] + c + w[i:] for c in ALPHABET}
        if i < len(w):
            out |= {w[:i] + c + w[i + 1:] for c in ALPHABET} | {w[:i] + w[i + 1:]}
    return {x for x in out if x != w and x in counts}


def plain(counts):
    near = {w: plain_near(w, counts) for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf, monkeypatch):
    monkeypatch.setattr(variants, "PART", 3000)
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = plain(plain_counts([(r.doc_id, r.text) for r in docs.collect()]))
    assert rows_of(variants.spelling_variants(docs)) == want
    assert any(f for _, f, *_ in want)


def test_dense_words(spark, monkeypatch):
    """Few letters, so that every kind of link, repeated letters and long chains occur; parts of a few words each."""
    monkeypatch.setattr(variants, "PART", 60)
    monkeypatch.setattr(variants, "COUNTED", 7)
    rng = random.Random(2)
    pool = ["".join(rng.choice("abÿ") for _ in range(rng.randint(4, 9))) for _ in range(300)] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aaaaab"]
    rows = [(i, " ".join(rng.choice(pool[:1 + rng.randrange(len(pool))]) for _ in range(300))) for i in range(40)]
    want = plain(plain_counts(rows))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    assert rows_of(variants.spelling_variants(docs)) == want
    assert any(r != w and r != f for w, f, r, *_ in want)


def test_edges_of_the_input(spark):
    long = "ab" * 30_000
    rows = [(1, None), (2, ""), (3, "12 -- "), (None, "Größe größe GRÖßE größen"), (4, "abcde " * 3), (5, f"{long} {long} {long}x"), (5, f"{long} {long}x {long}x"), (6, "stra×ße stra×ße stra×ße straße straße straße")]
    counts = plain_counts(rows)
    got = {r.word: r for r in variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {w: r.n for w, r in got.items()} == counts
    assert got[long].n_near == 1 and got["stra×ße"].n_near == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(empty).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


def test_node_numbers_name_prefixes(spark, monkeypatch):
    """Equal numbers for equal prefixes and for no others, across the borders of parts."""
    monkeypatch.setattr(variants, "PART", 25)
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(300)} | {"aaaa" + x * 9 for x in "abab"})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    for key, text in ((F.col("word"), str), (F.reverse("word"), lambda w: w[::-1])):
        found = variants.trie_nodes(df, key, sum(map(len, words))).collect()
        names, ranks = {}, []
        for r in found:
            w = text(r.word)
            assert len(r.nodes) == len(w)
            for i, node in enumerate(r.nodes):
                assert names.setdefault(node, w[:i + 1]) == w[:i + 1] and node != 0
            ranks.append((r["rank"], w))
        assert len(names) == len(set(names.values()))
        assert [w for _, w in sorted(ranks)] == sorted(w for _, w in ranks)
