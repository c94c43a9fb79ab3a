"""Token counts against plain dynamic programming and a public library; training order by exact round trip."""

import glob
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulens.llm import materialise, tokencounts
from tabulens.llm.queries import Q, TOKENIZERS

SF = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "héllo  wörld 漢字 \U0001F600"), (4, "héllo  wörld 漢字 \U0001F600"), (None, "a b"), (5, "word " * 30_000), (6, "x" * 3000)]


def edge(spark):
    return spark.createDataFrame([(*r, "c", 7) for r in EDGE], "doc_id long, text string, slot string, n_tokens int")


def plain(word, pieces, unknown):
    w = tokencounts.MARK + word
    best = [(0.0, 0)] + [None] * len(w)
    for e in range(1, len(w) + 1):
        options = [(best[s][0] + pieces[w[s:e]], -best[s][1] - 1) for s in range(e) if w[s:e] in pieces]
        if w[e - 1] not in pieces:
            options.append((best[e - 1][0] + unknown, -best[e - 1][1] - len(w[e - 1].encode())))
        s, n = max(options)
        best[e] = (s, -n)
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abcé", min_size=1, max_size=7), min_size=1, max_size=12), st.integers(0, 10**6))
def test_walk_is_the_plain_recursion(words, seed):
    rng = random.Random(seed)
    pieces = {p: -rng.choice([1.0, 2.0, 3.0, 4.5]) for p in ["a", "b", "c", "ab", "bc", "abc", "cab", "aa", tokencounts.MARK, tokencounts.MARK + "a", "bca"] if rng.random() < 0.8}
    got = {w: (s, n) for w, n, s in tokencounts.walk(sorted(words), pieces, 4, -20.0)}
    for w in words:
        s, n = plain(w, pieces, -20.0)
        assert got[w][0] == pytest.approx(s) and got[w][1] == n


def test_counts_match_library(spark):
    from tokenizers import Tokenizer, models

    pieces = tokencounts.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    lib = Tokenizer(models.Unigram([("<unk>", -100.0), *pieces.items()], 0, False))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known = {c for p in pieces for c in p}
    rows = Q["op2_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    compared = 0
    for r in rows:
        words = texts[r.doc_id].split()
        assert r.n_pretokens == len(words)
        if set("".join(words)) <= known and len(words) < 400:
            compared += 1
            assert r.n_tokens == sum(len(e.ids) for e in lib.encode_batch([tokencounts.MARK + w for w in words]))
    assert compared > 50


def test_counts_edges(spark, monkeypatch):
    pieces = {tokencounts.MARK: -2.0, "a": -1.0, tokencounts.MARK + "w": -1.5, "word": -3.0, "o": -2.0}
    out = tokencounts.token_counts(edge(spark), pieces).collect()
    unknown = min(pieces.values()) - tokencounts.UNKNOWN_PENALTY
    want = sorted((str(i), len((t or "").split()), sum(plain(w, pieces, unknown)[1] for w in (t or "").split())) for i, t in EDGE)
    assert sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in out) == want
    assert tokencounts.token_counts(edge(spark).limit(0), pieces).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_permutes(total):
    x = np.arange(total)
    y = materialise.feistel(x, total, 7)
    assert sorted(y) == list(range(total))
    assert total < 64 or (y != materialise.feistel(x, total, 8)).any()


def texts_back(rows, length):
    import tiktoken

    ranks = materialise.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=materialise.GPT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {}
    for r in sorted(rows, key=lambda r: r.part):
        docs.setdefault(r.doc_id, []).extend(np.frombuffer(r.record, "<u4")[:r.n_tokens].tolist())
    for ids in docs.values():
        assert ids[-1] == 50256 and 50256 not in ids[:-1]
    return {i: enc.decode(ids[:-1]) for i, ids in docs.items()}


def test_round_trip_and_slots(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q["op3_training_order"](spark, SF).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert texts_back(rows, materialise.LENGTH) == docs
    assert all(r.shard * materialise.SHARD_ROWS + r.place == r.slot for r in rows)
    order = np.array([r.slot for r in sorted(rows, key=lambda r: (r.doc_id, r.part))])
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.1


def test_shard_files(spark, tmp_path):
    ranks = materialise.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    docs = edge(spark).filter("doc_id <> 4 OR doc_id IS NULL").unionByName(edge(spark).filter("doc_id = 4").limit(1))
    ordered = materialise.training_order(docs, ranks, 50256, key=3, length=64, shard_rows=100)
    rows = {r.slot: r for r in ordered.collect()}
    materialise.write_shards(ordered, str(tmp_path / "out"))
    shards = -(-len(rows) // 100)
    for k in range(shards):
        files = glob.glob(f"{tmp_path}/out/shard={k}/part-*")
        assert len(files) == 1
        data = open(files[0], "rb").read()
        n = min(100, len(rows) - 100 * k)
        assert len(data) == n * (4 * 64 + 4)
        for place in (0, n // 2, n - 1):
            assert materialise.read_record(data, place, 64).tobytes() == rows[100 * k + place].record
    want = {i: t or "" for i, t in EDGE}
    assert texts_back(rows.values(), 64) == want
    assert materialise.training_order(docs.limit(0), ranks, 50256).count() == 0


def test_long_blank_runs(monkeypatch):
    """Cutting runs out gives the ids that the pattern gives, and runs that the pattern can't take are taken."""
    import random
    import re

    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=materialise.GPT_PATTERN, mergeable_ranks=materialise.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), special_tokens={})
    whole = re.compile(materialise.LONG_BLANKS.pattern.replace("20000", "3"))
    monkeypatch.setattr(materialise, "LONG_BLANKS", whole)
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice([" ", "  ", " " * 9, "\n", "\t\t", "\u3000", "\x1c", "a", "b's", "12", "é", "."]) for _ in range(rng.randint(0, 30)))
        assert materialise.encoded(enc, text) == enc.encode_ordinary(text), repr(text)
    monkeypatch.undo()
    for text in (" " * 1_000_000, "a" + " \n" * 600_000 + "b", "x" * 300_000):
        assert enc.decode(materialise.encoded(enc, text)) == text
