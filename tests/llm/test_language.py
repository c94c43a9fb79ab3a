"""Language identification: held-out accuracy, spans, and the batched Viterbi against plain recursion."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.llm import language
from tabulens.llm.queries import Q
from tests.llm import brute

SF = "/root/testdata/sf0.01"
LEARN = "crc32(cast(doc_id as string)) % 3 <> 1"


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet(f"{SF}/documents.parquet"), F.expr(LEARN))


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = Q["op10_language"](spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (brute.remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_labels_do_not_leak(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    a = language.identify_languages(docs, model).select("doc_id", "lang_pred", "score").collect()
    b = language.identify_languages(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")), model).select("doc_id", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_edges_and_spans(spark, model):
    by = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) BETWEEN 1500 AND 2500").orderBy("doc_id").collect()}
    mixed = by["en"] + " " + by["de"] + " " + by["fr"]
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, mixed), (4, mixed), (None, by["es"]), (6, "Ωμέγα"), (7, "the " * 20_000), (8, "İI" * 3)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, score string, spans string")
    out = language.identify_languages(df, model).collect()
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and out[0].score == 0 and out[0].spans == []
    assert [s.lang for s in out[3].spans] == ["en", "de", "fr"] and out[3] == out[4]
    cut = len(by["en"])
    assert abs(out[3].spans[1].start - cut) < 60
    assert out[5].lang_pred == "es" and out[6].lang_pred in model.langs and out[7].lang_pred == "en" and out[8].lang_pred in model.langs
    assert language.identify_languages(df.limit(0), model).count() == 0
    nothing = language.fit(df.select("doc_id", "text", F.lit(None).cast("string").alias("lang")), F.lit(True))
    assert {r.lang_pred for r in language.identify_languages(df, nothing).collect()} == {"und"}


def test_scripts_narrow():
    import pandas as pd

    m = language.Model(pd.DataFrame({"lang": ["el", "el", "en", "en"], "slot": [1, -1 - sorted({s for _, s in language.SCRIPTS}).index("greek"), 2, -1 - sorted({s for _, s in language.SCRIPTS}).index("latin")], "n": [5, 9, 5, 9]}))
    assert m.words(["ωμ"])[0][m.langs.index("en")] == -1e4 and m.words(["om"])[0][m.langs.index("el")] == -1e4 and (m.words(["жж", "a"])[0] > -1e4).all()
    assert language.script_of("я") == "cyrillic" and language.script_of("é") == "latin" and language.script_of("漢") == "han"


def test_viterbi_is_exact():
    rng = np.random.default_rng(5)
    lengths = np.array(sorted([1, 1, 3, 5, 6, 2], reverse=True))
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    got, at = language.viterbi(scores, lengths, 0.7), 0
    for n in lengths:
        s = scores[at:at + n]
        value = lambda path: sum(s[t, x] for t, x in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
        assert value(got[at:at + n]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))), abs=1e-5)
        at += n


def test_bounded_fit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.labelled(docs, F.expr(LEARN), "doc_id", "text", "lang", 20).groupBy("lang").count().collect()
    assert all(r["count"] <= 20 for r in rows) and sum(r["count"] for r in rows) > 40
