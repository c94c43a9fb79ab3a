"""The pipeline's stages against plain Python, one after the other."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tabulens.llm import materialise
from tests.llm import brute
from tests.llm.test_native import check_mix
from tabulens.llm import mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    junk = [dict(rows[0], doc_id=90_000, text=None), dict(rows[0], doc_id=90_001, text="12 34"), dict(rows[0], doc_id=90_002), dict(rows[0], doc_id=90_002), dict(rows[1], doc_id=None)]
    docs = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "mix_sources", "training_order"]

    one = stages["language_id"](spark, docs, SF).cache()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r["doc_id"] for r in rows} | {90_002, None}
    two = stages["near_dedup"](spark, one, SF).cache()
    want = brute.near_components([(r.doc_id, r.text) for r in one.collect() if r.doc_id is not None])
    got = [r.doc_id for r in two.collect()]
    assert two.columns == docs.columns and sorted(map(str, got)) == sorted(map(str, {i for i, (_, c) in want.items() if i == c}))  # the copy without an id goes, its group has a named row
    three = stages["decontaminate"](spark, two, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [(r.doc_id, r.text) for r in two.collect()]
    hit = brute.contamination(texts, items)
    assert sorted(str(r.doc_id) for r in three.collect()) == sorted(str(d) for d, t in texts if not hit[d, t][1] or d is None)
    assert 0 < three.count() < two.count()
    four = stages["mix_sources"](spark, three, SF).cache()
    mixed = mixing.entropy_mix(three).collect()
    check_mix(mixed)
    copies = {}
    for r in four.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: r.copies for r in mixed if r.copies}
    last = stages["training_order"](spark, four, SF).collect()
    assert sorted(r.slot for r in last) == list(range(len(last)))
    assert sum(r.part == 0 for r in last) == four.count()
    ends = sum(np.frombuffer(r.record, "<u4")[r.n_tokens - 1] == 50256 for r in last)
    assert ends >= four.count() and {len(r.record) for r in last} == {4 * materialise.LENGTH}


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_rows_without_an_id_and_namesakes(spark):
    """Decisions hold for a row's own text: a null doc_id is judged too, a repeated doc_id does not share its namesake's fate."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = docs.first().asDict()
    words = lambda tag: " ".join(f"{tag}{i * i % 83}" for i in range(40))
    passage = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text), key=len)
    make = lambda rows: spark.createDataFrame([dict(sample, doc_id=i, text=t, source=s) for i, t, s in rows], docs.schema)
    kept = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)

    near = [(1, words("a"), "s"), (None, words("a"), "s"), (None, words("b"), "s"), (None, words("b") + " more", "s"), (None, words("b"), "s"), (7, words("c"), "s"),
            (7, words("d"), "s"), (7, words("d"), "s"), (3, words("c"), "s")]
    got = kept(stages["near_dedup"](spark, make(near), SF))
    b = [t for i, t in got if i == "None"]
    assert len(b) == 1 and b[0] in (words("b"), words("b") + " more")
    assert [x for x in got if x[0] != "None"] == [("1", words("a")), ("3", words("c")), ("7", words("d"))]

    leaks = [(1, words("a"), "s"), (None, passage, "s"), (None, words("b"), "s"), (2, words("c") + " " + passage, "s"), (2, words("d"), "s")]
    assert kept(stages["decontaminate"](spark, make(leaks), SF)) == [("1", words("a")), ("2", words("d")), ("None", words("b"))]

    mix = [(None, words("a") + f" {'x ' * i}", f"s{i % 3}") for i in range(30)] + [(4, words("a") + f" {'x ' * i}", f"s{i % 3}") for i in range(30)]
    mix = make([*mix, (None, None, "s0"), (None, "", "s1")])
    want = {}
    for r in mixing.entropy_mix(mix).collect():
        want[str(r.doc_id), r.source, r.size] = r.copies
    counts = {}
    for r in stages["mix_sources"](spark, mix, SF).collect():
        k = (str(r.doc_id), r.source, len(r.text.split()))
        counts[k] = counts.get(k, 0) + 1
    assert counts == {k: n for k, n in want.items() if n} and any(i == "None" for i, _, _ in counts)


def test_columns_that_clash_and_odd_texts_pass_through(spark):
    """Further columns, some named like what the models put out, keep their values; empty and very long texts have their result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    sample = docs.first().asDict()
    odd = [dict(sample, doc_id=90_000 + i, text=t) for i, t in enumerate([None, "", "a " * 60_000, " " * 200_000 + "end of blanks", "x" * 100_000, "a " * 60_000])]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    extra = {"score": F.lit(7), "spans": F.lit("mine"), "lang_pred": F.lit("zz"), "tk": F.col("doc_id"), "tie": F.lit("t"), "part": F.lit(0), "cut": F.lit(1.5), "__text": F.lit("u")}
    docs = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert set(docs.columns) == set(sample) | set(extra) and docs.count() > 20, name
        assert docs.filter("score <> 7 OR spans <> 'mine' OR lang_pred <> 'zz' OR tk <> doc_id OR tie <> 't' OR part <> 0 OR cut <> 1.5 OR `__text` <> 'u'").count() == 0, name
        assert docs.filter(F.col("text").isNull() | (F.col("text") == "")).count() == 0, name
    kept = {r.doc_id for r in docs.collect()}
    assert len(kept & {90_002, 90_005}) <= 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.filter("part = 0").count() == docs.count()
