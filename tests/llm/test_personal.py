"""Personal data: plain finds against plain Python, the semi-Markov model against enumeration and on forms it has to add."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulens.llm import personal
from tabulens.llm.queries import Q
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@settings(max_examples=300, deadline=None)
@given(st.text("a1@.+- (9é%", max_size=40))
def test_base_is_the_patterns(text):
    assert personal.base_spans(text) == [(a, k, b) for a, k, b, _ in brute.personal(text)]


@pytest.mark.parametrize("text", ["a@b.c@d.e", "x@@y.zz a.b@c-d.ef.gh", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (225) 555-3104 +49 30 1234567 +1 2",
                                  "a@b@c.de", "9" * 60_000, "x" * 300_000 + "1", "@" * 3000, "1." * 30_000, "é+33 1 23 45 67 89"])
def test_base_cases(text):
    if len(text) < 10_000:  # the plain patterns take quadratic time on long runs
        assert personal.base_spans(text) == [(a, k, b) for a, k, b, _ in brute.personal(text)]
    else:
        assert len(personal.base_spans(text)) in (0, 7500) and len(list(personal.stretches(text))) < 2


def test_decoding_is_exact():
    rng = np.random.default_rng(3)
    s, before, after = "1 (225) 555-3104 12 7", "call ", " x"
    cuts, spans = personal.candidates(s, before, after)
    names = {f for _, _, fs in spans for f in fs}
    crf = personal.Crf({f: rng.normal(size=4) for f in sorted(names)} | {"bias": np.full(4, -1.0)})
    n = len(cuts) - 1
    assert len(spans) > 5

    def paths(at):
        if at == n:
            yield ()
            return
        yield from paths(at + 1)
        for i, j, f in spans:
            if i == at:
                for k in range(4):
                    for rest in paths(j):
                        yield ((i, j, k, crf.scores(f)[k]), *rest)

    every = list(itertools.islice(paths(0), 2_000_000))
    values = np.array([sum(x[3] for x in p) for p in every])
    ahead, back, _ = crf.lattice(n, spans)
    assert ahead[n] == pytest.approx(np.logaddexp.reduce(values)) and back[0] == pytest.approx(ahead[n])
    got = crf.decode(s, before, after)
    best = every[int(values.argmax())]
    assert [(a, k, b) for a, k, b, _ in got] == [(cuts[i], k, cuts[j]) for i, j, k, _ in best]
    for a, k, b, p in got:
        share = [v for q, v in zip(every, values) if any((cuts[i], kk, cuts[j]) == (a, k, b) for i, j, kk, _ in q)]
        assert p == pytest.approx(np.exp(np.logaddexp.reduce(share) - ahead[n]))


def test_whole_table_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = Q["op8_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute.personal(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r.base_sha256 == brute.sha(text) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in base) for k in personal.KINDS]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    crf = personal.fit(docs)
    # Trained on the patterns' labels, the model finds the same spans by itself, and forms that the patterns miss.
    agree = total = 0
    for t in list(texts.values())[:400]:
        alone = {(at + a, k, at + b) for at, s, x, y in personal.stretches(t) for a, k, b, p in crf.decode(s, x, y) if p >= 0.5}
        base = set(personal.base_spans(t))
        agree += len(alone & base)
        total += len(alone | base)
    assert agree / total > 0.8
    found = lambda t: [(personal.KINDS[k], t[a:b]) for a, k, b in personal.find(t, crf)[1]]
    assert ("phone", "1 (225) 555-3104") in found("the 1 (225) 555-3104 of")
    assert found("in 1999 and 2024 there were 12 of 300") == []
    edge = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a@b.cd", "y"), (3, "a@b.cd", "y"), (3, "a@b.cd", "y"), (4, "1 " * 50_000, "z")], "doc_id long, text string, base string")
    out = {str(r.doc_id): len(r.base) for r in personal.find_personal_data(edge, crf).collect()}
    assert out == {"1": 0, "2": 0, "None": 1, "3": 1, "4": 0}
    assert personal.find_personal_data(edge.limit(0), crf).count() == 0
    assert personal.find_personal_data(edge, personal.fit(edge.limit(0))).count() == 6


def test_fit_sees_distinct_stretches(spark, monkeypatch):
    """One stretch repeated over FIT_STRETCHES times does not crowd out the others, wherever its hash falls."""
    monkeypatch.setattr(personal, "fit_weights", lambda samples: samples)
    few = [f"mail a{i}@b.cd now" for i in range(6)]
    every = personal.fit(spark.createDataFrame([(t,) for t in few], "text string"))
    assert len(every) == 6
    first = next(t for t in few if every[0][0] in t)  # the smallest hash
    docs = spark.createDataFrame([(t,) for t in few], "text string").unionByName(spark.range(4000).selectExpr(f"'{first}' AS text")).repartition(7)
    assert sorted(personal.fit(docs)) == sorted(every)
    assert personal.fit(docs, limit=2) == every[:2]


def test_spans_are_those_of_the_given_model():
    """A second model in the same process does not get the first one's spans."""
    text = "the (225) 555-3104 of"
    _, s, before, after = next(personal.stretches(text))
    names = {f for _, _, fs in personal.candidates(s, before, after)[1] for f in fs}
    shy, keen = (personal.Crf({f: np.full(4, w) for f in names} | {"bias": np.full(4, w)}) for w in (-20.0, 20.0))
    assert personal.find(text, shy)[1] == []
    fresh = [(a, k, b) for a, k, b, _ in keen.decode(s, before, after)]
    assert fresh and personal._decoded(keen, s, before, after) == keen.decode(s, before, after)


def test_added_spans_on_forms_never_learned():
    """Precision and recall of what the model adds, on written forms, finds and look-alikes that it has not seen."""
    import random

    crf, rng = personal.fit_weights([]), random.Random(99)
    hits = misses = wrong = 0
    for kind in personal.KINDS:
        mine = []
        for _ in range(60):
            plain = personal._made_up(kind, rng)
            for form in personal.HELD_OUT[kind]:
                text, lead = form(plain), rng.choice(["", "the ", "at the end "])
                base, more = personal.find(lead + text + rng.choice(["", " of"]), crf)
                want = (len(lead), personal.KINDS.index(kind), len(lead) + len(text))
                if want not in base:
                    mine.append(want in more)
                    wrong += len([x for x in more if x != want])
        assert sum(mine) / len(mine) >= 0.9, kind
        hits, misses = hits + sum(mine), misses + len(mine) - sum(mine)
    for _ in range(30):
        wrong += sum(len(personal.find(f"see {x} now", crf)[1]) for x in personal._look_alikes(rng))
    assert hits / (hits + misses) >= 0.9 and hits / (hits + wrong) >= 0.9


def test_written_forms():
    crf = personal.fit_weights([])
    found = lambda t: [(personal.KINDS[k], t[a:b]) for a, k, b in personal.find(t, crf)[1]]
    for kind, text in [("phone", "(212) 555-0187"), ("phone", "212-555-0187"), ("card", "4111.1111.1111.1111"), ("email", "john@host"), ("email", "john at host dot com"),
                       ("ip", "192[.]168[.]1[.]10"), ("email", "bob (at) example (dot) org"), ("ip", "10 dot 0 dot 0 dot 1")]:
        assert found(text) == [(kind, text)] and found(f"see {text}, then") == [(kind, text)], text
    assert found("call 2125550187") == [("phone", "2125550187")] and found("order 2125550187") == []
    for text in ("on 2024-05-17 12:30:45", "1,234,567.89 in all", "4111.1111.1111.1112", "999[.]1[.]300[.]4", "pages 1999-2004", ""):
        assert found(text) == [], text
    import time
    start = time.time()
    for text in ("9 " * 10_000, "9" * 300_000, "1-" * 10_000, "a at b dot " * 20_000, " at " * 50_000, "@" * 20_000, "[at]" * 30_000):
        personal.find(text, crf)
    assert time.time() - start < 60
