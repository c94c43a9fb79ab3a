"""Readers on everyday files: quotes, line breaks, missing-value words, JSON shapes, workbooks of different headers, dates."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tabulens import jobs
from tabulens.ml import models, unsupervised
from tabulens.operators import charts, clean, roles
from tabulens.operators.timeseries import datetime_parts
from tabulens.sources import load


def test_csv_dialect(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,note,score,day\n1,"say ""hi"", ok",1.5,2024-01-05\n2,"two\nlines",NA,\n3,plain,nan,2024-02-01\n4,,2,\n')
    df = load.load_csv(spark, str(p))
    assert [t for _, t in df.dtypes] == ["int", "string", "double", "date"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 'say "hi", ok', 1.5, dt.date(2024, 1, 5)), (2, "two\nlines", None, None), (3, "plain", None, dt.date(2024, 2, 1)), (4, None, 2.0, None)]
    assert load.load_csv(spark, str(p), "id long, note string, score double, day string").dtypes[0] == ("id", "bigint")


@pytest.mark.parametrize("text,rows", [
    ('{"a": 1, "b": "x"}\nbroken\n{"a": 2, "b": "y"}\n', [(1, "x"), (2, "y")]),
    ('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]', [(1, "x"), (2, "y")]),
    (json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}, indent=2), [(1, "x"), (2, "y")]),
    ('{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}', [(1, "x"), (2, "y")]),
    (json.dumps({"a": {"0": 1, "1": "two"}, "b": {"0": "x", "1": "y"}}), [("1", "x"), ("two", "y")]),
])
def test_json_shapes(spark, tmp_path, text, rows):
    p = tmp_path / "a.json"
    p.write_text(text)
    df = load.load_json(spark, str(p))
    assert sorted(tuple(r) for r in df.select("a", "b").collect()) == rows
    assert load.bad_json_lines(spark, str(p)).count() == (1 if "broken" in text else 0) or "\n" in text.strip()


def test_json_lines_of_structs_and_mixed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"p": {"x": 1}, "q": {"x": 2}}\n{"p": {"x": 3}, "q": {"x": 4}}\n')
    assert load.load_json(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "b.json").write_text('[{"a": 1}]')
    (tmp_path / "c.json").write_text('{"a": 2}\n{"a": 3}\n')
    assert sorted(r.a for r in load.load_json(spark, [str(tmp_path / f) for f in ("b.json", "c.json")]).collect()) == [1, 2, 3]
    assert load.load_json(spark, str(tmp_path / "a.json"), shape="lines").count() == 2


def test_numbers_and_dates_in_text(spark):
    rows = [("12/31/2024", "5 Jan 2024", "10d", "1e3", "31/12/2024"), ("1/2/2024", "17 Feb 2023", "20f", " 2.5 ", "1/2/2024"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "us string, words string, suffix string, number string, eu string")
    kinds = clean.text_types(df)
    assert kinds == {"us": "datetime M/d/yyyy", "words": "datetime d MMM yyyy", "suffix": "text", "number": "numeric", "eu": "datetime d/M/yyyy"}
    first = clean.fix_types(df, kinds).first()
    assert (first.us.date(), first.words.date(), first.suffix, first.number, first.eu.date()) == (dt.date(2024, 12, 31), dt.date(2024, 1, 5), "10d", 1000.0, dt.date(2024, 12, 31))
    assert {r.column: r.is_datetime for r in clean.detect_datetime_cols(df).collect()} == {"us": True, "words": True, "suffix": False, "number": False, "eu": True}
    assert datetime_parts(df.select("us"), "us").first()["us_month"] == 12


def test_exact_distinct_counts_at_any_size(spark):
    df = spark.range(300_000).select("id", (F.col("id") % 60_000).alias("v"))
    assert {r.column: r.n_distinct for r in roles.column_roles(df).collect()} == {"id": 300_000, "v": 60_000}


def test_histogram_of_a_wide_range(spark):
    df = spark.range(1000).select(F.when(F.col("id") == 0, 1e18).otherwise(F.col("id").cast("double")).alias("v"))
    rows = charts.histogram(df, "v").collect()
    assert sum(r["count"] for r in rows) == 1000


def test_pair_bins_of_all_columns(spark):
    df = spark.range(50).select(*[(F.col("id") % (i + 2)).cast("double").alias(f"c{i}") for i in range(7)])
    assert charts.pair_bins(df, df.columns).select("col_x", "col_y").distinct().count() == 21


def labelled(spark, n=240):
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("ts"), F.round(F.sin(F.col("id")) * 10).alias("s.1"), F.round(F.rand(3), 2).alias("s2"),
                                 (F.col("id") % 7 == 0).cast("int").alias("anomaly"), F.when(F.sin(F.col("id")) > 0.3, "hot").otherwise("cool").alias("state"))


def test_no_label_reaches_the_features(spark):
    df = labelled(spark).withColumnRenamed("s.1", "s1")
    tables = jobs.run_anomaly(df.drop("state"), "key", ["ts"], do_clean=False)
    assert not [c for c in tables["anomalies"].columns if c.startswith("anomaly_")]
    assert tables["anomalies"].count() == 240
    names = []
    keep = models.train_supervised

    def spy(frame, *args, **more):
        out = keep(frame, *args, **more)
        names.extend(out.state.features)
        return out

    models.train_supervised = spy
    try:
        jobs.run_anomaly(df, "key", ["ts"], target="state", model_names=["Decision Tree"], tune_models=False)
    finally:
        models.train_supervised = keep
    assert names and not [n for n in names if "anomaly" in n or "is_outlier" in n]


def test_saved_scoring_equals_live_with_text_keys(spark, tmp_path):
    df = labelled(spark).withColumnRenamed("s.1", "s1").drop("anomaly")
    folder = str(tmp_path / "run")
    test = df.drop("state").filter("ts >= 200")
    tables = jobs.run_anomaly(df.filter("ts < 200"), "key", ["ts"], target="state", test=test, output=folder, model_names=["Decision Tree"], tune_models=False, do_clean=False)
    live = sorted(tuple(r) for r in tables["submission"].collect())
    saved = sorted(tuple(r) for r in jobs.score_saved(spark, folder, test, ["ts"], key="key")["submission"].collect())
    assert live == saved and len(live) == 40 and {v for _, v in live} <= {"hot", "cool"} and live[0][0].startswith("k")


def test_all_models_failing_is_reported(spark):
    df = labelled(spark).withColumnRenamed("s.1", "s1").drop("anomaly")
    real = models.fit_one

    def broken(*_):
        raise RuntimeError("no")

    models.fit_one = broken
    try:
        tables = jobs.run_anomaly(df, "key", ["ts"], target="state", model_names=["Decision Tree"], tune_models=False, do_clean=False)
    finally:
        models.fit_one = real
    assert tables["leaderboard"].count() == 0 and "no" in tables["failures"].first()["error"]


def test_baseline_with_dotted_names_and_detection_with_repeated_keys(spark):
    df = labelled(spark)
    out = models.train_baseline(df.drop("anomaly"), "key", "state")
    assert out["success"], out
    twice = df.select("ts", F.col("`s.1`").alias("s1"), "s2").unionByName(df.select("ts", F.col("`s.1`").alias("s1"), "s2"))
    assert unsupervised.isolation_forest(twice, "ts", trees=20).count() == 480


def test_boosting_grid_with_three_classes(spark):
    estimator = models.registry(100, classes=3, rounds=5)["Gradient Boosting"]
    grid = models.tuning_grid("Gradient Boosting", estimator)
    assert len(grid) == 4 and len(estimator.fits()) == 3
    chosen = models.with_params(estimator, {"rounds": 7, "step": 0.05})
    assert (chosen.rounds, chosen.step, estimator.rounds) == (7, 0.05, 5)


def test_splits_of_many_classes_and_a_hot_one(spark):
    from tabulens.ml import split

    df = spark.range(30_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 12_001).alias("y"))
    out = split.stratified_split(df, "y", "id").groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()
    assert len(out) > 10_000 and all(r.t == int(r.n * 0.2 + 0.5) for r in out)
    folds = split.kfold_assign(df.filter("y IS NULL OR y < 100"), "y", "id", 5).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r.y is None} == {3000}
    assert split.class_weights(df, "y").count() == len(out)
