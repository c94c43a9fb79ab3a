"""Readers, writers and the two whole jobs."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens import jobs
from tabulens.catalog.profiling import write_workbooks
from tabulens.plans import workspace
from tabulens.sources import load, sensors, sinks


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("name,n\ncafé,1\n�,2\n".encode())
    (tmp_path / "l.csv").write_bytes("name,n\ncafé,1\n".encode("latin1"))
    assert [r.name for r in load.load(spark, str(tmp_path / "u.csv")).collect()] == ["café", "�"]
    assert load.load(spark, str(tmp_path / "l.csv")).first() == ("café", 1)


def test_json_shapes(spark, tmp_path):
    want = [(1, "x"), (2, "y")]
    docs = {"lines": '{"a":1,"b":"x"}\n{"a":2,"b":"y"}\n', "array": json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], indent=1),
            "map": json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}})}
    for name, text in docs.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        assert sorted(map(tuple, load.load(spark, str(path)).select("a", "b").collect())) == want, name


def test_refused_inputs(spark, tmp_path):
    with pytest.raises(ValueError, match="no reader for files"):
        load.load(spark, "x.txt")
    (tmp_path / "one.csv").write_text("a\n1\n")
    (tmp_path / "none.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="two columns"):
        load.load(spark, str(tmp_path / "one.csv"))
    with pytest.raises(ValueError, match="no rows"):
        load.load(spark, str(tmp_path / "none.csv"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        load.load(spark, str(tmp_path / "gone.parquet"))


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, "a<b", None), (2, 2.5, "c", 4.0)], "i int, d double, s string, h double")
    write_workbooks(df.coalesce(1), str(tmp_path / "w.xlsx"))
    got = load.load(spark, str(tmp_path / "w.xlsx"))
    assert dict(got.dtypes) == {"i": "bigint", "d": "double", "s": "string", "h": "double"}
    assert sorted(map(tuple, got.collect())) == [(1, 1.5, "a<b", None), (2, 2.5, "c", 4.0)]


def test_union_of_sources(spark, tmp_path):
    (tmp_path / "p 1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "p2.csv").write_text("a,b\n3,4\n5,6\n")
    (tmp_path / "q.json").write_text('{"a":7,"c":"z"}\n')
    paths = [str(tmp_path / n) for n in ("p 1.csv", "p2.csv", "q.json")]
    df = load.union_sources(spark, paths)
    assert df.columns == ["a", "b", "source_file", "c"]
    assert [tuple(r) for r in load.rows_per_source(df).collect()] == [("p2.csv", 2), ("p 1.csv", 1), ("q.json", 1)]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://x", "applicationId": "a"})
    with pytest.raises(RuntimeError):
        workspace.shared_folder(Fake)
    Fake.conf = type("C", (), {"get": staticmethod(lambda *a: "hdfs://x/ck/")})
    assert workspace.shared_folder(Fake) == "hdfs://x/ck"


def test_sensor_counts(spark):
    df = sensors.sensor_readings(spark.range(500)).toPandas()
    assert df["anomaly"].sum() == 40 and df["temperature"].isna().sum() == 5 and df["timestamp"].is_unique
    second = sensors.sensor_readings(spark.range(300), machine="second").toPandas()
    assert second["anomaly"].sum() == 20 and not second.isna().any().any()
    assert df["vibration"][df["anomaly"] == 1].min() > df["vibration"][df["anomaly"] == 0].mean()


def test_submission_rules(spark):
    test = spark.range(3)
    good = test.withColumn("y", F.lit(1))
    assert sinks.validate_submission(good, test, "y").first()["is_valid"]
    assert not sinks.validate_submission(good.limit(2), test, "y").first()["is_valid"]
    assert not sinks.validate_submission(good.withColumn("y", F.lit(None).cast("int")), test, "y").first()["is_valid"]
    assert not sinks.validate_submission(test, test, "y").first()["is_valid"]
    assert sinks.id_column(test) == "id" and sinks.id_column(spark.createDataFrame([(1,)], "k int"), "k") == "k"


def sensor_files(spark, tmp_path):
    paths = []
    for machine, n in (("first", 400), ("second", 300)):
        path = str(tmp_path / f"{machine}.parquet")
        sensors.sensor_readings(spark.range(n), machine=machine).drop("id").write.parquet(path)
        paths.append(path)
    return paths


def test_detection_over_two_files(spark, tmp_path):
    df = jobs.with_row_key(jobs.load_all(spark, sensor_files(spark, tmp_path)))
    tables = jobs.run_anomaly(df, jobs.ROW_KEY, ["timestamp"], contamination=0.1)
    found = tables["anomalies"].toPandas()
    assert len(found) == 700 and found["if_anomaly"].sum() == pytest.approx(70, abs=3)
    assert found["if_score"][found["anomaly"] == 1].mean() < found["if_score"][found["anomaly"] == 0].mean()


def test_training_and_scoring_with_an_unseen_category(spark, tmp_path):
    rng = np.random.default_rng(42)
    def part(start, n, categories):
        s = rng.normal(0, 1, (n, 3))
        return pd.DataFrame({"s1": s[:, 0], "s2": s[:, 1], "s3": s[:, 2], "id": range(start, start + n), "cat_feature": [categories[i % len(categories)] for i in range(n)]})
    train = pd.concat([part(1, 200, ["Known", "Other"]), part(201, 200, ["Known", "Other"])])
    train["Target"] = (train["s1"] > 1.0).astype(int)
    test = spark.createDataFrame(part(1001, 50, ["NewCategory"]))
    out = str(tmp_path / "out")
    tables = jobs.run_anomaly(spark.createDataFrame(train), "id", ["id"], target="Target", test=test, output=out, tune_models=False, use_smote=True,
                              model_names=["Logistic Regression", "Decision Tree"])
    assert tables["submission_check"].first()["is_valid"]
    sub = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/submission")
    ids = sorted(r.id for r in sub.collect())
    assert sub.columns == ["id", "target"] and ids[0] == 1001 and len(ids) == 50
    for name in ("feature_state", "best_model", "report/leaderboard", "report/insights"):
        assert (tmp_path / "out" / name).exists(), name
    hits = tables["submission"].join(test, "id").select(((F.col("s1") > 1.0).cast("int") == F.col("target")).alias("ok"))
    assert hits.filter("ok").count() >= 45


def test_exploration_of_small_and_broken_tables(spark):
    df = spark.createDataFrame([("ann", 30, 100, "F"), ("bob", 41, 120, "M"), ("cid", 35, 90, "M"), ("dee", 28, 95, "F"), ("eve", 50, 300, "F")],
                               "name string, age int, salary int, gender string")
    tables = jobs.run_eda(df, ["name"], "age")
    assert tables["baseline"].first()["metric"].startswith("error: ValueError") and tables["cleaning"].count() == 10
    with pytest.raises(ValueError, match="empty"):
        jobs.run_eda(df.limit(0), ["name"])
