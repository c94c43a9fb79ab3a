"""Split CSV files against the reader that takes a file as one task."""

import random

import pytest

from tabulens.sources import load, records


def plain(spark, path, names):
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(path))
    assert df.columns == names
    return sorted(map(str, df.collect()))


@pytest.fixture
def tiny_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


@pytest.mark.parametrize("seed", range(4))
def test_random_quoted_input(spark, tmp_path, tiny_ranges, seed):
    rng = random.Random(seed)

    def cell():
        text = "".join(rng.choice(["a", "b", "é", "1", " ", ",", '""', "\n", "\n\n", "x" * rng.randrange(60)]) for _ in range(rng.randrange(6)))
        return f'"{text}"' if rng.random() < 0.6 else rng.choice(["", "7", "plain", "1.5", 'in "quotes" here', "é"])

    path = tmp_path / "a.csv"
    rows = [",".join(cell() for _ in range(3)) for _ in range(120)]
    path.write_text('k,"second one",t\n' + "".join(r + ("\n\n" if rng.random() < 0.1 else "\n") for r in rows) + f'last,"{"long " * 200}\n{"more " * 100}",end')
    names = ["k", "second one", "t"]
    found = records.csv_records(spark, [str(path)], "UTF-8")
    ddl = load._ddl(spark.read.option("header", True).option("multiLine", True).csv(str(path)).schema)
    from pyspark.sql import functions as F
    got = found.select(F.from_csv("record", ddl, {"escape": '"'}).alias("r")).select("r.*")
    assert sorted(map(str, got.collect())) == plain(spark, path, names)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20


def test_several_files_encodings_and_ends(spark, tmp_path, tiny_ranges):
    (tmp_path / "a.csv").write_bytes('n,t\r\n1,"one\r\ntwo"\r\n\r\n2,"x ""y"" z"\r\n'.encode())
    (tmp_path / "b.csv").write_bytes("n,t\n3,caf\xe9\n4,\"caf\xe9\nau lait\"".encode("latin-1"))
    got = load.load_csv(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv")])
    assert dict(got.dtypes)["n"] == "int"
    assert sorted(map(tuple, got.collect())) == [(1, "one\r\ntwo"), (2, 'x "y" z'), (3, "café"), (4, "café\nau lait")]
    (tmp_path / "none.csv").write_text("n,t\n")
    assert load.load_csv(spark, str(tmp_path / "none.csv")).count() == 0 and load.load_csv(spark, str(tmp_path / "none.csv")).columns == ["n", "t"]


@pytest.mark.parametrize("line, start, end", [('a,"b', False, True), ('a,"b"', False, False), ('b",c', True, False), ('b"",c', True, True), ('5" pipe,"x', False, True), ('a "q,b', False, False), ("", True, True),
                                              ('"a""', False, True), ('x","y', True, True), ('"",""', False, False)])
def test_state_at_the_end_of_a_line(line, start, end):
    assert records.ends_inside(line, start) is end
