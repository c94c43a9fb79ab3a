"""Repeatable splits, folds and bounded samples from row hashes.

A row's place inside its class follows from counts by class and hash range; only ranges that hold a cut are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens import fixed_values as fv
from tabulens.functions.columns import HASH_SPACE, col, row_hash
from tabulens.plans.workspace import written

#: Classes that a model may have, and ranges of the hash space.
MAX_CLASSES = 10_000
CELLS = 4096


def class_counts(df: DataFrame, label: str) -> dict:
    rows = df.groupBy(col(label).alias("label")).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"'{label}' has more than {MAX_CLASSES} classes")
    return {r["label"]: r["count"] for r in sorted(rows, key=lambda r: (r["label"] is None, r["label"]))}


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class its rows and balanced weight n / (k n_c), beside the majority / next-class ratio; any number of classes."""
    counts = written(df.groupBy(col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")), "classes")
    row = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    top = [r["n"] for r in counts.orderBy(F.col("n").desc()).limit(2).collect()]
    ratio = top[0] / top[1] if len(top) > 1 else 1.0
    weight = F.lit(row["n"] or 0) / (F.lit(row["k"]) * F.col("n"))
    return counts.select(F.coalesce("label", F.lit("None")).alias("label"), "n", weight.alias("weight"), F.lit(ratio).alias("positive_weight"))


def cuts_passed(df: DataFrame, label: str, key: str, seed: int, places: list[Column]) -> DataFrame:
    """`df` with `__passed`: how many of its class's cut places (1-based ranks in hash order, then key order) a row lies beyond.

    `places` are expressions of `n`, the rows of the class. Rows are counted by (class, cell of the hash); only the cells that
    hold a place are put in order, so that the work does not depend on the number of classes and no class is gathered.
    """
    rows = df.withColumns({"__y": col(label), "__h": row_hash(col(key), seed), "__k": col(key).cast("long")})
    rows = rows.withColumn("__c", F.floor(F.col("__h") / F.lit(HASH_SPACE // CELLS)))
    counts = rows.groupBy("__y", "__c").agg(F.count(F.lit(1)).alias("m"))
    run = Window.partitionBy("__y").orderBy("__c")
    counts = counts.withColumns({"upto": F.sum("m").over(run), "n": F.sum("m").over(Window.partitionBy("__y"))})
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), p.cast("long").alias("place")) for i, p in enumerate(places)]))
    holding = counts.select("__y", "__c", "upto", "m", asked.alias("a")).filter("a.place > upto - m AND a.place <= upto")
    holding = written(holding.select(F.col("__y").alias("y"), F.col("__c").alias("c"), "a.i", (F.col("a.place") - F.col("upto") + F.col("m")).alias("nth")), "places")
    inside = rows.select("__y", "__c", "__h", "__k").join(holding, F.col("__y").eqNullSafe(F.col("y")) & (F.col("__c") == F.col("c")))
    order = Window.partitionBy("y", "i").orderBy("__h", "__k")
    edges = inside.withColumn("rank", F.row_number().over(order)).filter("rank = nth")
    early = counts.groupBy("__y").agg(F.max("n").alias("n")).select(F.col("__y").alias("ey"), sum((p <= 0).cast("int") for p in places).alias("early"))
    edges = edges.groupBy("y").agg(F.collect_list(F.struct("__h", "__k")).alias("edges"))
    by_class = early.join(edges, F.col("ey").eqNullSafe(F.col("y")), "left").select("ey", "early", "edges")
    out = rows.join(written(by_class, "edges"), F.col("__y").eqNullSafe(F.col("ey")), "left")
    mine = F.struct(F.col("__h"), F.col("__k"))
    beyond = F.size(F.filter(F.coalesce("edges", F.array().cast("array<struct<__h:bigint,__k:bigint>>")), lambda e: mine > e))
    return out.withColumn("__passed", F.col("early") + beyond).drop("__y", "__h", "__k", "__c", "ey", "early", "edges")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = fv.TEST_SHARE, seed: int = fv.SEED) -> DataFrame:
    """Adds `split`: in every class the first share of the hash order is `test`, the rest `train`."""
    passed = cuts_passed(df, label, key, seed, [F.floor(F.col("n") * test_share + 0.5)])
    return passed.withColumn("split", F.when(F.col("__passed") == 0, "test").otherwise("train")).drop("__passed")


def plain_split(df: DataFrame, key: str, test_share: float = fv.TEST_SHARE, seed: int = fv.SEED) -> DataFrame:
    return stratified_split(df.withColumn("__all", F.lit(0)), "__all", key, test_share, seed).drop("__all")


def kfold_assign(df: DataFrame, label: str, key: str, folds: int = fv.CV_FOLDS, seed: int = fv.SEED) -> DataFrame:
    """Adds `fold` 0..k-1: equal slices of every class's hash order."""
    passed = cuts_passed(df, label, key, seed, [F.ceil(F.lit(i) * F.col("n") / folds) for i in range(1, folds)])
    return passed.withColumn("fold", F.col("__passed").cast("int")).drop("__passed")


def bounded_sample(df: DataFrame, key: str, n: int = fv.BOUNDED_SAMPLE_ROWS, seed: int = fv.SEED) -> DataFrame:
    """The n rows with the smallest hashes: repeatable, and each task keeps at most n rows."""
    return df.orderBy(row_hash(col(key), seed), col(key)).limit(n)
