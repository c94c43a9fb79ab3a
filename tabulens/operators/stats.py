"""Numeric, categorical and relational statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens import fixed_values as fv
from tabulens.functions.columns import col, number, present, sample_kurtosis, sample_skew
from tabulens.plans.order_stats import exact_quantiles
from tabulens.plans.workspace import rows_frame

def moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Count, mean, sample and population std, min, max, corrected skew and kurtosis: one aggregate."""
    if not columns:
        return {}
    names = ["count", "mean", "std", "std_pop", "min", "max", "skewness", "kurtosis"]
    aggs: list[Column] = []
    for i, c in enumerate(columns):
        v = number(df, c)
        forms = [F.count(v), F.avg(v), F.stddev_samp(v), F.stddev_pop(v), F.min(v), F.max(v), F.skewness(v), F.kurtosis(v)]
        aggs += [a.alias(f"{name}{i}") for name, a in zip(names, forms)]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        m = {name: row[f"{name}{i}"] for name in names}
        n = m["count"]
        flat = not m["std"]
        m["skewness"] = (0.0 if flat and n >= 3 else None) if flat else sample_skew(m["skewness"], n)
        m["kurtosis"] = (0.0 if flat and n >= 4 else None) if flat else sample_kurtosis(m["kurtosis"], n)
        out[c] = m
    return out


def mean_std(df: DataFrame, columns: list[str], population: bool = False) -> dict[str, tuple]:
    """(mean, std) per column: the two moments alone, a much lighter aggregate than `moments`."""
    if not columns:
        return {}
    std = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*[a for i, c in enumerate(columns) for a in (F.avg(number(df, c)).alias(f"m{i}"), std(number(df, c)).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def numeric_facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Moments and exact quartiles per column; all-missing columns are left out."""
    found = {c: m for c, m in moments(df, columns).items() if m["count"]}
    quartiles = exact_quantiles(df, {c: number(df, c) for c in found}, [0.25, 0.5, 0.75],
                                {c: m["count"] for c, m in found.items()})
    for c, (q25, q50, q75) in quartiles.items():
        found[c].update(q25=q25, median=q50, q75=q75, iqr=q75 - q25)
    return found


STAT_COLUMNS = ["mean", "median", "std", "min", "max", "skewness", "kurtosis", "q25", "q75", "iqr"]


def numeric_stats(df: DataFrame, columns: list[str], facts: dict | None = None) -> DataFrame:
    facts = numeric_facts(df, columns) if facts is None else facts
    rows = [(c, m["count"], *[m[s] for s in STAT_COLUMNS]) for c, m in facts.items()]
    schema = "column string, count long, " + ", ".join(f"{s} double" for s in STAT_COLUMNS)
    return rows_frame(df.sparkSession, rows, schema)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for the non-missing values, all columns in one shuffle of combined counts."""
    texts = df.select(*[present(df, c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], [col(c) for c in columns], "column", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_stats(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Distinct count, most and least frequent value; equal counts go to the smaller value."""
    counts = value_counts(df, columns) if counts is None else counts
    most, least = F.struct(-F.col("n"), F.col("value")), F.struct(F.col("n"), F.col("value"))
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.min_by("value", most).alias("most_frequent"),
        F.max("n").alias("most_frequent_count"),
        F.min_by("value", least).alias("least_frequent"),
        F.min("n").alias("least_frequent_count"),
    )


def top_values(df: DataFrame, columns: list[str], k: int = fv.TOP_VALUES, counts: DataFrame | None = None) -> DataFrame:
    """The k most frequent values per column; the rank limit is applied before the shuffle."""
    counts = value_counts(df, columns) if counts is None else counts
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def year_counts(df: DataFrame, column: str) -> DataFrame:
    years = df.filter(col(column).isNotNull()).groupBy(F.year(col(column)).alias("year"))
    return years.agg(F.count(F.lit(1)).alias("n")).orderBy("year")


def describe_all(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Count, unique, top, freq for text columns; count, mean, std, quartiles, range for numeric ones."""
    picked = ["mean", "std", "min", "q25", "median", "q75", "max"]
    facts = numeric_facts(df, numeric)
    rows = [(c, m["count"], *[m[s] for s in picked]) for c, m in facts.items()]
    schema = "column string, count long, " + ", ".join(f"{s} double" for s in picked)
    parts = [rows_frame(df.sparkSession, rows, schema)]
    if categorical:
        counts = value_counts(df, categorical)
        parts.append(counts.groupBy("column").agg(
            F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("freq")))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    wanted = {"unique": "long", "top": "string", "freq": "long"}
    for name, kind in wanted.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.select("column", "count", "unique", "top", "freq", *picked)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Upper triangle with diagonal: (pos_x, pos_y, col_x, col_y, r), pairwise complete, of any number of columns in one scan.

    r is NULL where either side is constant over the rows in which both are known. Every task adds up blocked Gram matrices of
    its rows, of values and of masks of what is known, and gives each block's counts, means and centred sums away; blocks
    of one place are merged one after the other, so that no task holds more than its own matrices and one block.
    """
    values = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    blocks = values.mapInArrow(_gram_blocks, "bx int, by int, sums binary")
    merged = blocks.repartition("bx", "by").sortWithinPartitions("bx", "by").mapInArrow(_merged_blocks(len(columns)), "pos_x int, pos_y int, r double")
    names = rows_frame(df.sparkSession, list(enumerate(columns)), "pos int, name string")  # a row per column
    x = names.select(F.col("pos").alias("pos_x"), F.col("name").alias("col_x"), F.explode(F.sequence("pos", F.lit(len(columns) - 1))).alias("pos_y"))
    every = x.join(F.broadcast(names.select(F.col("pos").alias("pos_y"), F.col("name").alias("col_y"))), "pos_y")
    return every.join(merged, ["pos_x", "pos_y"], "left").select("pos_x", "pos_y", "col_x", "col_y", "r")


#: Columns on a side of a block. Centred sums below this share of the raw ones are rounding of a constant.
BLOCK_COLUMNS, ROUNDING = 64, 1e-13


def _gram_blocks(batches):
    """Per pair of columns, over the rows of this task where both are known: count, means and centred sums of squares and products."""
    shift = fixed = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
        known = ~np.isnan(x)
        if shift is None:
            width = x.shape[1]
            shift, fixed = np.zeros(width), np.zeros(width, bool)
            n, sx, sxx, sxy = np.zeros((4, width, width))
        new = known.any(axis=0) & ~fixed  # a column's first value is its origin: constants become exact zeros
        shift[new] = x[known.argmax(axis=0)[new], new]
        fixed |= new
        d, m = np.where(known, x - shift, 0.0), known.astype(float)
        n, sx, sxx, sxy = n + m.T @ m, sx + d.T @ m, sxx + (d * d).T @ m, sxy + d.T @ d
    if shift is None:
        return
    some = np.maximum(n, 1)
    mean = sx / some
    cxx = sxx - sx * mean
    cxx[cxx <= ROUNDING * sxx] = 0.0
    sums = np.array([n, shift[:, None] + mean, shift[None, :] + mean.T, cxx, cxx.T, sxy - sx * mean.T])
    for bx in range(0, len(shift), BLOCK_COLUMNS):
        at, cells = [], []
        for by in range(bx, len(shift), BLOCK_COLUMNS):
            at.append(by // BLOCK_COLUMNS)
            cells.append(np.ascontiguousarray(sums[:, bx:bx + BLOCK_COLUMNS, by:by + BLOCK_COLUMNS]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([bx // BLOCK_COLUMNS] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(cells, pa.binary())], names=["bx", "by", "sums"])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, means and centred sums of two sets of rows taken together."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    dx, dy = (np.where(a[0] * b[0] > 0, b[k] - a[k], 0.0) for k in (1, 2))
    mean = [np.where(a[0] > 0, a[k], b[k]) + d * b[0] / some for k, d in ((1, dx), (2, dy))]
    both = a[0] * b[0] / some
    return np.array([n, *mean, a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both])


def _merged_blocks(width: int):
    def rows(bx, by, sums):
        n, _, _, cxx, cyy, cxy = sums
        i, j = np.nonzero(np.ones_like(n))
        x, y = i + bx * BLOCK_COLUMNS, j + by * BLOCK_COLUMNS
        scale = np.sqrt(cxx[i, j]) * np.sqrt(cyy[i, j])
        keep = (x <= y) & (scale > 0)
        x, y, r = x[keep], y[keep], cxy[i, j][keep] / scale[keep]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(r)], names=["pos_x", "pos_y", "r"])

    def run(batches):
        at = held = None
        for batch in batches:
            for bx, by, raw in zip(*(batch[c].to_pylist() for c in ("bx", "by", "sums"))):
                shape = (6, min(BLOCK_COLUMNS, width - bx * BLOCK_COLUMNS), min(BLOCK_COLUMNS, width - by * BLOCK_COLUMNS))
                sums = np.frombuffer(raw).reshape(shape)
                if (bx, by) == at:
                    held = _merged(held, sums)
                    continue
                if at is not None:
                    yield rows(*at, held)
                at, held = (bx, by), sums
        if at is not None:
            yield rows(*at, held)
    return run


def corr_matrix(df: DataFrame, columns: list[str], triangle: DataFrame | None = None) -> DataFrame:
    """Full matrix in long form (col_x, col_y, r); empty below two columns."""
    if len(columns) < 2:
        return rows_frame(df.sparkSession, [], "col_x string, col_y string, r double")
    upper = correlations(df, columns) if triangle is None else triangle
    both = F.array(F.struct(F.col("col_x").alias("a"), F.col("col_y").alias("b")),
                   F.struct(F.col("col_y").alias("a"), F.col("col_x").alias("b")))
    sides = F.when(F.col("pos_x") == F.col("pos_y"), F.slice(both, 1, 1)).otherwise(both)
    return upper.select(F.explode(sides).alias("s"), "r").select(
        F.col("s.a").alias("col_x"), F.col("s.b").alias("col_y"), "r")


def strong_corr(df: DataFrame, columns: list[str], threshold: float = fv.STRONG_CORRELATION,
                triangle: DataFrame | None = None) -> DataFrame:
    """Pairs with |r| at or above the threshold, strongest first."""
    if len(columns) < 2:
        return rows_frame(df.sparkSession, [], "col_x string, col_y string, r double")
    upper = correlations(df, columns) if triangle is None else triangle
    strong = upper.filter((F.col("pos_x") < F.col("pos_y")) & (F.abs("r") >= threshold))
    return strong.orderBy(F.abs("r").desc(), "pos_x", "pos_y").select("col_x", "col_y", "r")
