"""Column facts: one aggregate that every profiling rule reads."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import (
    col,
    is_float,
    is_missing,
    number,
    numeric_columns,
    plain_columns,
    present,
    string_columns,
)

@dataclass
class Facts:
    """Schema-sized facts about one frame."""

    rows: int
    missing: dict[str, int]
    minimum: dict[str, float | None] = field(default_factory=dict)
    mean_length: dict[str, float | None] = field(default_factory=dict)
    distinct: dict[str, int] = field(default_factory=dict)


def long_form(aggregated: DataFrame, entries: list[Column]) -> DataFrame:
    """One wide aggregate row -> one row per struct in `entries`."""
    return aggregated.select(F.inline(F.array(*entries)))


def column_facts(df: DataFrame) -> Facts:
    """Row count, missing, minimum and mean text length in one pass; exact distinct counts, at every size, in another."""
    names, plain = df.columns, plain_columns(df)
    numbers, strings = numeric_columns(df), string_columns(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)]
    aggs += [F.min(number(df, c)).alias(f"x{i}") for i, c in enumerate(numbers)]
    aggs += [F.avg(F.coalesce(F.length(col(c)), F.lit(3))).alias(f"l{i}") for i, c in enumerate(strings)]
    row = df.agg(*aggs).first()
    facts = Facts(
        rows=row["n"],
        missing={c: row[f"m{i}"] for i, c in enumerate(names)},
        minimum={c: row[f"x{i}"] for i, c in enumerate(numbers)},
        mean_length={c: row[f"l{i}"] for i, c in enumerate(strings)},
    )
    facts.distinct = exact_distinct(df, plain)
    return facts


def exact_distinct(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct counts (missing not counted) of many columns in one scan and one shuffle.

    Tasks find the distinct values of each column in their batches, so a row is never copied for its columns. What is
    shuffled are keys (column, value), combined per task; a text of more than LONG_TEXT bytes travels as a 128-bit hash.
    """
    if not columns:
        return {}
    texts = []
    for i, c in enumerate(columns):
        v = present(df, c)
        texts.append((v + F.lit(0.0) if is_float(df, c) else v).cast("string").alias(f"c{i}"))  # -0.0 is 0.0
    keys = df.select(*texts).mapInArrow(_distinct_keys, "at int, key binary")
    counted = keys.groupBy("at", "key").agg(F.lit(1).alias("one")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    found = {r["at"]: r["n"] for r in counted.collect()}  # a row per column
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


#: Bytes up to which a text is its own key; distinct values of a column that a task holds before it gives them away.
LONG_TEXT, HELD_VALUES = 48, 200_000


def _distinct_keys(batches):
    held, size = {}, {}

    def keys(at):
        values = pa.chunked_array(held.pop(at)).unique().cast(pa.binary())
        size.pop(at)
        long = pc.greater(pc.binary_length(values), LONG_TEXT)
        if pc.any(long).as_py():
            values = pa.array([hashlib.blake2b(v, digest_size=16).digest() + b"#" if x else v for v, x in zip(values.to_pylist(), long.to_pylist())], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), at, np.int32)), values], names=["at", "key"])

    for batch in batches:
        for at, column in enumerate(batch.columns):
            fresh = column.unique().drop_null()
            if not len(fresh):
                continue
            held.setdefault(at, []).append(fresh)
            size[at] = size.get(at, 0) + len(fresh)
            if size[at] > HELD_VALUES:  # repeats of earlier batches go first
                held[at] = [pa.chunked_array(held[at]).combine_chunks().unique()]
                size[at] = len(held[at][0])
                if size[at] > HELD_VALUES // 2:
                    yield keys(at)
    for at in list(held):
        yield keys(at)
