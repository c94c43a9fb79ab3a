"""Column expressions and joins that the operators of this subpackage share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group with more than one in HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such groups.
HOT_SHARE = 1000
#: Rows of an Arrow batch that carries texts.
TEXT_BATCH = 1000
#: Longs of a broadcast bitmap of keys, at most (a power of two).
FILTER_SLOTS = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of single-byte characters take the built-in, which is much faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text (null becomes empty), under names no further column can clash with."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def with_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int, share: int = HOT_SHARE) -> DataFrame:
    """`rows` left-joined with `groups` (unique non-null `on`, `size` = number of rows of the group).

    Groups of more than total / `share` rows are hot. There are fewer than `share` of them by this definition, so they are
    broadcast, and no task gathers the rows of one. Every other group goes through a shuffle. Null keys match nothing.
    """
    hot = groups.filter(F.col(size) > total / share)
    cold = groups.filter(F.col(size) <= total / share)
    named = [c for c in groups.columns if c != on]
    first = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left")
    done = first.filter(F.col("__hot")).drop("__hot")
    rest = first.filter(F.col("__hot").isNull()).drop("__hot", *named).join(cold, on, "left")
    return done.unionByName(rest)


def text_batches(spark: SparkSession) -> None:
    """Python tasks of this session get at most TEXT_BATCH rows at once, as each holds a whole text."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_BATCH:
        spark.conf.set(name, TEXT_BATCH)


def may_hold(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, count: int) -> DataFrame:
    """`rows` with `__may`: false where no row of `wanted` (about `count` of them) has the row's key, which is a long.

    A bitmap of at most FILTER_SLOTS longs is broadcast, whatever the number of keys; where it fills up, more rows say true.
    So wide rows that a join would drop don't travel to it.
    """
    slots = min(FILTER_SLOTS, 1 << max(10, (count // 8).bit_length()))
    place, bit = lambda k: F.pmod(k, F.lit(slots)), lambda k: F.pmod(F.shiftrightunsigned(F.xxhash64(k), 20), F.lit(64)).cast("int")
    table = wanted.select(place(wanted_key).alias("__place"), bit(wanted_key).alias("__bit")).groupBy("__place").agg(
        F.expr("bit_or(shiftleft(CAST(1 AS BIGINT), __bit))").alias("__bits"))
    keyed = rows.withColumn("__key", key).withColumn("__place", place(F.col("__key")))
    found = keyed.join(F.broadcast(table), "__place", "left")
    return found.withColumn("__may", F.coalesce(F.getbit("__bits", bit(F.col("__key"))) == 1, F.lit(False))).drop("__key", "__place", "__bits")


def uniform(*cols: Column) -> Column:
    """A reproducible value in (0, 1) from the hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(2**53))
