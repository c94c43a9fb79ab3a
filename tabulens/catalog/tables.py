"""Test tables and the dirty frames derived from them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.columns import HASH_FACTOR, HASH_SEED_STEP, HASH_SHIFT, HASH_SPACE


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dirty_events(spark: SparkSession, sf: str) -> DataFrame:
    """events with holes in `value` and repeated rows."""
    e = table(spark, sf, "events")
    holes = e.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return holes.unionByName(holes.filter(F.col("event_id") % 10 == 0))


DIRTY = """holes AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value, props FROM events),
dirty AS (SELECT * FROM holes UNION ALL SELECT * FROM holes WHERE event_id % 10 = 0)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0), integers widened, so that engines can be compared value by value."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def hash_sql(key: str, seed: int = 0) -> str:
    """The row hash as SQL text."""
    h = f"((CAST({key} AS BIGINT) + {seed * HASH_SEED_STEP}) % {HASH_SPACE})"
    for _ in range(2):
        h = f"(({h} * {HASH_FACTOR} + {HASH_SHIFT}) % {HASH_SPACE})"
        h = f"xor({h}, {h} >> 16)"
    return h


def unit_sql(key: str, seed: int = 0) -> str:
    return f"(({hash_sql(key, seed)} + 0.5::DOUBLE) / {HASH_SPACE}::DOUBLE)"


def r(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
