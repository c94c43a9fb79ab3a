"""Column helpers: type classes, missing-value normalisation, arithmetic hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
NUMBERS = INTEGERS + FLOATS + (T.DecimalType,)
DATETIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.NullType)

# Fixed values of the arithmetic row hash: twice h = (h * HASH_FACTOR + HASH_SHIFT) mod HASH_SPACE, h = h xor (h >> 16).
HASH_FACTOR = 1103515245
HASH_SHIFT = 12345
HASH_SPACE = 4294967296
HASH_SEED_STEP = 7919


def col(name: str) -> Column:
    """Column by its exact name, safe for dots and blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame, kinds: tuple, exclude=()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return columns_of(df, NUMBERS, exclude)


def float_columns(df: DataFrame, exclude=()) -> list[str]:
    return columns_of(df, FLOATS, exclude)


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return columns_of(df, (T.StringType,), exclude)


def datetime_columns(df: DataFrame, exclude=()) -> list[str]:
    return columns_of(df, DATETIMES, exclude)


def plain_columns(df: DataFrame, exclude=()) -> list[str]:
    """Every column that is not nested, binary or void."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED) and f.name not in skip]


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FLOATS)


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL (infinities stay)."""
    if is_float(df, name):
        return F.when(F.isnan(col(name)), F.lit(None)).otherwise(col(name))
    return col(name)


def number(df: DataFrame, name: str) -> Column:
    """The numeric column as DOUBLE with NaN and infinities read as NULL."""
    if is_float(df, name):
        return finite(col(name).cast("double"))
    return col(name).cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    if is_float(df, name):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def sample_skew(skew: float | None, n: int) -> float | None:
    """Bias-corrected skewness from the population form."""
    if skew is None or n < 3:
        return None
    return skew * (n * (n - 1)) ** 0.5 / (n - 2)


def sample_kurtosis(kurt: float | None, n: int) -> float | None:
    """Bias-corrected excess kurtosis from the population form."""
    if kurt is None or n < 4:
        return None
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)


def row_hash(key: Column, seed: int = 0) -> Column:
    """Repeatable 32-bit hash of an integer key, one-to-one below 2^32; any SQL engine can run the same arithmetic."""
    h = F.pmod(key.cast("long") + F.lit(seed * HASH_SEED_STEP), F.lit(HASH_SPACE))
    for _ in range(2):
        h = F.pmod(h * F.lit(HASH_FACTOR) + F.lit(HASH_SHIFT), F.lit(HASH_SPACE))
        h = h.bitwiseXOR(F.shiftright(h, 16))
    return h


def unit_hash(key: Column, seed: int = 0) -> Column:
    """Repeatable number in (0, 1) for an integer key."""
    return (row_hash(key, seed) + F.lit(0.5)) / F.lit(float(HASH_SPACE))


def micros(df: DataFrame, name: str) -> Column:
    """Datetime column as microseconds since 1970."""
    zero = F.lit("1970-01-01 00:00:00").cast(df.schema[name].dataType)
    return F.timestamp_diff("MICROSECOND", zero, col(name))


def row_number_of(df: DataFrame, key: str) -> Column:
    """A key as a number: whole numbers as they are, any other type by its 64-bit hash."""
    whole = df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return col(key).cast("long") if whole else F.xxhash64(col(key))
