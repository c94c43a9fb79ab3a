"""The ten cleaning steps, each usable alone, and their composition with a step report."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens import fixed_values as fv
from tabulens.functions.columns import (
    NESTED,
    col,
    float_columns,
    is_float,
    is_missing,
    number,
    numeric_columns,
    present,
    string_columns,
)
from tabulens.operators.outliers import iqr_bounds, iqr_cap, iqr_flag
from tabulens.operators.stats import value_counts
from tabulens.plans.order_stats import exact_quantiles
from tabulens.plans.ordered import fill_ordered
from tabulens.plans.workspace import rows_frame, written

REPORT_SCHEMA = ("step_number int, step_name string, executed boolean, skipped boolean, skip_reason string, "
                 "messages array<string>, nothing_to_do boolean")


class TooFewRows(ValueError):
    """Fewer rows than later work needs are left after cleaning."""


@dataclass
class Step:
    number: int
    messages: list[str] = field(default_factory=list)
    skip_reason: str = ""

    def row(self) -> tuple:
        idle = not self.skip_reason and not self.messages
        said = ["✅ No action needed"] if idle else self.messages
        skipped = bool(self.skip_reason)
        return (self.number, fv.CLEANING_STEPS[self.number - 1], not skipped, skipped, self.skip_reason, said, idle)


# Step 1 ---------------------------------------------------------------------------------------------------------

def clean_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.lower().strip())


def clean_names(df: DataFrame) -> DataFrame:
    """Lower-case, trim, blanks to `_`; of equal names the first column stays. Works by position."""
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    first: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        first.setdefault(clean_name(c), i)
    return numbered.select(*[F.col(f"c{i}").alias(c) for c, i in first.items()])


# Step 2 ---------------------------------------------------------------------------------------------------------

def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


# Step 3 ---------------------------------------------------------------------------------------------------------

def missing_share(df: DataFrame) -> tuple[int, dict[str, int]]:
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return row["n"], {c: row[f"m{i}"] for i, c in enumerate(df.columns)}


def drop_sparse_cols(df: DataFrame, threshold: float = fv.SPARSE_COLUMN_RATIO) -> DataFrame:
    n, missing = missing_share(df)
    return df.select(*[col(c) for c in df.columns if not n or missing[c] / n <= threshold])


def fill_bfill_ffill(df: DataFrame, columns: list[str], partition_by: list[str], order_by: list[str], **sizes) -> DataFrame:
    """Next known value, else the previous one, along the order inside each partition."""
    nan_free = df.select(*[present(df, c).alias(c) if c in columns else col(c) for c in df.columns])
    return fill_ordered(nan_free, partition_by, order_by, {c: (c, True) for c in columns}, **sizes)


def fill_values(df: DataFrame, columns: list[str], empty_text: str = "missing") -> dict[str, object]:
    """Median per numeric column, most frequent value (ties: smallest) per other column."""
    numbers = [c for c in columns if c in set(numeric_columns(df))]
    others = [c for c in columns if c not in numbers]
    medians = exact_quantiles(df, {c: number(df, c) for c in numbers}, [0.5])
    values: dict[str, object] = {c: 0.0 if q[0] is None else q[0] for c, q in medians.items()}
    if others:
        modes = value_counts(df, others).groupBy("column").agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect()
        found = {r["column"]: r["mode"] for r in modes}
        values.update({c: found.get(c, empty_text) for c in others})
    return values


def _fill_with(df: DataFrame, name: str, value: object) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(col(name), F.lit(value))
    if isinstance(value, str):
        return F.coalesce(col(name), F.lit(value).try_cast(kind))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(present(df, name), F.lit(value))
    return F.coalesce(col(name).cast("double"), F.lit(value))


def fill_median_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns if columns is not None else [c for c, m in missing_share(df)[1].items() if m]
    values = fill_values(df, columns)
    return df.select(*[_fill_with(df, c, values[c]).alias(c) if c in values else col(c) for c in df.columns])


# Step 4 ---------------------------------------------------------------------------------------------------------

def as_timestamp(c: Column, form: str = "ISO") -> Column:
    return F.try_to_timestamp(c) if form == "ISO" else F.try_to_timestamp(F.trim(c), F.lit(form))


def as_number(c: Column) -> Column:
    """A text as DOUBLE if it is written as a number (no type suffixes)."""
    return F.when(F.trim(c).rlike(fv.NUMBER_FORM), F.trim(c).try_cast("double"))


def text_forms(df: DataFrame, names: list[str] | None = None) -> tuple[int, dict[str, dict]]:
    """Rows, and per text column: known values, numbers, the date format that reads most values (earlier ones first) and how many."""
    names = string_columns(df) if names is None else names
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        aggs += [F.count(col(c)).alias(f"k{i}"), F.count(as_number(col(c))).alias(f"d{i}")]
        aggs += [F.count(as_timestamp(col(c), f)).alias(f"t{i}_{j}") for j, f in enumerate(fv.DATE_FORMATS)]
    row, out = df.agg(*aggs).first(), {}
    for i, c in enumerate(names):
        dates = [row[f"t{i}_{j}"] for j in range(len(fv.DATE_FORMATS))]
        best = max(range(len(dates)), key=lambda j: (dates[j], -j))
        out[c] = {"known": row[f"k{i}"], "numbers": row[f"d{i}"], "dates": dates[best], "form": fv.DATE_FORMATS[best]}
    return row["n"], out


def text_types(df: DataFrame) -> dict[str, str]:
    """For each text column: numeric (every value reads), `datetime` with its format (half of the rows read) or text."""
    n, forms = text_forms(df) if string_columns(df) else (0, {})
    out = {}
    for c, f in forms.items():
        if f["known"] == f["numbers"]:
            out[c] = "numeric"
        elif n and f["dates"] / n >= fv.DATETIME_PARSE_RATIO:
            out[c] = "datetime" if f["form"] == "ISO" else f"datetime {f['form']}"
        else:
            out[c] = "text"
    return out


def retyped(c: str, kind: str) -> Column:
    if kind == "numeric":
        return as_number(col(c))
    return as_timestamp(col(c), kind.partition(" ")[2] or "ISO") if kind.startswith("datetime") else col(c)


def fix_types(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    kinds = text_types(df) if kinds is None else kinds
    return df.select(*[retyped(c, kinds.get(c, "text")).alias(c) for c in df.columns])


def detect_datetime_cols(df: DataFrame) -> DataFrame:
    """Text columns whose every value reads as a timestamp in one format."""
    forms = text_forms(df)[1] if string_columns(df) else {}
    return rows_frame(df.sparkSession, [(c, f["dates"] == f["known"]) for c, f in forms.items()], "column string, is_datetime boolean")


# Step 5 ---------------------------------------------------------------------------------------------------------

def clean_text(df: DataFrame, columns: list[str] | None = None, tokens: list[str] | None = None) -> DataFrame:
    """Lower-case and trim; cells that spell a missing value become NULL."""
    columns = string_columns(df) if columns is None else columns
    tokens = fv.NULL_TOKENS if tokens is None else tokens
    def cleaned(c):
        t = F.trim(F.lower(col(c)))
        return F.when(~t.isin(*tokens), t)
    return df.select(*[cleaned(c).alias(c) if c in columns else col(c) for c in df.columns])


# Step 6 ---------------------------------------------------------------------------------------------------------

def inf_to_null(df: DataFrame) -> DataFrame:
    """NaN and both infinities become NULL in every float column."""
    floats = set(float_columns(df))
    bad = F.lit(float("inf"))
    return df.select(*[F.when(~F.isnan(col(c)) & (F.abs(col(c)) != bad), col(c)).alias(c) if c in floats else col(c) for c in df.columns])


# Steps 7 and 8 --------------------------------------------------------------------------------------------------

def drop_constant_cols(df: DataFrame, protect: list[str] = ()) -> DataFrame:
    constant = set(_constant(df)) - set(protect)
    return df.select(*[col(c) for c in df.columns if c not in constant])


def _flat(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]


def _constant(df: DataFrame) -> list[str]:
    """Columns with one value, a missing value counting as one. Minimum and maximum suffice, no distinct count."""
    names = _flat(df)
    if not names:
        return []
    aggs = []
    for i, c in enumerate(names):
        v = present(df, c)
        aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.max(is_missing(df, c)).alias(f"h{i}")]
    row, out = df.agg(*aggs).first(), []
    for i, c in enumerate(names):
        low, high, hole = row[f"a{i}"], row[f"b{i}"], row[f"h{i}"]
        if (low is None and hole) or (low is not None and low == high and not hole):
            out.append(c)
    return out


def _identifiers(df: DataFrame, include_numeric: bool, protect) -> list[str]:
    """Columns whose values are all different, a missing value counting as one."""
    numbers = set() if include_numeric else set(numeric_columns(df))
    names = [c for c in _flat(df) if c not in numbers and c not in set(protect)]
    if not names:
        return []
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        aggs += [F.approx_count_distinct(present(df, c)).alias(f"d{i}"), F.count_if(is_missing(df, c)).alias(f"h{i}")]
    row = df.agg(*aggs).first()
    n = row["n"]
    # A unique column's estimate is within six standard errors (30 %) of n; only such columns are counted exactly.
    likely = [c for i, c in enumerate(names) if row[f"h{i}"] <= 1 and row[f"d{i}"] >= 0.7 * (n - row[f"h{i}"])]
    if not likely:
        return []
    exact = df.agg(*[(F.count_distinct(present(df, c)) + F.max(is_missing(df, c).cast("int"))).alias(f"e{i}") for i, c in enumerate(likely)]).first()
    return [c for i, c in enumerate(likely) if exact[i] == n]


def drop_id_cols(df: DataFrame, include_numeric: bool = False, protect: list[str] = ()) -> DataFrame:
    ids = set(_identifiers(df, include_numeric, protect))
    return df.select(*[col(c) for c in df.columns if c not in ids])


# Step 10 --------------------------------------------------------------------------------------------------------

def _fits_float(df: DataFrame, columns: list[str]) -> list[str]:
    if not columns:
        return []
    gaps = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        gaps.append(F.max(F.abs(v - v.cast("float").cast("double"))).alias(f"g{i}"))
    row = df.agg(*gaps).first()
    return [c for i, c in enumerate(columns) if row[i] is None or row[i] <= fv.FLOAT32_TOLERANCE]


def downcast(df: DataFrame, protect: list[str] = ()) -> DataFrame:
    """BIGINT and DOUBLE columns become FLOAT where no value moves by more than the tolerance."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.DoubleType)) and f.name not in set(protect)]
    fits = set(_fits_float(df, wide))
    return df.select(*[col(c).cast("float").alias(c) if c in fits else col(c) for c in df.columns])


# All ten --------------------------------------------------------------------------------------------------------

def clean_full(
    df: DataFrame,
    order_by: list[str],
    partition_by: list[str] = (),
    protect: list[str] = (),
    fill: str = "bfill_ffill",
    outliers: str = "remove",
    id_numeric: bool = False,
    null_tokens: list[str] | None = None,
    **sizes,
) -> tuple[DataFrame, DataFrame]:
    """The ten steps in order -> (cleaned frame, ten-row report).

    Order, partition and protected columns are never dropped, outlier-tested or downcast.
    """
    spark = df.sparkSession
    order_by, partition_by = [clean_name(c) for c in order_by], [clean_name(c) for c in partition_by]
    keep = list(dict.fromkeys([*order_by, *partition_by, *[clean_name(c) for c in protect]]))
    steps = [Step(i + 1) for i in range(10)]

    renamed = [(c, clean_name(c)) for c in df.columns]
    steps[0].messages = [f"{old} → {new}" for old, new in renamed if old != new]
    df = clean_names(df)

    before = df.count()
    df = written(dedup_rows(df), "dedup")
    n, missing = missing_share(df)
    if before > n:
        steps[1].messages.append(f"Removed {before - n} duplicate rows")

    sparse = [c for c in df.columns if n and missing[c] / n > fv.SPARSE_COLUMN_RATIO and c not in keep]
    holes = [c for c in df.columns if missing[c] and c not in sparse]
    how = "bfill/ffill" if fill == "bfill_ffill" else "median/mode"
    for c in df.columns:
        share = int(missing[c] / n * 100) if n else 0
        if c in sparse:
            steps[2].messages.append(f"{c}: dropped (>{share}% missing)")
        elif c in holes:
            steps[2].messages.append(f"{c}: filled {share}% missing using {how}")
    df = df.select(*[col(c) for c in df.columns if c not in sparse])
    if holes:
        if fill == "bfill_ffill":
            df = written(fill_bfill_ffill(df, holes, partition_by, order_by, **sizes), "filled")
            holes = [c for c, m in missing_share(df.select(*[col(c) for c in holes]))[1].items() if m]
        if holes:
            df = written(fill_median_mode(df, holes), "filled")

    kinds = {c: k for c, k in text_types(df).items() if c not in keep}
    steps[3].messages = [f"{c}: object → {k}" for c, k in kinds.items() if k != "text"]
    if not string_columns(df):
        steps[3].skip_reason = "No object-typed columns to convert"
    df = fix_types(df, kinds)

    texts = [c for c in string_columns(df) if c not in keep]
    if texts:
        steps[4].messages.append(f"Cleaned {len(texts)} text column(s): {texts}")
        df = clean_text(df, texts, null_tokens)
    else:
        steps[4].skip_reason = "No text (object) columns found"

    floats = [c for c in df.columns if is_float(df, c)]
    if not numeric_columns(df):
        steps[5].skip_reason = "No numeric columns to check for infinite values"
    elif floats:
        row = df.agg(*[F.max(F.abs(col(c)) == F.lit(float("inf"))).alias(f"i{i}") for i, c in enumerate(floats)]).first()
        infinite = [c for i, c in enumerate(floats) if row[i]]
        if infinite:
            steps[5].messages.append(f"Replaced ±inf in {len(infinite)} column(s): {infinite}")
        df = inf_to_null(df)

    constant = [c for c in _constant(df) if c not in keep]
    if constant:
        steps[6].messages.append(f"Dropped {len(constant)} constant column(s): {constant}")
        df = df.select(*[col(c) for c in df.columns if c not in constant])
    ids = _identifiers(df, id_numeric, keep)
    if ids:
        steps[7].messages.append(f"Dropped {len(ids)} identifier column(s): {ids}")
        df = df.select(*[col(c) for c in df.columns if c not in ids])

    measured = [c for c in numeric_columns(df) if c not in keep]
    if not measured:
        steps[8].skip_reason = "No numeric columns for IQR outlier detection"
    elif outliers == "remove":
        left = n
        for c in measured:
            bounds = iqr_bounds(df, [c]).get(c)
            if not bounds or bounds[2] == 0:
                continue
            df = df.filter(number(df, c).between(F.lit(bounds[0]), F.lit(bounds[1])))
            now = df.count()
            if now < left:
                steps[8].messages.append(f"{c}: removed {left - now} outlier row(s)")
            left = now
    elif outliers == "cap":
        df = iqr_cap(df, measured)
        steps[8].messages.append(f"Capped outliers in {measured}")
    elif outliers == "flag":
        df = iqr_flag(df, measured)
        steps[8].messages.append(f"Flagged outliers of {measured}")

    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.DoubleType)) and f.name not in keep]
    if wide:
        steps[9].messages.append(f"Downcast {len(wide)} column(s) to save memory; index reset")
        df = downcast(df, keep)

    if len(df.take(fv.MIN_ROWS_AFTER_CLEANING)) < fv.MIN_ROWS_AFTER_CLEANING:
        raise TooFewRows("❌ Dataset has < 2 rows after cleaning — cannot proceed")
    return df, rows_frame(spark, [s.row() for s in steps], REPORT_SCHEMA)
