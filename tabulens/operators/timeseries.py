"""Sensor features over an explicit order: rolling, lag, difference, rate of change, z-score, date parts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens import fixed_values as fv
from tabulens.functions.columns import col, datetime_columns, finite, number, numeric_columns, string_columns
from tabulens.operators.clean import as_timestamp, text_forms
from tabulens.operators.stats import mean_std
from tabulens.plans.order_stats import exact_quantiles
from tabulens.plans.ordered import fill_ordered, with_windows
from tabulens.plans.workspace import rows_frame, written

PARTS = ["hour", "day", "month", "weekday"]


def rolling_mean(c: Column, w: WindowSpec, window: int) -> Column:
    return F.avg(c).over(w.rowsBetween(-(window - 1), 0))


def rolling_std(c: Column, w: WindowSpec, window: int) -> Column:
    """Sample std of the known values in the window; 0 where it does not exist."""
    return F.coalesce(F.stddev_samp(c).over(w.rowsBetween(-(window - 1), 0)), F.lit(0.0))


def add_rolling(df: DataFrame, column: str, partition_by: list[str], order_by: list[str], window: int = 5, **sizes) -> DataFrame:
    v = number(df, column)
    return with_windows(df, partition_by, order_by, lambda w: {
        f"{column}_rolling_mean_{window}": rolling_mean(v, w, window),
        f"{column}_rolling_std_{window}": rolling_std(v, w, window)}, window - 1, **sizes)


def add_lags(df: DataFrame, column: str, partition_by: list[str], order_by: list[str], steps: int = 2, **sizes) -> DataFrame:
    v = number(df, column)
    return with_windows(df, partition_by, order_by,
                        lambda w: {f"{column}_lag_{k}": F.lag(v, k).over(w) for k in range(1, steps + 1)}, steps, **sizes)


def add_diff(df: DataFrame, column: str, partition_by: list[str], order_by: list[str], **sizes) -> DataFrame:
    v = number(df, column)
    return with_windows(df, partition_by, order_by, lambda w: {f"{column}_diff": v - F.lag(v, 1).over(w)}, 1, **sizes)


def rate_of_change(filled: Column, w: WindowSpec) -> Column:
    """Percent change of a forward-filled series; division by zero gives NULL."""
    return (F.try_divide(filled, F.lag(filled, 1).over(w)) - F.lit(1.0)) * F.lit(100.0)


def add_rate_of_change(df: DataFrame, column: str, partition_by: list[str], order_by: list[str], **sizes) -> DataFrame:
    known, carried = "__known", "__carried"
    base = df.withColumn(known, number(df, column))
    filled = fill_ordered(base, partition_by, order_by, {carried: (known, False)}, **sizes)
    out = with_windows(filled, partition_by, order_by,
                       lambda w: {f"{column}_rate_of_change": rate_of_change(col(carried), w)}, 1, **sizes)
    return out.drop(known, carried)


def add_zscore(df: DataFrame, column: str) -> DataFrame:
    """(x - mean) / sample std over the whole table; no column if the std is zero or undefined."""
    mean, std = mean_std(df, [column])[column]
    if not std:
        return df
    return df.withColumn(f"{column}_zscore", (number(df, column) - F.lit(mean)) / F.lit(std))


def find_date_column(df: DataFrame) -> str | None:
    """First text column named like a date, else the first datetime column."""
    for c in string_columns(df):
        if any(word in c.lower() for word in fv.DATE_NAME_WORDS):
            return c
    found = datetime_columns(df)
    return found[0] if found else None


def datetime_parts(df: DataFrame, column: str | None = None) -> DataFrame:
    """Hour, day, month and weekday (Monday = 0) of the date column; the frame unchanged if there is none."""
    column = column or find_date_column(df)
    if column is None or column not in df.columns:
        return df
    if isinstance(df.schema[column].dataType, T.StringType):
        df = df.withColumn(column, as_timestamp(col(column), text_forms(df, [column])[1][column]["form"]))
    elif not isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df
    c = col(column)
    forms = [F.hour(c.cast("timestamp") if isinstance(df.schema[column].dataType, T.DateType) else c),
             F.dayofmonth(c), F.month(c), F.weekday(c)]
    names = [f"{column}_{p}" for p in PARTS]
    kept = [col(x) for x in df.columns if x not in names]
    return df.select(*kept, *[f.alias(n) for n, f in zip(names, forms)])


def feature_inputs(df: DataFrame, exclude_match: str = "token", exclude: list[str] = ()) -> list[str]:
    """Numeric columns that get features; names holding an excluded word are left out."""
    def excluded(name: str) -> bool:
        low = name.lower()
        if exclude_match == "substring":
            return any(word in low for word in fv.FEATURE_EXCLUDE_WORDS)
        tokens = low.split("_")
        return any(word.strip("_") in tokens for word in fv.FEATURE_EXCLUDE_WORDS)
    return [c for c in numeric_columns(df, exclude) if not excluded(c)]


@dataclass
class SeriesState:
    """What engineering learned from the training rows, reused on new rows."""

    columns: list[str]
    window: int
    lag_steps: int
    centre: dict[str, float] = field(default_factory=dict)
    spread: dict[str, float] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)


def engineer_features(
    df: DataFrame,
    order_by: list[str],
    partition_by: list[str] = (),
    numeric_cols: list[str] | None = None,
    window: int = 5,
    lag_steps: int = 2,
    drop_original: bool = False,
    exclude_match: str = "token",
    state: SeriesState | None = None,
    date_column: str | None = None,
    exclude: list[str] = (),
    **sizes,
) -> tuple[DataFrame, SeriesState]:
    """All features of the chosen columns in one window pass, missing ones filled with their median.

    Pass the `state` of an earlier call to apply the same centring and medians to new rows.
    """
    partition_by, date = list(partition_by), date_column or find_date_column(df)
    with_parts = datetime_parts(df, date)
    if state is None:
        cols = numeric_cols if numeric_cols is not None else feature_inputs(with_parts, exclude_match, exclude)
        state = SeriesState([c for c in cols if c in df.columns], window, lag_steps)
        for c, (mean, std) in mean_std(df, state.columns).items():
            if std:
                state.centre[c], state.spread[c] = mean, std
    window, cols = state.window, state.columns
    if not cols:
        return with_parts, state

    known = {c: f"__v{i}" for i, c in enumerate(cols)}
    carried = {c: f"__f{i}" for i, c in enumerate(cols)}
    base = with_parts.select("*", *[number(df, c).alias(known[c]) for c in cols])
    base = fill_ordered(base, partition_by, order_by, {carried[c]: (known[c], False) for c in cols}, **sizes)

    def build(w: WindowSpec) -> dict[str, Column]:
        new = {}
        for c in cols:
            v, f = col(known[c]), col(carried[c])
            new[f"{c}_rolling_mean_{window}"] = rolling_mean(v, w, window)
            new[f"{c}_rolling_std_{window}"] = rolling_std(v, w, window)
            for k in range(1, state.lag_steps + 1):
                new[f"{c}_lag_{k}"] = F.lag(v, k).over(w)
            new[f"{c}_diff"] = v - F.lag(v, 1).over(w)
            new[f"{c}_rate_of_change"] = rate_of_change(f, w)
            if c in state.spread:
                new[f"{c}_zscore"] = (v - F.lit(state.centre[c])) / F.lit(state.spread[c])
        return new

    features = list(build_names(state))
    out = with_windows(base, partition_by, order_by, build, max(window - 1, state.lag_steps, 1), **sizes)
    out = out.drop(*known.values(), *carried.values())
    out = out.select(*[finite(col(c)).alias(c) if c in features else col(c) for c in out.columns])
    if not state.medians:
        out = written(out, "features")
        state.medians = _medians_where_missing(out, features)
    filled = {c: F.coalesce(col(c), F.lit(state.medians.get(c, 0.0))) for c in features}
    dropped = set(cols) if drop_original else set()
    return out.select(*[filled[c].alias(c) if c in filled else col(c) for c in out.columns if c not in dropped]), state


def build_names(state: SeriesState) -> list[str]:
    names = []
    for c in state.columns:
        names += [f"{c}_rolling_mean_{state.window}", f"{c}_rolling_std_{state.window}"]
        names += [f"{c}_lag_{k}" for k in range(1, state.lag_steps + 1)]
        names += [f"{c}_diff", f"{c}_rate_of_change"]
        if c in state.spread:
            names.append(f"{c}_zscore")
    return names


def _medians_where_missing(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Median of each feature that has holes (0 if it has no value at all)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(features)]).first()
    counts = {c: row[f"c{i}"] for i, c in enumerate(features)}
    holes = [c for c in features if counts[c] < row["n"]]
    found = exact_quantiles(df, {c: col(c) for c in holes}, [0.5], {c: counts[c] for c in holes})
    medians = {c: 0.0 if q[0] is None else q[0] for c, q in found.items()}
    # Columns without holes still need a value for rows scored later.
    return {**{c: 0.0 for c in features}, **medians}


def fe_summary(original: list[str], engineered: DataFrame) -> DataFrame:
    """(feature_group, column) for every engineered column that belongs to a group."""
    rows = []
    for i, c in enumerate(x for x in engineered.columns if x not in set(original)):
        group = next((g for g in fv.FEATURE_GROUPS if g in c), "other")
        rows.append((i, group, c))
    return rows_frame(engineered.sparkSession, rows, "seq int, feature_group string, column string")


def minmax_scale(df: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Numeric columns to 0..1; constant columns stay as they are."""
    cols = numeric_columns(df, exclude)
    row = df.agg(*[a for i, c in enumerate(cols) for a in (F.min(number(df, c)).alias(f"a{i}"), F.max(number(df, c)).alias(f"b{i}"))]).first()
    scaled = {}
    for i, c in enumerate(cols):
        low, high = row[f"a{i}"], row[f"b{i}"]
        if low is not None and low != high:
            scaled[c] = (number(df, c) - F.lit(low)) / F.lit(high - low)
    return df.select(*[scaled[c].alias(c) if c in scaled else col(c) for c in df.columns])
