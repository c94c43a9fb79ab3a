"""Feature preparation: encode, impute, scale; fitted on one frame, applied to any other by joins and one select."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import NESTED, col, datetime_columns, finite, number, numeric_columns, present, string_columns
from tabulens.operators.roles import with_role
from tabulens.operators.clean import fill_values
from tabulens.operators.stats import mean_std
from tabulens.operators.timeseries import datetime_parts, find_date_column
from tabulens.plans.order_stats import exact_quantiles
from tabulens.plans.ordered import row_numbers
from tabulens.plans.workspace import written

MISSING_LABEL = "nan"
BROADCAST_LABELS = 100_000
SMALL_DICTIONARY = 2_000_000
#: A label that more than one in HOT_LABELS rows carries is hot; there are fewer than HOT_LABELS of them.
HOT_LABELS = 1000


# Label dictionaries ---------------------------------------------------------------------------------------------

def label_dictionary(df: DataFrame, columns: list[str], small_rows: int | None = None) -> DataFrame:
    """(column, value, code): codes 0.. in sorted order of each column's values; a missing value counts as `nan`."""
    numbers = set(numeric_columns(df))
    texts = df.select(*[F.coalesce(present(df, c).cast("string"), F.lit(MISSING_LABEL)).alias(c) for c in columns])
    values = texts.unpivot([], [col(c) for c in columns], "column", "value").distinct()
    as_number = F.when(F.col("column").isin(*numbers), F.col("value").try_cast("double")) if numbers & set(columns) else F.lit(None).cast("double")
    values = written(values.select("column", "value", as_number.alias("size")), "labels")
    if values.count() <= (small_rows or SMALL_DICTIONARY):
        code = F.row_number().over(Window.partitionBy("column").orderBy("size", "value")) - 1
        return written(values.select("column", "value", code.cast("long").alias("code")), "labels")
    placed = row_numbers(values, [F.col("column"), F.col("size"), F.col("value")], "place", small_rows=small_rows)
    starts = placed.groupBy("column").agg(F.min("place").alias("start"))
    coded = placed.join(F.broadcast(starts), "column").select("column", "value", (F.col("place") - F.col("start")).alias("code"))
    return written(coded, "labels")


def dictionary_sizes(dictionary: DataFrame) -> dict[str, int]:
    return {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect()}


def encode(df: DataFrame, dictionary: DataFrame, sizes: dict[str, int], columns: list[str] | None = None,
           broadcast_labels: int | None = None) -> DataFrame:
    """Replace labels by codes; a label the dictionary does not know gets code 0.

    Small dictionaries are broadcast; of larger ones the hot labels are, so that no label lands in one task.
    """
    limit = BROADCAST_LABELS if broadcast_labels is None else broadcast_labels
    for i, c in enumerate(columns or list(sizes)):
        label = F.coalesce(present(df, c).cast("string"), F.lit(MISSING_LABEL))
        codes = dictionary.filter(F.col("column") == c).select(F.col("value").alias(f"__w{i}"), F.col("code").alias(f"__c{i}"))
        if sizes.get(c, 0) <= limit:
            joined = df.withColumn(f"__k{i}", label).join(F.broadcast(codes), F.col(f"__k{i}") == F.col(f"__w{i}"), "left")
        else:
            joined = _join_skewed(df.withColumn(f"__k{i}", label), codes, f"__k{i}", f"__w{i}", f"__c{i}")
        code = F.coalesce(F.col(f"__c{i}"), F.lit(0)).cast("double")
        df = joined.select(*[code.alias(c) if x == c else col(x) for x in df.columns])
    return df


def _join_skewed(df: DataFrame, codes: DataFrame, label: str, value: str, code: str) -> DataFrame:
    """Left join of rows with their label's code: hot labels, few by their definition, are broadcast, the others shuffled."""
    counts = df.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.filter(F.col("__n") > df.count() / HOT_LABELS).select("__label")
    hot = codes.join(hot, F.col(value) == F.col("__label"), "left_semi")
    first = df.join(F.broadcast(hot), F.col(label) == F.col(value), "left")
    rest = first.filter(F.col(code).isNull()).drop(value, code).join(codes, F.col(label) == F.col(value), "left")
    return first.filter(F.col(code).isNotNull()).unionByName(rest)


def label_encode(df: DataFrame, columns: list[str], **sizes) -> DataFrame:
    dictionary = label_dictionary(df, columns, **sizes)
    return encode(df, dictionary, dictionary_sizes(dictionary), columns)


# Fitted features ------------------------------------------------------------------------------------------------

@dataclass
class FeatureState:
    """Everything `transform` needs; the label dictionary is a written table."""

    features: list[str]
    target: str | None = None
    date_column: str | None = None
    encoded: dict[str, int] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    centre: dict[str, float] = field(default_factory=dict)
    spread: dict[str, float] = field(default_factory=dict)
    dictionary: DataFrame | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        facts = {k: v for k, v in vars(self).items() if k != "dictionary"}
        spark.createDataFrame([(json.dumps(facts),)], "state string").write.mode("overwrite").text(f"{path}/state")
        if self.dictionary is not None:
            self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeatureState:
        state = FeatureState(**json.loads(spark.read.text(f"{path}/state").first()[0]))
        if state.encoded:
            state.dictionary = spark.read.parquet(f"{path}/dictionary")
        return state


def _with_features(df: DataFrame, state: FeatureState, keep: list[str]) -> DataFrame:
    """Date parts made, fitted columns present (missing ones NULL), labels coded."""
    df = datetime_parts(df, state.date_column) if state.date_column else df
    extra = [c for c in keep if c not in state.features]
    missing = [c for c in state.features if c not in df.columns]
    for c in missing:
        df = df.withColumn(c, F.lit(None).cast("string" if c in state.encoded else "double"))
    df = df.select(*[col(c) for c in extra], *[col(c) for c in state.features])
    return encode(df, state.dictionary, state.encoded, list(state.encoded)) if state.encoded else df


def _imputed(df: DataFrame, state: FeatureState, c: str) -> Column:
    return F.coalesce(number(df, c), F.lit(float(state.medians.get(c, 0.0))))


def feature_fit(df: DataFrame, target: str | None = None, drop_cols: list[str] = (), scale: bool = True) -> FeatureState:
    """Learn columns, label codes, medians (for columns with holes), means and population deviations."""
    date = find_date_column(df)
    with_dates = datetime_parts(df, date)
    skip = {target, *drop_cols, *datetime_columns(with_dates)}
    features = [f.name for f in with_dates.schema.fields if f.name not in skip and not isinstance(f.dataType, NESTED)]
    texts = [c for c in string_columns(with_dates) if c in features]
    state = FeatureState(features, target, date)
    if texts:
        state.dictionary = label_dictionary(with_dates, texts)
        sizes = dictionary_sizes(state.dictionary)
        state.encoded = {c: sizes.get(c, 0) for c in texts}
    _fit_numbers(_with_features(df, state, []), state, scale)
    return state


def _fit_numbers(df: DataFrame, state: FeatureState, scale: bool) -> None:
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(number(df, c)).alias(f"c{i}") for i, c in enumerate(state.features)]).first()
    counts = {c: row[f"c{i}"] for i, c in enumerate(state.features)}
    holes = {c: counts[c] for c in state.features if counts[c] < row["n"]}
    medians = exact_quantiles(df, {c: number(df, c) for c in holes}, [0.5], holes)
    state.medians = {c: 0.0 if q[0] is None else q[0] for c, q in medians.items()}
    if scale:
        filled = df.select(*[_imputed(df, state, c).alias(c) for c in state.features])
        for c, (mean, std) in mean_std(filled, state.features, population=True).items():
            state.centre[c], state.spread[c] = mean or 0.0, std or 1.0


def feature_transform(df: DataFrame, state: FeatureState, keep: list[str] = ()) -> DataFrame:
    """Kept columns beside the prepared features."""
    keep = list(keep)
    ready = _with_features(df, state, keep)
    out = []
    for c in state.features:
        v = _imputed(ready, state, c)
        out.append(((v - F.lit(state.centre[c])) / F.lit(state.spread[c]) if c in state.centre else v).alias(c))
    return ready.select(*[col(c) for c in keep if c not in state.features], *out)


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    # Positional names, since the assembler reads a dot in a name as a field.
    names = [f"__x{i}" for i in range(len(features))]
    positional = df.withColumns({n: col(c).cast("double") for n, c in zip(names, features)})
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="error").transform(positional).drop(*names)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population std; a constant column is only centred."""
    scaled = {c: (number(df, c) - F.lit(mean)) / F.lit(std or 1.0)
              for c, (mean, std) in mean_std(df, columns, population=True).items() if mean is not None}
    return df.select(*[scaled[c].alias(c) if c in scaled else col(c) for c in df.columns])


def unsup_fit(df: DataFrame, exclude: list[str] = ()) -> FeatureState:
    """Numeric and Boolean columns only, median-filled and standardised."""
    skip = set(exclude)
    kinds = (T.NumericType, T.BooleanType)
    state = FeatureState([f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip])
    _fit_numbers(df.select(*[number(df, c).alias(c) for c in state.features]), state, True)
    return state


def unsup_prep(df: DataFrame, exclude: list[str] = (), keep: list[str] = ()) -> tuple[DataFrame, FeatureState]:
    state = unsup_fit(df, list(exclude) + list(keep))
    return feature_transform(df, state, keep), state


def prep_features(df: DataFrame, target: str, roles: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Baseline preparation: no identifiers, median or most frequent value for holes, codes for categories."""
    features = [c for c, role in roles.items() if role not in ("identifier", "other") and c != target]
    row = df.agg(*[F.count(present(df, c)).alias(f"c{i}") for i, c in enumerate(features)], F.count(F.lit(1)).alias("n")).first()
    holes = [c for i, c in enumerate(features) if row[i] < row["n"]]
    values = fill_values(df, holes, empty_text="Unknown")
    filled = []
    for c in df.columns:
        if c not in values:
            filled.append(col(c))
        elif isinstance(df.schema[c].dataType, T.StringType):
            filled.append(F.coalesce(col(c), F.lit(values[c])).alias(c))
        else:
            filled.append(F.coalesce(present(df, c), F.lit(values[c]).try_cast(df.schema[c].dataType)).alias(c))
    out = df.select(*filled)
    categories = [c for c in with_role(roles, "categorical") if c in features]
    if categories:
        dictionary = label_dictionary(out, categories)
        out = encode(out, dictionary, dictionary_sizes(dictionary), categories)
    return out, features


def usable_features(df: DataFrame, features: list[str]) -> list[str]:
    """Prepared columns a model can read: texts and times are left out."""
    return [c for c in features if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
