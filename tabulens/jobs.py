"""The two whole jobs: exploratory analysis, and anomaly detection with or without labels."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens import fixed_values as fv
from tabulens.functions.columns import numeric_columns
from tabulens.ml import models
from tabulens.ml.unsupervised import consensus_anomaly
from tabulens.operators import clean, insights, outliers, profile, roles, stats
from tabulens.operators.charts import boxplot, density_curve, histograms, pair_bins
from tabulens.operators.facts import column_facts
from tabulens.operators.timeseries import SeriesState, engineer_features, feature_inputs, fe_summary
from tabulens.plans.workspace import rows_frame, written
from tabulens.sources.load import SOURCE, load, union_sources
from tabulens.sources.sinks import id_column, validate_submission, write_predictions, write_report

ROW_KEY = "row_key"
LABEL_NAMES = ("anomaly", "label", "target")
PAIR_COLUMNS = 5


def with_row_key(df: DataFrame, name: str = ROW_KEY) -> DataFrame:
    """A unique integer per row for tables that bring none; written, so that the ids stay fixed."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "keyed")


def describe_tables(df: DataFrame, plots: bool = True, pair_columns: int = PAIR_COLUMNS, only: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Every exploratory section of one frame, or those in `only`; facts, quartiles, counts and correlations are computed once,
    if a section needs them, and shared.

    Pair plots show the first `pair_columns` numerical columns.
    """
    spark = df.sparkSession
    facts = column_facts(df)
    kinds = roles.infer_roles(df, facts)
    numerical, categorical = roles.with_role(kinds, "numerical"), roles.with_role(kinds, "categorical")
    numeric = cache(lambda: stats.numeric_facts(df, numerical))
    triangle = cache(lambda: written(stats.correlations(df, numerical), "correlations") if len(numerical) > 1 else None)
    counts = cache(lambda: written(stats.value_counts(df, categorical), "counts"))
    none = rows_frame(spark, [], "column string")
    sections = {
        "overview": lambda: profile.profile_overview(df),
        "bytes": lambda: profile.profile_bytes(df),
        "missing": lambda: profile.missing_values(df),
        "duplicates": lambda: profile.duplicate_rows(df),
        "roles": lambda: roles.column_roles(df, facts),
        "quality_issues": lambda: profile.quality_issues(df, facts),
        "numeric_stats": lambda: stats.numeric_stats(df, numerical, numeric()),
        "categorical_stats": lambda: stats.categorical_stats(df, categorical, counts()) if categorical else none,
        "top_values": lambda: stats.top_values(df, categorical, counts=counts()) if categorical else none,
        "correlations": lambda: stats.corr_matrix(df, numerical, triangle()),
        "strong_correlations": lambda: stats.strong_corr(df, numerical, triangle=triangle()),
        "outliers": lambda: outliers.outlier_summary(df, numerical, numeric()),
        "insights": lambda: insights.insights(df, facts, numeric(), triangle()),
        "suggestions": lambda: insights.suggestions(df, facts, numeric()),
    }
    if plots and numerical and numeric():
        drawn = list(numeric())
        sections["boxplots"] = lambda: boxplot(df, drawn, numeric())
        sections["histograms"] = lambda: histograms(df, drawn, facts=numeric())
        sections["densities"] = lambda: density_curve(df, drawn, facts=numeric())
        if len(drawn) > 1:
            sections["pair_bins"] = lambda: pair_bins(df, drawn[:pair_columns])
    return {name: make() for name, make in sections.items() if only is None or name in only}


def run_eda(
    df: DataFrame,
    order_by: list[str],
    key: str | None = None,
    partition_by: list[str] = (),
    do_clean: bool = True,
    plots: bool = True,
    summary_only: bool = False,
    outlier_mode: str = "remove",
    baseline: bool = True,
    output: str | None = None,
) -> dict[str, DataFrame]:
    """Validate, clean, profile, relate, model -> one table per section, written under `output` if given."""
    spark = df.sparkSession
    verdict = profile.validate_dataset(df).first()
    if not verdict["is_valid"]:
        raise ValueError(verdict["message"])
    tables: dict[str, DataFrame] = {}
    cleaned = df
    if do_clean:
        try:
            cleaned, tables["cleaning"] = clean.clean_full(df, order_by, partition_by, [key] if key else [], outliers=outlier_mode)
            cleaned = written(cleaned, "cleaned")
            tables["clean_compare"] = profile.clean_compare(df, cleaned)
        except clean.TooFewRows as e:
            tables["cleaning"] = rows_frame(spark, [(0, "Cleaning", False, True, str(e), [str(e)], False)], clean.REPORT_SCHEMA)
    tables.update(describe_tables(cleaned, plots and not summary_only))
    if baseline and not summary_only:
        key = clean.clean_name(key) if key and do_clean else key
        keyed = cleaned if key else with_row_key(cleaned)
        result = models.train_baseline(keyed, key or ROW_KEY)
        tables["baseline"] = models.baseline_table(spark, result)
        if result["success"]:
            tables["importances"] = models.importance_table(spark, result["importances"])
    if output:
        write_report(tables, output)
    return tables


def run_anomaly(
    df: DataFrame,
    key: str,
    order_by: list[str],
    partition_by: list[str] = (),
    target: str | None = None,
    test: DataFrame | None = None,
    output: str | None = None,
    do_clean: bool = True,
    outlier_mode: str = "flag",
    window: int = 5,
    lag_steps: int = 2,
    contamination: float = fv.CONTAMINATION,
    tune_models: bool = True,
    use_smote: bool = False,
    rounds: int = fv.ENSEMBLE_ROUNDS,
    model_names: list[str] | None = None,
    feature_columns: list[str] | None = None,
    drop_cols: list[str] = (),
) -> dict[str, DataFrame]:
    """Clean, describe, engineer, then train (target present) or detect (no target); score and check a test table.

    Windows stay inside `partition_by`, and inside each source file when the rows came from several.
    """
    spark = df.sparkSession
    key, target = clean.clean_name(key), clean.clean_name(target) if target else None
    named = clean.clean_names(df)
    order_by, partition_by = [clean.clean_name(c) for c in order_by], [clean.clean_name(c) for c in partition_by]
    if SOURCE in named.columns and SOURCE not in partition_by:
        partition_by.append(SOURCE)
    supervised = target is not None and target in named.columns
    tables: dict[str, DataFrame] = {}
    cleaned = named
    if do_clean:
        try:
            cleaned, tables["cleaning"] = clean.clean_full(
                named, order_by, partition_by, [key, *([target] if supervised else [])], outliers=outlier_mode)
            cleaned = written(cleaned, "cleaned")
        except clean.TooFewRows as e:
            tables["cleaning"] = rows_frame(spark, [(0, "Cleaning", False, True, str(e), [str(e)], False)], clean.REPORT_SCHEMA)
    tables.update(describe_tables(cleaned, plots=False, only=("roles", "correlations", "outliers", "quality_issues", "insights")))
    # Neither a label nor what the outlier rule said may reach the features, engineered ones included.
    labels = [c for c in cleaned.columns if c in LABEL_NAMES and c != target]
    left_out = [key, *order_by, *partition_by, *([target] if supervised else []), *labels, "is_outlier"]
    inputs = feature_columns or [c for c in feature_inputs(cleaned, exclude=left_out) if c not in left_out]
    engineered, series = engineer_features(cleaned, order_by, partition_by, numeric_cols=inputs, window=window, lag_steps=lag_steps)
    engineered = written(engineered, "engineered")
    tables["features"] = fe_summary(cleaned.columns, engineered)
    not_features = [c for c in [*order_by, *partition_by, SOURCE, *drop_cols, *labels, "is_outlier"] if c in engineered.columns]
    if not supervised:
        tables["anomalies"] = consensus_anomaly(engineered, key, not_features, contamination)
        if output:
            write_report(tables, output)
        return tables

    trained = models.train_supervised(engineered, target, key, tune_models=tune_models, use_smote=use_smote,
                                      drop_cols=not_features, models=model_names, rounds=rounds)
    tables["leaderboard"] = trained.board
    if trained.best is None:  # every model failed: the (empty) board and the reasons are the result
        tables["failures"] = rows_frame(spark, sorted(trained.failures.items()), "model string, error string")
        return tables
    best = trained.results[trained.best]
    tables["importances"] = models.importance_table(spark, best["fi"])
    estimator = models.registry(trained.train.count(), len(trained.classes), rounds)[trained.best]
    tables["cross_validation"] = models.cross_validate(models.with_params(estimator, best["params"]), trained.train)
    if output:
        trained.save(spark, output, series)
    if test is not None:
        tables.update(score_test(trained, test, series, order_by, partition_by, key, output))
    if output:
        write_report(tables, f"{output}/report")
    return tables


def score_saved(spark: SparkSession, folder: str, test: DataFrame, order_by: list[str], partition_by: list[str] = (), key: str | None = None,
                output: str | None = None) -> dict[str, DataFrame]:
    """`score_test` with what an earlier `run_anomaly(..., output=folder)` saved."""
    scorer = models.load_training(spark, folder)
    series = SeriesState(**scorer.series) if scorer.series else None
    return score_test(scorer, test, series, order_by, list(partition_by), key, output)


def score_test(trained: models.Training | models.Scorer, test: DataFrame, series, order_by: list[str], partition_by: list[str],
               key: str | None = None, output: str | None = None) -> dict[str, DataFrame]:
    """Engineer a test table with the training state, predict, check and (if valid) write `submission`."""
    test = clean.clean_names(test)
    ids = id_column(test, key)
    engineered, _ = engineer_features(test, order_by, [c for c in partition_by if c in test.columns], state=series)
    predictions = written(trained.predict(engineered, ids, trained.state.target), "predictions")
    verdict = validate_submission(predictions, test, trained.state.target)
    if output and verdict.first()["is_valid"]:
        write_predictions(predictions, ids, trained.state.target, f"{output}/submission")
    return {"submission": predictions, "submission_check": verdict}


def load_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One path as it is, several stacked with their file names."""
    return load(spark, paths[0]) if len(paths) == 1 else union_sources(spark, paths)


