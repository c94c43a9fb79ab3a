"""The model registry, supervised training, tuning, cross-validation and the baseline model."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    OneVsRest,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens import fixed_values as fv
from tabulens.functions.columns import col, row_number_of
from tabulens.ml.boosting import Boosting, BoostingModel, fit_all, fold_counts
from tabulens.ml.forest import ForestClassifier, ForestRegressor, held_cells
from tabulens.ml.kernel import fourier_features
from tabulens.ml.metrics import METRICS, cells_of, leaderboard, metrics_of, regression_values
from tabulens.ml.neighbours import knn_classify, smote
from tabulens.ml.prep import FeatureState, assemble, feature_fit, feature_transform, prep_features, usable_features
from tabulens.ml.split import class_counts, kfold_assign, plain_split, stratified_split
from tabulens.operators.facts import Facts, column_facts
from tabulens.operators.roles import guess_target, infer_roles, problem_type_of
from tabulens.plans.workspace import rows_frame, small_for_fitting, written, written_for_fitting

WEIGHT, POSITIVE_WEIGHT, Y, X, ID = "weight", "positive_weight", "label", "features", "id"
# Default depth standing for "grow until pure": levels double the node table each pass, so it has to end somewhere.
# Callers of train_supervised and train_baseline can ask for other limits.
FULL_DEPTH = 12
MAX_BINS = 1024
LEAF_DEPTH = {31: 5, 63: 6}


# Models that MLlib lacks ----------------------------------------------------------------------------------------

class NeighbourModel:
    """k-nearest-neighbour votes over a stored training table."""

    def __init__(self, train: DataFrame, k: int = fv.NEIGHBOURS):
        self.train, self.k = train, k

    def transform(self, df: DataFrame) -> DataFrame:
        points = self.train.select(F.col(ID), vector_to_array(X).alias("vec"))
        asked = df.select(F.col(ID), vector_to_array(X).alias("vec"))
        votes = knn_classify(asked, points, self.train.select(ID, Y), self.k)
        return df.join(votes.select(ID, "prediction"), ID)

    def save(self, path: str) -> None:
        self.train.select(ID, X, Y).write.mode("overwrite").parquet(f"{path}/train")


class KernelModel:
    """Linear SVM on random Fourier features; a logistic model on the margin gives probabilities."""

    def __init__(self, svm, scaler, width: int):
        self.svm, self.scaler, self.width = svm, scaler, width

    @staticmethod
    def fit(df: DataFrame) -> KernelModel:
        width, rows = len(df.select(X).first()[0]), df.count()
        # A large table is mapped on the way, which costs less than a written table of 128 cells a row; MLlib keeps what its steps read.
        mapped = _kernel_columns(df, width)
        mapped = written_for_fitting(mapped, rows, "kernel") if small_for_fitting(df.sparkSession, rows) else mapped
        svm = LinearSVC(featuresCol="mapped", labelCol=Y, weightCol=WEIGHT, maxIter=50, regParam=1e-3)
        if df.agg(F.max(Y)).first()[0] > 1:
            return KernelModel(OneVsRest(classifier=svm, featuresCol="mapped", labelCol=Y, weightCol=WEIGHT).fit(mapped), None, width)
        svm = svm.fit(mapped)
        scaler = LogisticRegression(featuresCol="margin", labelCol=Y, predictionCol="p", rawPredictionCol="r", probabilityCol="probability")
        margins = _margin(svm.transform(mapped)).select("margin", Y)
        return KernelModel(svm, scaler.fit(margins if small_for_fitting(df.sparkSession, rows) else written(margins, "margins")), width)

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.svm.transform(_kernel_columns(df, self.width))
        if self.scaler is None:
            return scored.drop("mapped")
        return self.scaler.transform(_margin(scored)).drop("mapped", "margin", "rawPrediction", "p", "r")

    def save(self, path: str) -> None:
        self.svm.write().overwrite().save(f"{path}/svm")
        if self.scaler is not None:
            self.scaler.write().overwrite().save(f"{path}/scaler")


def _kernel_columns(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("mapped", fourier_features(F.col(X), width, 1.0 / width, seed=fv.SEED))


def _margin(df: DataFrame) -> DataFrame:
    return df.withColumn("margin", array_to_vector(F.slice(vector_to_array("rawPrediction"), 2, 1)))


# Registry -------------------------------------------------------------------------------------------------------

def registry(rows: int, classes: int = 2, rounds: int = fv.ENSEMBLE_ROUNDS, full_depth: int = FULL_DEPTH) -> dict:
    """Name -> estimator. The kernel, neighbour and boosted models are built by their own classes.

    `full_depth` limits the trees of the forest, which otherwise grow until pure.
    """
    return {
        "Logistic Regression": LogisticRegression(labelCol=Y, featuresCol=X, weightCol=WEIGHT, maxIter=fv.LOGISTIC_ITERATIONS,
                                                  regParam=1.0 / max(rows, 1), standardization=False),
        "K-Nearest Neighbors": NeighbourModel,
        "Decision Tree": DecisionTreeClassifier(labelCol=Y, featuresCol=X, weightCol=WEIGHT, maxDepth=fv.TREE_DEPTH, seed=fv.SEED),
        "SVM (RBF)": KernelModel,
        "Random Forest": ForestClassifier(labelCol=Y, featuresCol=X, weightCol=WEIGHT, numTrees=rounds, maxDepth=full_depth, seed=fv.SEED),
        "Gradient Boosting": Boosting(rounds, 3, 0.1, None, 1.0, classes),
        "XGBoost": Boosting(rounds, 6, 0.3, POSITIVE_WEIGHT, 1.0, classes),
        "LightGBM": Boosting(rounds, LEAF_DEPTH[31], 0.1, WEIGHT, 1.0, classes),
        "CatBoost": Boosting(rounds, 6, 0.1, WEIGHT, 0.8, classes),
    }


def registry_names() -> list[str]:
    return ["Logistic Regression", "K-Nearest Neighbors", "Decision Tree", "SVM (RBF)", "Random Forest", "Gradient Boosting", "XGBoost", "LightGBM", "CatBoost"]


def tuning_grid(name: str, estimator) -> list | None:
    """Two values of two parameters for the ensemble models: points by Spark parameter, or by name for boosted models."""
    if name == "Random Forest":
        return ParamGridBuilder().addGrid(estimator.numTrees, [100, 200]).addGrid(estimator.maxDepth, [estimator.getMaxDepth(), 10]).build()
    if not isinstance(estimator, Boosting):
        return None
    other, values = ("depth", list(LEAF_DEPTH.values())) if name == "LightGBM" else ("step", [0.05, 0.1])
    return [{"rounds": r, other: v} for r in (100, 150) for v in values]


def named_point(point: dict) -> dict:
    return {getattr(p, "name", p): v for p, v in point.items()}


def folded_for(train: DataFrame, folds: int) -> DataFrame:
    """The rows with their fold, written once for all models that are compared on them."""
    return written_for_fitting(kfold_assign(train, Y, ID, folds), train.count(), "folds")


class Together:
    """Boosted models that are tuned on the same folds: the fits of all their grids grow together for the first model that asks, and
    so do the models of the best points. If that fails, each is tuned on its own."""

    def __init__(self, folded: DataFrame, train: DataFrame, grids: list[tuple], folds: int = fv.TUNING_FOLDS):
        self.folded, self.train, self.folds, self.lock, self.found = folded, train, folds, Lock(), None
        self.grids = [(e, grid) for e, grid in grids if isinstance(e, Boosting) and grid]

    def tuned(self, estimator, grid: list) -> tuple | None:
        """(model of the best point, scores) of one of the models."""
        if len(self.grids) < 2 or (estimator, grid) not in self.grids:
            return None
        with self.lock:
            if self.found is None:
                try:
                    self.found = self._all()
                except Exception:  # noqa: BLE001
                    self.found = {}
        return self.found.get(self.grids.index((estimator, grid)))

    def _all(self) -> dict[int, tuple]:
        points = [[e.with_params(named_point(p)) for p in grid] for e, grid in self.grids]
        every = list(dict.fromkeys(p for own in points for p in own))
        counts = fold_counts(self.folded, every, self.folds)
        scores = [_mean_scores({(i, k): counts[every.index(p), k] for i, p in enumerate(own) for k in range(self.folds) if (every.index(p), k) in counts},
                               len(own), self.folds) for own in points]
        best = fit_all([own[_best(s)] for own, s in zip(points, scores)], self.train)
        return dict(enumerate(zip(best, scores)))


def tune(estimator, grid: list, train: DataFrame, folds: int = fv.TUNING_FOLDS, parallelism: int = 4, folded: DataFrame | Together | None = None):
    """Grid search by weighted F1 over hash folds -> (best model, chosen parameters, mean score per grid point).

    Points that differ only in the number of trees (or the depth of a forest) share one fit. `folded` is `folded_for(train, folds)`
    where the caller has it already, or such folds together with all the boosted models that are tuned on them.
    """
    model, scores = (folded.tuned(estimator, grid) if isinstance(folded, Together) else None) or (None, None)
    if scores is None:
        rows = folded.folded if isinstance(folded, Together) else folded_for(train, folds) if folded is None else folded
        scores = grid_scores(estimator, grid, rows, folds, parallelism)
    params = named_point(grid[_best(scores)])
    return model or with_params(estimator, params).fit(train), params, scores


def _best(scores: list[float]) -> int:
    return max(range(len(scores)), key=lambda i: scores[i])


def _mean_scores(counts: dict, points: int, folds: int) -> list[float]:
    """Mean weighted F1 of every point from the counts by (point, fold)."""
    f1 = {key: metrics_of(cells, "weighted")["f1"] for key, cells in counts.items()}
    return [sum(v for (point, _), v in f1.items() if point == i) / folds for i in range(points)]


def grid_scores(estimator, grid: list, folded: DataFrame, folds: int, parallelism: int = 4) -> list[float]:
    """Mean weighted F1 of every grid point over the folds."""
    points = [named_point(p) for p in grid]
    if isinstance(estimator, Boosting):
        counts = fold_counts(folded, [estimator.with_params(p) for p in points], folds)
    else:
        counts = _forest_counts(estimator, points, folded, folds, parallelism)
    return _mean_scores(counts, len(grid), folds)


def _forest_counts(estimator, grid: list[dict], folded: DataFrame, folds: int, parallelism: int) -> dict:
    """(point, fold) -> {(label, prediction): n}. The trees of a forest are drawn one like the other, so the first of many are a forest of
    fewer; points that differ in depth are cut from the deepest."""
    shared = {"numTrees", "maxDepth"} if isinstance(estimator, ForestClassifier) else {"numTrees"}
    alike = {}
    for i, point in enumerate(grid):
        alike.setdefault((point.get("numTrees") == 1, *sorted((k, v) for k, v in point.items() if k not in shared)), []).append(i)

    def run(job):
        points, k = job
        train, held = folded.filter(F.col("fold") != k), folded.filter(F.col("fold") == k)
        own = [with_params(estimator, grid[i]) for i in points]
        if isinstance(estimator, ForestClassifier):
            return {(i, k): cells for i, cells in zip(points, held_cells(own, train, held))}
        model = max(own, key=lambda e: e.getNumTrees()).fit(train)
        return {(i, k): cells_of(first_trees(model, e.getNumTrees()).transform(held), Y, "prediction") for i, e in zip(points, own)}

    with ThreadPoolExecutor(parallelism) as threads:
        return dict(kv for part in threads.map(run, [(a, k) for a in alike.values() for k in range(folds)]) for kv in part.items())


def first_trees(model, n: int):
    """The forest of a forest's first n trees."""
    if n >= model.getNumTrees:
        return model
    whole, context = model._java_obj, SparkSession.active().sparkContext
    trees = context._gateway.new_array(context._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, n)
    for i in range(n):
        trees[i] = whole.trees()[i]
    part = context._jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(whole.uid(), trees, whole.numFeatures(), whole.numClasses())
    part = whole.copyValues(part, whole.extractParamMap())
    part.set(part.getParam("numTrees"), n)
    return RandomForestClassificationModel(part)


def with_params(estimator, params: dict):
    """The estimator with a grid point's parameters."""
    if not params:
        return estimator
    if isinstance(estimator, Boosting):
        return estimator.with_params(params)
    return estimator.copy({estimator.getParam(name): value for name, value in params.items()})


def tuning_table(spark: SparkSession, grid: list, scores: list[float]) -> DataFrame:
    rows = [(i, json.dumps(named_point(point), sort_keys=True), float(s)) for i, (point, s) in enumerate(zip(grid, scores))]
    return rows_frame(spark, rows, "point int, params string, f1_weighted double")


# Labels and training tables -------------------------------------------------------------------------------------

def coded_labels(df: DataFrame, target: str) -> tuple[DataFrame, list]:
    """Adds `label` 0..k-1 in sorted order of the target's classes."""
    classes = [c for c in class_counts(df, target) if c is not None]
    code = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        code = F.when(col(target) == F.lit(c), F.lit(float(i))).otherwise(code)
    return df.withColumn(Y, code), classes


def with_weights(df: DataFrame) -> DataFrame:
    """Balanced weight n / (k n_c), and the weight that lifts class 1 to the majority / next-class ratio."""
    counts = {c: m for c, m in class_counts(df, Y).items() if c is not None}
    n, k = sum(counts.values()), len(counts)
    ranked = sorted(counts.values(), reverse=True)
    ratio = ranked[0] / ranked[1] if k > 1 else 1.0
    weight: Column = F.lit(1.0)
    for c, m in counts.items():
        weight = F.when(F.col(Y) == F.lit(c), F.lit(n / (k * m))).otherwise(weight)
    return df.withColumn(WEIGHT, weight).withColumn(POSITIVE_WEIGHT, F.when(F.col(Y) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


def add_synthetic(train: DataFrame) -> DataFrame:
    """Training rows plus the synthetic minority rows, which get negative ids."""
    made = smote(train.select(ID, Y, vector_to_array(X).alias("vec")), Y)
    fresh = made.select((-1 - F.col("new_id")).alias(ID), array_to_vector("vec").alias(X), F.col(Y))
    return train.select(ID, X, Y).unionByName(fresh)


def fit_one(estimator, train: DataFrame):
    if estimator is NeighbourModel:
        return NeighbourModel(train)
    if estimator is KernelModel:
        return KernelModel.fit(train)
    return estimator.fit(train)


def importances(model, features: list[str]) -> dict[str, float]:
    found = getattr(model, "featureImportances", None)
    return dict(zip(features, [float(v) for v in found.toArray()])) if found is not None else {}


def importance_table(spark: SparkSession, values: dict[str, float], top: int = 10) -> DataFrame:
    ranked = sorted(values.items(), key=lambda kv: (-kv[1], kv[0]))[:top]
    return rows_frame(spark, [(i + 1, c, v) for i, (c, v) in enumerate(ranked)], "rank int, feature string, importance double")


@dataclass
class Training:
    """What supervised training returns."""

    state: FeatureState
    classes: list
    train: DataFrame
    test: DataFrame
    results: dict[str, dict]
    board: DataFrame
    best: str | None
    failures: dict[str, str] = field(default_factory=dict)

    def predict(self, df: DataFrame, key: str, target: str) -> DataFrame:
        """(key, target) for new rows, with the classes' own values."""
        keyed = df.withColumns({"__id": row_number_of(df, key), "__key": col(key)})
        ready = assemble(feature_transform(keyed, self.state, ["__id", "__key"]), self.state.features, X)
        out = self.results[self.best]["model"].transform(ready.select(F.col("__id").alias(ID), "__key", X))
        named = F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("prediction").cast("int") + 1)
        return out.select(F.col("__key").alias(key), named.alias(target))

    def save(self, spark: SparkSession, folder: str, series=None) -> dict[str, str]:
        """Everything that scoring needs; `series` is the state of feature engineering, if there was any."""
        paths = {"features": f"{folder}/feature_state", "model": f"{folder}/best_model", "scoring": f"{folder}/scoring"}
        self.state.save(spark, paths["features"])
        facts = {"best": self.best, "classes": self.classes, "width": len(self.state.features), "series": vars(series) if series else None}
        spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").text(paths["scoring"])
        model = self.results[self.best]["model"]
        if isinstance(model, BoostingModel):
            model.save(paths["model"], spark)
        elif isinstance(model, (NeighbourModel, KernelModel)):
            model.save(paths["model"])
        else:
            model.write().overwrite().save(paths["model"])
        return paths


def load_model(spark: SparkSession, name: str, path: str, width: int):
    """Read back a saved best model by its registry name."""
    if name == "K-Nearest Neighbors":
        return NeighbourModel(spark.read.parquet(f"{path}/train"))
    read = DefaultParamsReader.loadParamsInstance
    if name in ("Gradient Boosting", "XGBoost", "LightGBM", "CatBoost"):
        return BoostingModel.load(spark, path)
    if name == "SVM (RBF)":
        svm = read(f"{path}/svm", spark)
        return KernelModel(svm, read(f"{path}/scaler", spark) if isinstance(svm, LinearSVCModel) else None, width)
    return read(path, spark)


@dataclass
class Scorer:
    """A saved training, read back: what `jobs.score_test` needs."""

    state: FeatureState
    classes: list
    results: dict[str, dict]
    best: str
    series: dict | None

    predict = Training.predict


def load_training(spark: SparkSession, folder: str) -> Scorer:
    """Read what `Training.save` wrote."""
    facts = json.loads(spark.read.text(f"{folder}/scoring").first()[0])
    model = load_model(spark, facts["best"], f"{folder}/best_model", facts["width"])
    return Scorer(FeatureState.load(spark, f"{folder}/feature_state"), facts["classes"], {facts["best"]: {"model": model}}, facts["best"], facts["series"])


def train_supervised(
    df: DataFrame,
    target: str,
    key: str,
    test_share: float = fv.TEST_SHARE,
    tune_models: bool = False,
    use_smote: bool = False,
    drop_cols: list[str] = (),
    models: list[str] | None = None,
    rounds: int = fv.ENSEMBLE_ROUNDS,
    parallelism: int = 4,
    full_depth: int = FULL_DEPTH,
) -> Training:
    """Split, fit the features on the training part, fit every model, compare on the test part.

    A model that fails is left out of the comparison and its error kept. `key` is unique and of any type; `full_depth` limits the
    trees of the forest, which otherwise grow until pure.
    """
    spark = df.sparkSession
    labelled, classes = coded_labels(written(df, "rows"), target)  # what made the rows is not done again for counts and cuts
    labelled = labelled.filter(F.col(Y).isNotNull()).withColumn("__id", row_number_of(labelled, key))
    labelled = written(stratified_split(labelled, Y, "__id", test_share), "split")
    train_raw, test_raw = (labelled.filter(F.col("split") == s) for s in ("train", "test"))
    state = feature_fit(train_raw, None, [*drop_cols, target, key, Y, "split", "__id"])
    state.target = target
    ready = [assemble(feature_transform(part, state, ["__id", Y]), state.features, X).select(F.col("__id").alias(ID), X, Y) for part in (train_raw, test_raw)]
    train, test = ready[0], written(ready[1], "test")
    if use_smote:
        train = add_synthetic(written(train, "train"))
    train = written(train, "train")
    n_train = train.count()
    train = written_for_fitting(with_weights(train), n_train)
    pool = registry(n_train, len(classes), rounds, full_depth)
    chosen = {name: est for name, est in pool.items() if models is None or name in models}
    grids = {name: grid for name, est in chosen.items() if tune_models and (grid := tuning_grid(name, est))}
    folded = Together(folded_for(train, fv.TUNING_FOLDS), train, [(chosen[name], grid) for name, grid in grids.items()]) if grids else None

    together, lock, grown = {} if tune_models else {n: e for n, e in chosen.items() if isinstance(e, Boosting)}, Lock(), {}

    def fitted(name, estimator):
        """The boosted models, where none is tuned, grow together for the first that asks; if that fails, each on its own."""
        if len(together) > 1 and name in together:
            with lock:
                if not grown:
                    try:
                        grown.update(zip(together, fit_all(list(together.values()), train)))
                    except Exception:  # noqa: BLE001
                        grown.update(dict.fromkeys(together))
            if grown[name] is not None:
                return grown[name]
        return fit_one(estimator, train)

    def run(item):
        name, estimator = item
        try:
            model, params = tune(estimator, grids[name], train, folded=folded)[:2] if name in grids else (fitted(name, estimator), {})
            cells = cells_of(model.transform(test), Y, "prediction")
            return name, {"model": model, "params": params, "metrics": metrics_of(cells), "fi": importances(model, state.features)}
        except Exception as e:  # noqa: BLE001
            return name, {"error": f"{type(e).__name__}: {e}"}

    with ThreadPoolExecutor(parallelism) as threads:
        outcomes = dict(threads.map(run, chosen.items()))
    results = {n: r for n, r in outcomes.items() if "metrics" in r}
    board = leaderboard(spark, results)
    first = board.orderBy("rank").first()
    return Training(state, classes, train, test, results, board, first["model"] if first else None,
                    {n: r["error"] for n, r in outcomes.items() if "error" in r})


def cross_validate(estimator, df: DataFrame, folds: int = fv.CV_FOLDS, folded: DataFrame | None = None) -> DataFrame:
    """Mean and population deviation over stratified hash folds; weighted precision, recall and F1."""
    folded = folded_for(df, folds) if folded is None else folded

    def one(i):
        train, held = folded.filter(F.col("fold") != i), folded.filter(F.col("fold") == i)
        if isinstance(estimator, ForestClassifier):  # judged in tasks: the driver makes no model of it
            return metrics_of(held_cells([estimator], train, held)[0], "weighted")
        return metrics_of(cells_of(fit_one(estimator, train).transform(held), Y, "prediction"), "weighted")

    if isinstance(estimator, Boosting):
        counts = fold_counts(folded, [estimator], folds)
        scores = [metrics_of(counts.get((0, i), {}), "weighted") for i in range(folds)]
    else:
        # The driver keeps the nodes of a forest while it grows, and the points of neighbours until they are sent: one at a time, which fills the cores alike.
        alone = isinstance(estimator, RandomForestClassifier) or estimator is NeighbourModel
        with ThreadPoolExecutor(1 if alone else 4) as threads:
            scores = list(threads.map(one, range(folds)))
    mean = {m: sum(s[m] for s in scores) / folds for m in METRICS}
    std = {m: (sum((s[m] - mean[m]) ** 2 for s in scores) / folds) ** 0.5 for m in METRICS}
    row = (folds, *[round(v, fv.METRIC_DIGITS) for v in (mean["accuracy"], std["accuracy"], mean["f1"], std["f1"], mean["precision"], mean["recall"])])
    return rows_frame(df.sparkSession, [row], "cv_folds int, cv_accuracy_mean double, cv_accuracy_std double, cv_f1_mean double, "
                      "cv_f1_std double, cv_precision_mean double, cv_recall_mean double")


# Baseline -------------------------------------------------------------------------------------------------------

def train_baseline(df: DataFrame, key: str, target: str | None = None, facts: Facts | None = None, full_depth: int = FULL_DEPTH, max_bins: int = MAX_BINS) -> dict:
    """Random forest on simply prepared columns -> success, problem type, model, metrics, importances, scored test rows (or an error).

    `full_depth` and `max_bins` limit the trees that would otherwise grow until pure and split every value.
    """
    facts = facts or column_facts(df)
    roles = infer_roles(df, facts)
    target = target or guess_target(df, roles, facts)
    try:
        if facts.rows < fv.BASELINE_MIN_ROWS:
            raise ValueError("too few rows, or no column to learn from")
        kind = problem_type_of(target, roles, facts)
        ready, features = prep_features(df, target, roles)
        features = [c for c in usable_features(ready, features) if c != key]
        if not features:
            raise ValueError("too few rows, or no column to learn from")
        ready = ready.filter(col(target).isNotNull())
        ready = coded_labels(ready, target)[0] if kind == "classification" else ready.withColumn(Y, col(target).cast("double"))
        split = plain_split(ready.withColumn("__id", row_number_of(ready, key)), "__id")
        data = assemble(split, features, X).select("split", X, Y)
        data = written_for_fitting(data, facts.rows, "baseline")
        train, test = (data.filter(F.col("split") == s) for s in ("train", "test"))
        most = max([32, *[facts.distinct[c] for c in features if roles[c] == "categorical"]])
        options = {"labelCol": Y, "featuresCol": X, "numTrees": fv.BASELINE_TREES, "maxDepth": full_depth,
                   "maxBins": min(most, max_bins), "seed": fv.SEED}
        model = (ForestClassifier if kind == "classification" else ForestRegressor)(**options).fit(train)
        scored = written(model.transform(test).select(Y, "prediction"), "baseline-test")
        metrics = metrics_of(cells_of(scored, Y, "prediction"), "weighted") if kind == "classification" else regression_values(scored, Y, "prediction")
        name = "RandomForestClassifier" if kind == "classification" else "RandomForestRegressor"
        return {"success": True, "target": target, "problem_type": kind, "model": name, "metrics": metrics,
                "importances": importances(model, features), "fitted": model, "scored": scored}
    except Exception as e:  # noqa: BLE001
        return {"success": False, "target": target, "error": f"{type(e).__name__}: {e}"}


def baseline_table(spark: SparkSession, result: dict) -> DataFrame:
    """The baseline's outcome as (item, value) rows."""
    if not result["success"]:
        return rows_frame(spark, [(f"error: {result['error'].splitlines()[0]}", None)], "metric string, value double")
    return rows_frame(spark, [(m, float(v) if v is not None else None) for m, v in result["metrics"].items()], "metric string, value double")
