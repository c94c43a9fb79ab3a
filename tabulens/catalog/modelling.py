"""Queries over feature preparation, splits, metrics, neighbours, models, detection and the whole jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens import fixed_values as fv
from tabulens import jobs
from tabulens.catalog.cleaning import BY, DEDUP, ORDER, PARTS
from tabulens.catalog.tables import dirty_events, hash_sql, r, rounded, table, union_sql, unit_sql
from tabulens.ml import metrics, models, neighbours, prep, split, unsupervised
from tabulens.operators import roles
from tabulens.operators.charts import density_curve
from tabulens.operators.timeseries import engineer_features
from tabulens.plans.workspace import new_path, written
from tabulens.sources import sinks

Q, S = {}, {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


# Preparation ----------------------------------------------------------------------------------------------------

@query
def label_encode(spark, sf):
    return prep.label_encode(table(spark, sf, "events").select("event_id", "event_type", "props"), ["event_type", "props"])


S["label_encode"] = """SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS event_type,
 CAST(dense_rank() OVER (ORDER BY props) - 1 AS DOUBLE) AS props FROM events"""


@query
def standard_scale(spark, sf):
    return rounded(prep.standard_scale(table(spark, sf, "part"), ["p_size", "p_retailprice"]))


S["standard_scale"] = f"""WITH m AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS b, avg(p_retailprice) AS c, stddev_pop(p_retailprice) AS d FROM part)
SELECT p_partkey, p_name, p_brand, p_type, {r("(p_size - a) / b")} AS p_size, {r("(p_retailprice - c) / d")} AS p_retailprice FROM part, m"""


@query
def prep_features(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))).withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")))
    return rounded(prep.prep_features(o, "o_custkey", roles.infer_roles(o))[0])


S["prep_features"] = f"""WITH t AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus) FROM orders),
m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM t), o AS (SELECT o_orderstatus AS mode FROM t WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT t.* REPLACE (coalesce(o_orderstatus, mode) AS o_orderstatus, coalesce(o_totalprice, med) AS o_totalprice) FROM t, m, o)
SELECT o_orderkey, o_custkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS o_orderstatus, {r("o_totalprice")} AS o_totalprice, o_orderdate,
 CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority FROM f"""

FEATURES = ["user_id", "event_type", "value", "props", "ts_hour", "ts_day", "ts_month", "ts_weekday"]
CODED = f"""{DEDUP}, g AS (SELECT quantile_cont(value, 0.5) AS med FROM d), x AS (SELECT event_id, user_id, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type,
 coalesce(value, med) AS value, dense_rank() OVER (ORDER BY props) - 1 AS props, {PARTS} FROM d, g)"""


def _deduped(spark, sf):
    return dirty_events(spark, sf).dropDuplicates()


@query
def feature_fit(spark, sf):
    state = prep.feature_fit(_deduped(spark, sf), drop_cols=["event_id"])
    rows = [(c, state.medians.get(c), state.centre[c], state.spread[c]) for c in state.features]
    return rounded(spark.createDataFrame(rows, "feature string, median double, centre double, spread double"))


S["feature_fit"] = CODED + union_sql([f" SELECT '{c}' AS feature, {r('(SELECT med FROM g)') if c == 'value' else 'CAST(NULL AS DOUBLE)'} AS median, {r(f'avg({c})')} AS centre, {r(f'CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END')} AS spread FROM x"
                                      for c in FEATURES])


@query
def feature_transform(spark, sf):
    df = _deduped(spark, sf)
    return rounded(prep.feature_transform(df, prep.feature_fit(df, drop_cols=["event_id"]), ["event_id"]))


S["feature_transform"] = CODED + ", m AS (SELECT " + ", ".join(f"avg({c}) AS a{i}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS b{i}" for i, c in enumerate(FEATURES)) + \
    " FROM x) SELECT event_id, " + ", ".join(f"{r(f'({c} - a{i}) / b{i}')} AS {c}" for i, c in enumerate(FEATURES)) + " FROM x, m"


@query
def feature_state_roundtrip(spark, sf):
    df, path = _deduped(spark, sf), new_path(spark, "state")
    prep.feature_fit(df, drop_cols=["event_id"]).save(spark, path)
    return rounded(prep.feature_transform(df, prep.FeatureState.load(spark, path), ["event_id"]))


S["feature_state_roundtrip"] = S["feature_transform"]


@query
def unsup_prep(spark, sf):
    return rounded(prep.unsup_prep(_deduped(spark, sf), keep=["event_id"])[0])


S["unsup_prep"] = CODED + f""", m AS (SELECT avg(user_id) AS a, stddev_pop(user_id) AS b, avg(value) AS c, stddev_pop(value) AS e FROM x)
SELECT event_id, {r("(user_id - a) / b")} AS user_id, {r("(value - c) / e")} AS value FROM x, m"""


# Splits ---------------------------------------------------------------------------------------------------------

@query
def class_weights(spark, sf):
    return rounded(split.class_weights(table(spark, sf, "labels"), "toxic"))


S["class_weights"] = f"""WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)
SELECT CAST(toxic AS VARCHAR) AS label, n, {r("(SELECT sum(n) FROM c) / CAST((SELECT count(*) FROM c) * n AS DOUBLE)")} AS weight,
 {r("(SELECT max(n) FROM c) / CAST((SELECT min(n) FROM c) AS DOUBLE)")} AS positive_weight FROM c"""

HASHED = f"h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {hash_sql('event_id', 42)}, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query
def stratified_split(spark, sf):
    return split.stratified_split(table(spark, sf, "events"), "event_type", "event_id").select("event_id", "event_type", "split")


S["stratified_split"] = f"WITH {HASHED} SELECT event_id, event_type, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM h"


@query
def kfold_assign(spark, sf):
    return rounded(split.kfold_assign(table(spark, sf, "events"), "event_type", "event_id").select("event_id", "event_type", "fold"))


S["kfold_assign"] = f"""WITH {HASHED} SELECT event_id, event_type, CAST(CASE WHEN rn <= ceil(n / 5.0) THEN 0 WHEN rn <= ceil(2 * n / 5.0) THEN 1
 WHEN rn <= ceil(3 * n / 5.0) THEN 2 WHEN rn <= ceil(4 * n / 5.0) THEN 3 ELSE 4 END AS BIGINT) AS fold FROM h"""


@query
def bounded_sample(spark, sf):
    return split.bounded_sample(table(spark, sf, "events"), "event_id")


S["bounded_sample"] = f"SELECT * FROM events ORDER BY {hash_sql('event_id', 42)}, event_id LIMIT 2000"


# Metrics --------------------------------------------------------------------------------------------------------

def _judged(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select(F.col("toxic").alias("y"), F.col("n_chars").alias("score"), (F.col("n_chars") > 1000).cast("int").alias("p"))


JUDGED = "t AS (SELECT toxic AS y, n_chars AS score, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))"
CONF = "c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn, CAST(count(*) AS DOUBLE) AS n FROM t)"
PREC, REC, F1 = "coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0)", "coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0)", "coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0)"


@query
def classification_metrics(spark, sf):
    return metrics.classification_metrics(_judged(spark, sf), "y", "p")


S["classification_metrics"] = f"WITH {JUDGED}, {CONF} SELECT round((tp + tn) / n, 4) AS accuracy, round({PREC}, 4) AS precision, round({REC}, 4) AS recall, round({F1}, 4) AS f1 FROM c"


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_judged(spark, sf), "y", "p")


S["confusion_matrix"] = f"WITH {JUDGED}, {CONF} " + union_sql([f"SELECT '{y}' AS label, '{p}' AS prediction, {n} AS n FROM c" for y, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])


@query
def classification_report(spark, sf):
    return rounded(metrics.classification_report(_judged(spark, sf), "y", "p"))


S["classification_report"] = f"""WITH {JUDGED}, {CONF}, k AS (SELECT '1' AS class, {PREC} AS precision, {REC} AS recall, {F1} AS f1, tp + fn AS support FROM c
UNION ALL SELECT '0', coalesce(tn / nullif(CAST(tn + fn AS DOUBLE), 0), 0), coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0), coalesce(2 * tn / nullif(CAST(2 * tn + fp + fn AS DOUBLE), 0), 0), tn + fp FROM c),
a AS (SELECT * FROM k UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM k)
SELECT class, {r("precision")} AS precision, {r("recall")} AS recall, {r("f1")} AS f1, support FROM a"""

POINTS = f"""{JUDGED}, g AS (SELECT CAST(score AS DOUBLE) AS threshold, CAST(count(*) FILTER (y = 1) AS BIGINT) AS pos, CAST(count(*) FILTER (y <> 1) AS BIGINT) AS neg FROM t GROUP BY 1),
s AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp, sum(neg) OVER (ORDER BY threshold) AS under, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


@query
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(_judged(spark, sf), "y", "score"))


S["roc_auc"] = f"WITH {POINTS} SELECT {r('sum(pos * (under - neg / 2.0)) / max(p) / max(n)')} AS roc_auc FROM s"


@query
def roc_points(spark, sf):
    return rounded(metrics.roc_points(_judged(spark, sf), "y", "score").filter(F.col("threshold") < F.lit(float("inf"))))


S["roc_points"] = f"WITH {POINTS} SELECT threshold, {r('fp / CAST(n AS DOUBLE)')} AS fpr, {r('tp / CAST(p AS DOUBLE)')} AS tpr FROM s"


@query
def regression_metrics(spark, sf):
    guess = table(spark, sf, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    return rounded(metrics.regression_metrics(guess, "l_extendedprice", "guess"), 4)


S["regression_metrics"] = f"SELECT {r('sqrt(avg(pow(l_extendedprice - l_quantity * 1500, 2)))', 4)} AS rmse, {r('1 - avg(pow(l_extendedprice - l_quantity * 1500, 2)) / var_pop(l_extendedprice)', 4)} AS r2 FROM lineitem"


@query
def unsup_eval(spark, sf):
    return metrics.unsup_eval(_judged(spark, sf), "y", "p")


S["unsup_eval"] = f"WITH {JUDGED}, {CONF} SELECT round({PREC}, 4) AS precision, round({REC}, 4) AS recall, round({F1}, 4) AS f1, tn, fp, fn, tp FROM c"


# Neighbours -----------------------------------------------------------------------------------------------------

def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


@query
def knn_classify(spark, sf):
    v = _vectors(spark, sf)
    return neighbours.knn_classify(v, v, v.select("id", "label"), skip_self=True).withColumn("prediction", F.col("prediction").cast("long"))


NEAR = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
nn AS (SELECT a.vec_id AS id, b.vec_id AS nid, a.label AS own, b.label AS label, b.e AS ne, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank
 FROM v a JOIN v b ON a.vec_id <> b.vec_id{same})"""
S["knn_classify"] = f"""WITH {NEAR.format(same="")}, k AS (SELECT id, label, count(*) AS votes FROM nn WHERE rank <= 5 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) AS rn FROM k) SELECT id, CAST(label AS BIGINT) AS prediction, votes FROM o WHERE rn = 1"""


#: Cells of an embedding.
VECTOR_WIDTH = 64


@query
def knn_recall(spark, sf):
    """Recall of the lists against the exact neighbours for every id divisible by 50, and whether visits keep to their bound."""
    v = _vectors(spark, sf)
    asked = v.filter(F.col("id") % 50 == 0)
    exact = neighbours.knn(asked, v, fv.NEIGHBOURS, skip_self=True)
    found = neighbours.recall_of(neighbours.knn_lists(asked, v, fv.NEIGHBOURS, skip_self=True), exact)
    return found.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_neighbours"), (F.sum("n_found") >= 0.9 * F.sum("n")).alias("recall_reached"))


S["knn_recall"] = "SELECT count(*) AS n_queries, CAST(5 * count(*) AS BIGINT) AS n_neighbours, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0"


@query
def smote(spark, sf):
    made = neighbours.smote(_vectors(spark, sf), "label")
    cells = [F.get("vec", F.lit(i)).alias(f"x{i}") for i in range(VECTOR_WIDTH)]
    return rounded(made.select(F.col("label").cast("long"), "base_id", "neighbour_id", "u", *cells))


S["smote"] = f"""WITH {NEAR.format(same=" AND a.label = b.label")}, c AS (SELECT label, count(*) AS m FROM v GROUP BY 1), mx AS (SELECT max(m) AS top FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM v),
i AS (SELECT label, m, least(5, m - 1) AS k, unnest(range(top - m)) AS i FROM c, mx WHERE m > 1),
z AS (SELECT i.label, b.vec_id AS base_id, b.e, {unit_sql("i", 43)} AS u, CAST(floor({unit_sql("i", 42)} * k) + 1 AS BIGINT) AS pick FROM i JOIN b ON b.label = i.label AND b.place = i % m)
SELECT CAST(z.label AS BIGINT) AS label, base_id, nid AS neighbour_id, {r("u")} AS u, {", ".join(r(f"e[{i + 1}] + u * (ne[{i + 1}] - e[{i + 1}])") + f" AS x{i}" for i in range(VECTOR_WIDTH))}
 FROM z JOIN nn ON nn.id = base_id AND nn.rank = pick"""


# Models ---------------------------------------------------------------------------------------------------------

LEAKS = ["value", "value_diff", "value_rate_of_change", "value_zscore"]


def _labelled(spark, sf) -> DataFrame:
    """Engineered events with the label value > 150; the columns that spell the label out are not features."""
    out, _ = engineer_features(table(spark, sf, "events"), ORDER, BY, numeric_cols=["value"])
    return out.withColumn("target", (F.col("value") > 150).cast("int"))


_done: dict = {}


def _stamp(spark, sf) -> str:
    """The files of the events and when they were written: another table at the same path is another training."""
    files = table(spark, sf, "events").inputFiles()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return repr([(f, p.getFileSystem(conf).getFileStatus(p).getModificationTime()) for f, p in zip(files, paths)])


def _trained(spark, sf, **options):
    """All nine models; kept for the queries of one session that look at the same training of the same files."""
    key = (spark.sparkContext.applicationId, _stamp(spark, sf), repr(sorted(options.items())))
    if key not in _done:
        _done[key] = models.train_supervised(_labelled(spark, sf), "target", "event_id", drop_cols=[*LEAKS, "user_id", "ts", "props"], **options)
    return _done[key]


def _judged_models(spark, t):
    """Per model: rows on either side, whether its metrics follow from its predictions on the test rows, and whether its rank follows from F1."""
    board = {r["model"]: r for r in t.board.collect()}
    order = [r["f1"] for r in sorted(board.values(), key=lambda r: r["rank"])]
    rows = []
    for name, found in t.results.items():
        scored = written(found["model"].transform(t.test).select("id", "label", "prediction"), "judged")
        right = metrics.classification_metrics(scored, "label", "prediction").first()
        same = all(right[m] == board[name][m] for m in metrics.METRICS)
        rows.append((name, scored.count(), scored.select("id").distinct().count(), t.train.count(), same, order == sorted(order, reverse=True), board[name]["tuning"]))
    return spark.createDataFrame(rows, "model string, n_test long, n_ids long, n_train long, metrics_right boolean, rank_right boolean, tuning string")


NAMES = ", ".join(f"('{n}')" for n in models.registry_names())
SIDES = """c AS (SELECT CAST(value > 150 AS INT) AS target, count(*) AS n FROM events GROUP BY 1), s AS (SELECT n, CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS t FROM c),
z AS (SELECT CAST(sum(t) AS BIGINT) AS n_test, CAST(sum(n - t) AS BIGINT) AS n_train, CAST(2 * max(n - t) AS BIGINT) AS n_evened FROM s)"""


@query
def baseline_classify(spark, sf):
    return models.baseline_table(spark, models.train_baseline(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus"))


@query
def baseline_regress(spark, sf):
    return models.baseline_table(spark, models.train_baseline(_lines(spark, sf), "row", "l_extendedprice"))


def _lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("row", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


@query
def baseline_checked(spark, sf):
    """Both baselines: test rows, whether the metrics follow from the written predictions, and whether importances add up to one."""
    rows = []
    for name, df, key, target in (("classes", table(spark, sf, "orders"), "o_orderkey", "o_orderstatus"), ("numbers", _lines(spark, sf), "row", "l_extendedprice")):
        found = models.train_baseline(df, key, target)
        y, p, m = F.col("label"), F.col("prediction"), found["metrics"]
        if name == "classes":
            right, total, hits = found["scored"].agg(F.avg((y == p).cast("double")), F.count(F.lit(1)), F.count_if(y == p)).first()
            right = abs(right - m["accuracy"]) < 1e-9 and abs(m["recall"] - hits / total) < 1e-9  # recall weighted by support is the share of hits
        else:
            rmse, spread, total = found["scored"].agg(F.sqrt(F.avg((y - p) ** 2)), F.var_pop(y), F.count(F.lit(1))).first()
            right = abs(rmse / m["rmse"] - 1) < 1e-6 and abs((1 - rmse**2 / spread) - m["r2"]) < 1e-6
        rows.append((name, found["problem_type"], total, bool(right), abs(sum(found["importances"].values()) - 1) < 1e-6))
    return spark.createDataFrame(rows, "task string, problem_type string, n_test long, metrics_right boolean, importances_whole boolean")


S["baseline_checked"] = """SELECT 'classes' AS task, 'classification' AS problem_type, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS n_test, true AS metrics_right, true AS importances_whole FROM orders
UNION ALL SELECT 'numbers', 'regression', CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT), true, true FROM lineitem"""


@query
def train_supervised(spark, sf):
    return _judged_models(spark, _trained(spark, sf))


S["train_supervised"] = f"""WITH {SIDES} SELECT model, n_test, n_test AS n_ids, n_train, true AS metrics_right, true AS rank_right, 'Baseline' AS tuning FROM z, (VALUES {NAMES}) m(model)"""


@query
def leaderboard(spark, sf):
    return _judged_models(spark, _trained(spark, sf, use_smote=True))


S["leaderboard"] = f"""WITH {SIDES} SELECT model, n_test, n_test AS n_ids, n_evened AS n_train, true AS metrics_right, true AS rank_right, 'Baseline' AS tuning FROM z, (VALUES {NAMES}) m(model)"""


@query
def leaderboard_long(spark, sf):
    """Every model's four scores, as multiples of what the test rows allow: accuracy times rows is a whole number of hits."""
    t = _trained(spark, sf)
    n = t.test.count()
    hits = F.round(F.col("score") * n)
    long = metrics.leaderboard_long(t.board)
    whole = F.when(F.col("metric") == "accuracy", F.abs(hits / n - F.col("score")) <= 0.00005 + 0.5 / n).otherwise(F.col("score").between(0, 1))
    return long.select("model", "metric", F.lit(n).cast("long").alias("n_test"), whole.alias("possible"))


S["leaderboard_long"] = f"""WITH {SIDES} SELECT model, metric, n_test, true AS possible FROM z, (VALUES {NAMES}) m(model), (VALUES ('accuracy'), ('precision'), ('recall'), ('f1')) k(metric)"""


@query
def feature_importance(spark, sf):
    """The forest's features with their importances' sum and order."""
    found = _trained(spark, sf).results["Random Forest"]["fi"]
    ranked = models.importance_table(spark, found, top=len(found))
    falling = F.coalesce(F.col("importance") <= F.lag("importance").over(Window.orderBy("rank")), F.lit(True))
    return ranked.select("feature", falling.alias("falling"), F.lit(round(sum(found.values()), 6)).alias("sum"))


S["feature_importance"] = """SELECT feature, true AS falling, 1.0::DOUBLE AS "sum" FROM (VALUES ('event_type'), ('value_rolling_mean_5'), ('value_rolling_std_5'), ('value_lag_1'), ('value_lag_2'),
 ('ts_hour'), ('ts_day'), ('ts_month'), ('ts_weekday')) f(feature)"""


@query
def tune_model(spark, sf):
    """Every model that has a grid, with the score of each point."""
    t = _trained(spark, sf)
    pool = models.registry(t.train.count())
    grids = {name: grid for name, estimator in pool.items() if (grid := models.tuning_grid(name, estimator))}
    folded = models.Together(models.folded_for(t.train, fv.TUNING_FOLDS), t.train, [(pool[name], grid) for name, grid in grids.items()])
    scored = [models.tuning_table(spark, grid, models.tune(pool[name], grid, t.train, folded=folded)[2]).withColumn("model", F.lit(name)) for name, grid in grids.items()]
    return reduce(DataFrame.unionByName, scored)


@query
def cross_validate(spark, sf):
    """A row for every model."""
    t = _trained(spark, sf)
    pool = models.registry(t.train.count())
    folded = models.folded_for(t.train, fv.CV_FOLDS)
    return reduce(DataFrame.unionByName, [models.cross_validate(estimator, t.train, folded=folded).withColumn("model", F.lit(name)) for name, estimator in pool.items()])


def _scored(spark, sf):
    marked = split.plain_split(table(spark, sf, "events").withColumn("target", (F.col("value") > 150).cast("int")), "event_id")
    marked = written(marked, "marked")
    train_raw, test = (marked.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    train, series = engineer_features(train_raw, ORDER, BY, numeric_cols=["value"])
    t = models.train_supervised(train, "target", "event_id", drop_cols=[*LEAKS, "user_id", "ts", "props"])
    folder = new_path(spark, "scored")
    t.save(spark, folder, series)
    test = test.drop("target")
    return test, jobs.score_test(t, test, series, ORDER, BY, "event_id", folder), jobs.score_saved(spark, folder, test, ORDER, BY, "event_id")


def _predicted(spark, sf) -> DataFrame:
    """event_id, target (the class that the saved model gives), live (the class of the model in memory)."""
    _, live, saved = _scored(spark, sf)
    return saved["submission"].join(live["submission"].select("event_id", F.col("target").alias("live")), "event_id", "full")


@query
def score_test(spark, sf):
    """The scored ids: each test row once, one of the two classes, the same from the saved artifacts as from the model in memory."""
    return _predicted(spark, sf).select("event_id", F.col("target").isin(0, 1).alias("known_class"), F.col("target").eqNullSafe(F.col("live")).alias("same_as_live"))


@query
def score_test_rows(spark, sf):
    """The classes themselves: what is learned has no SQL."""
    return _predicted(spark, sf)


@query
def leaderboard_rows(spark, sf):
    """The board of all nine models with its scores; a model that failed is an error, not a shorter board."""
    t = _trained(spark, sf)
    if t.failures:
        raise RuntimeError("models failed: " + "; ".join(f"{name}: {error}" for name, error in sorted(t.failures.items())))
    return t.board


@query
def importance_rows(spark, sf):
    """Every feature's importance in each model that tells."""
    parts = [models.importance_table(spark, r["fi"], top=len(r["fi"])).withColumn("model", F.lit(name)) for name, r in _trained(spark, sf).results.items() if r["fi"]]
    return reduce(DataFrame.unionByName, parts)


S["score_test"] = f"""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY {hash_sql("event_id", 42)}, event_id) AS place, count(*) OVER () AS n FROM events)
SELECT event_id, true AS known_class, true AS same_as_live FROM o WHERE place <= floor(n * 0.2 + 0.5)"""


@query
def validate_submission(spark, sf):
    test, tables, _ = _scored(spark, sf)
    short = tables["submission"].filter(F.col("event_id") % 2 == 0)
    checks = [("whole", tables["submission_check"]), ("short", sinks.validate_submission(short, test, "target")),
              ("nameless", sinks.validate_submission(short.drop("target"), test, "target"))]
    return reduce(DataFrame.unionByName, [c.select(F.lit(n).alias("case"), "is_valid") for n, c in checks])


S["validate_submission"] = "SELECT * FROM (VALUES ('whole', true), ('short', false), ('nameless', false)) t(\"case\", is_valid)"


# Detection and jobs ---------------------------------------------------------------------------------------------

def _engineered(spark, sf):
    return engineer_features(table(spark, sf, "events"), ORDER, BY, numeric_cols=["value"])[0]


def _flagged(out: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Every input row with its value, whether flags follow from scores, and how many rows each detector flags."""
    out = written(out, "flagged")
    counts = out.agg(*[F.sum(f).cast("long").alias(f"n_{f}") for f in pairs])
    right = reduce(lambda a, b: a & b, [F.col(f) == (F.col(s) < 0).cast("int") for f, s in pairs.items()])
    if len(pairs) > 1:
        right = right & (F.col("consensus_anomaly") == (F.col("if_anomaly") * F.col("ocsvm_anomaly")))
    return rounded(out.select("event_id", "value", right.alias("flags_right")).crossJoin(F.broadcast(counts)))


def _flagged_sql(*names):
    flagged = ", ".join(f"(SELECT CAST(ceil(0.08 * (count(*) - 1)) AS BIGINT) FROM events) AS n_{n}" for n in names)
    return f"SELECT event_id, {r('value')} AS value, true AS flags_right, {flagged} FROM events"


@query
def isolation_forest(spark, sf):
    return _flagged(unsupervised.isolation_forest(_engineered(spark, sf), "event_id", ["user_id"]), {"if_anomaly": "if_score"})


S["isolation_forest"] = _flagged_sql("if_anomaly")


@query
def one_class_svm(spark, sf):
    return _flagged(unsupervised.one_class_svm(_engineered(spark, sf), "event_id", ["user_id"]), {"ocsvm_anomaly": "ocsvm_score"})


S["one_class_svm"] = _flagged_sql("ocsvm_anomaly")


@query
def consensus_anomaly(spark, sf):
    return _flagged(unsupervised.consensus_anomaly(_engineered(spark, sf), "event_id", ["user_id"]), {"if_anomaly": "if_score", "ocsvm_anomaly": "ocsvm_score"})


S["consensus_anomaly"] = _flagged_sql("if_anomaly", "ocsvm_anomaly")


@query
def score_histogram(spark, sf):
    """Rows over all bins, and whether densities and widths add up to one."""
    scored = written(unsupervised.isolation_forest(_engineered(spark, sf), "event_id", ["user_id"]), "scored")
    area = F.sum(F.col("density") * (F.col("upper") - F.col("lower")))
    return metrics.score_histogram(scored, "if_score").agg(F.sum("count").alias("n"), (F.abs(area - 1) < 1e-6).alias("whole"), (F.count_if(F.col("count") > 0) == F.count("*")).alias("no_empty_bin"))


@query
def score_density(spark, sf):
    """The bins of the scores and their density curve (three bandwidths beyond the ends), as rows."""
    scored = written(unsupervised.isolation_forest(_engineered(spark, sf), "event_id", ["user_id"]), "scored")
    bins = metrics.score_histogram(scored, "if_score").select(F.lit("bin").alias("kind"), F.col("lower").alias("x"), "density")
    return bins.unionByName(density_curve(scored, ["if_score"], cut=3.0).select(F.lit("curve").alias("kind"), "x", "density"))


S["score_histogram"] = "SELECT count(*) AS n, true AS whole, true AS no_empty_bin FROM events"


def _sections(tables):
    return reduce(DataFrame.unionByName, [t.agg(F.lit(n).alias("section"), F.count(F.lit(1)).alias("n_rows")) for n, t in tables.items()])


@query
def report_tables(spark, sf):
    folder = new_path(spark, "report")
    tables = jobs.describe_tables(table(spark, sf, "events"))
    paths = sinks.write_report(tables, folder)
    return _sections({n: spark.read.parquet(p) for n, p in paths.items()})


@query
def eda_job(spark, sf):
    return _sections(jobs.run_eda(dirty_events(spark, sf), ORDER, "event_id", BY))


@query
def anomaly_job(spark, sf):
    """Each distinct event once; no feature comes from the outlier rule."""
    found = jobs.run_anomaly(dirty_events(spark, sf), "event_id", ORDER, BY)["anomalies"]
    right = (F.col("consensus_anomaly") == F.col("if_anomaly") * F.col("ocsvm_anomaly")) & (F.col("if_anomaly") == (F.col("if_score") < 0).cast("int"))
    return found.select("event_id", right.alias("flags_right"))


S["anomaly_job"] = "SELECT event_id, true AS flags_right FROM events"


@query
def anomaly_job_supervised(spark, sf):
    df = dirty_events(spark, sf).withColumn("Target", (F.coalesce(F.col("value"), F.lit(0.0)) > 150).cast("int"))
    tables = jobs.run_anomaly(df, "event_id", ORDER, BY, target="Target", test=table(spark, sf, "events"), tune_models=True, use_smote=True,
                              drop_cols=LEAKS, output=new_path(spark, "anomaly"))
    return tables["submission"].select("event_id", F.col("target").isin(0, 1).alias("known_class"))


S["anomaly_job_supervised"] = "SELECT event_id, true AS known_class FROM events"

