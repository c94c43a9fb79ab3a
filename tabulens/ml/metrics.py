"""Classification, regression and ranking metrics from grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import fixed_values as fv
from tabulens.functions.columns import col
from tabulens.operators.charts import histogram
from tabulens.plans.ordered import running_sums
from tabulens.plans.workspace import rows_frame

MAX_CELLS = 100_000


def cells_of(df: DataFrame, label: str, prediction: str) -> dict:
    """{(label, prediction): rows}; the pairs are few, and refused if they are not."""
    rows = df.groupBy(col(label).alias("y"), col(prediction).alias("p")).count().limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError("too many classes for a confusion matrix")
    return {(r["y"], r["p"]): r["count"] for r in rows}


def per_class(cells: dict) -> dict:
    """{class: (precision, recall, f1, support)}; a zero denominator gives 0."""
    classes = sorted({c for pair in cells for c in pair if c is not None})
    out = {}
    for c in classes:
        hit = cells.get((c, c), 0)
        support = sum(n for (y, _), n in cells.items() if y == c)
        named = sum(n for (_, p), n in cells.items() if p == c)
        precision, recall = hit / named if named else 0.0, hit / support if support else 0.0
        out[c] = (precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0, support)
    return out


def metrics_of(cells: dict, average: str | None = None) -> dict[str, float]:
    """accuracy, precision, recall, f1: of the higher class for two labels, else weighted by support."""
    scores, total = per_class(cells), sum(cells.values())
    labels = sorted({y for y, _ in cells})
    average = average or ("binary" if len(labels) == 2 else "weighted")
    if average == "binary":
        precision, recall, f1, _ = scores[labels[-1]]
    else:
        precision, recall, f1 = (sum(s[i] * s[3] for s in scores.values()) / total if total else 0.0 for i in range(3))
    accuracy = sum(n for (y, p), n in cells.items() if y == p) / total if total else 0.0
    return {"accuracy": accuracy, "precision": precision, "recall": recall, "f1": f1}


METRICS = ["accuracy", "precision", "recall", "f1"]


def classification_metrics(df: DataFrame, label: str, prediction: str, average: str | None = None) -> DataFrame:
    m = metrics_of(cells_of(df, label, prediction), average)
    return rows_frame(df.sparkSession, [tuple(round(m[k], fv.METRIC_DIGITS) for k in METRICS)], ", ".join(f"{k} double" for k in METRICS))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Every (label, prediction) pair of the classes seen on either side, zeros included."""
    cells = cells_of(df, label, prediction)
    classes = sorted({c for pair in cells for c in pair if c is not None})
    rows = [(str(y), str(p), cells.get((y, p), 0)) for y in classes for p in classes]
    return rows_frame(df.sparkSession, rows, "label string, prediction string, n long")


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    cells = cells_of(df, label, prediction)
    scores = per_class(cells)
    total = sum(s[3] for s in scores.values())
    rows = [(str(c), *s) for c, s in scores.items()]
    for name, weight in (("macro avg", lambda s: 1 / len(scores)), ("weighted avg", lambda s: s[3] / total)):
        rows.append((name, *[sum(s[i] * weight(s) for s in scores.values()) for i in range(3)], total))
    return rows_frame(df.sparkSession, rows, "class string, precision double, recall double, f1 double, support long")


def _score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    y = (col(label) == 1).cast("long")
    return df.groupBy(col(score).alias("threshold")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def roc_points(df: DataFrame, label: str, score: str, **sizes) -> DataFrame:
    """(threshold, fpr, tpr) from the highest score down; equal scores are one point, the origin comes first."""
    groups = _score_groups(df, label, score)
    total = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    summed = running_sums(groups, [-F.col("threshold").cast("double")], {"tp": F.col("pos"), "fp": F.col("neg")}, **sizes)
    points = summed.select(F.col("threshold").cast("double").alias("threshold"), F.try_divide(F.col("fp"), F.lit(total["n"])).alias("fpr"),
                           F.try_divide(F.col("tp"), F.lit(total["p"])).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(points)


def roc_auc_value(df: DataFrame, label: str, score: str, **sizes) -> float | None:
    """Share of (positive, negative) pairs ranked rightly, ties counting half."""
    summed = running_sums(_score_groups(df, label, score), [F.col("threshold").cast("double")], {"under": F.col("neg")}, **sizes)
    won = F.col("pos") * (F.col("under") - F.col("neg") / 2)
    row = summed.agg(F.sum(won.cast("double")).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return row["won"] / row["p"] / row["n"] if row["p"] and row["n"] else None


def roc_auc(df: DataFrame, label: str, score: str, **sizes) -> DataFrame:
    return rows_frame(df.sparkSession, [(roc_auc_value(df, label, score, **sizes),)], "roc_auc double")


def regression_values(df: DataFrame, label: str, prediction: str) -> dict[str, float | None]:
    y, e = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    row = df.agg(F.avg(e * e).alias("mse"), F.var_pop(y).alias("var")).first()
    if row["mse"] is None:
        return {"rmse": None, "r2": None}
    return {"rmse": row["mse"] ** 0.5, "r2": 1 - row["mse"] / row["var"] if row["var"] else None}


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    m = regression_values(df, label, prediction)
    return rows_frame(df.sparkSession, [(m["rmse"], m["r2"])], "rmse double, r2 double")


def unsup_eval(df: DataFrame, label: str, flag: str) -> DataFrame:
    """Precision, recall, F1 of 0/1 flags against labels, with the four counts."""
    cells = cells_of(df, label, flag)
    m = metrics_of(cells, "binary") if {y for y, _ in cells} == {0, 1} else {"precision": 0.0, "recall": 0.0, "f1": 0.0}
    row = tuple(round(m[k], fv.METRIC_DIGITS) for k in ("precision", "recall", "f1"))
    counts = tuple(cells.get(pair, 0) for pair in ((0, 0), (0, 1), (1, 0), (1, 1)))
    return rows_frame(df.sparkSession, [row + counts], "precision double, recall double, f1 double, tn long, fp long, fn long, tp long")


def score_histogram(df: DataFrame, score: str, bins: int | None = None) -> DataFrame:
    return histogram(df, score, bins)


def leaderboard(spark, results: dict[str, dict], sort_by: str = "f1") -> DataFrame:
    """Models by falling score with their rank and whether they were tuned."""
    ranked = sorted(results.items(), key=lambda kv: (-kv[1]["metrics"][sort_by], kv[0]))
    rows = [(i + 1, name, *[float(round(res["metrics"][k], fv.METRIC_DIGITS)) for k in METRICS], "Optimized" if res.get("params") else "Baseline")
            for i, (name, res) in enumerate(ranked)]
    return rows_frame(spark, rows, "rank int, model string, " + ", ".join(f"{k} double" for k in METRICS) + ", tuning string")


def leaderboard_long(board: DataFrame) -> DataFrame:
    return board.unpivot(["model"], METRICS, "metric", "score")
