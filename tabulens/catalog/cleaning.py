"""Queries over the cleaning steps and the time-series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.catalog.tables import DIRTY, dirty_events, r, rounded, table, union_sql
from tabulens.operators import clean, timeseries

Q, S = {}, {}
BY, ORDER = ["user_id"], ["ts", "event_id"]


def query(fn):
    Q[fn.__name__] = fn
    return fn


# Cleaning steps -------------------------------------------------------------------------------------------------

@query
def clean_names(spark, sf):
    o = table(spark, sf, "orders")
    messy = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").toDF("  Order  Key ", "Cust\tKEY", "order_STATUS", "TOTAL   price")
    wide = messy.withColumn("order key", F.lit(0)).withColumn("b", F.lit(1).cast("long"))
    return clean.clean_names(wide)


S["clean_names"] = "SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS order_status, o_totalprice AS total_price, CAST(1 AS BIGINT) AS b FROM orders"


@query
def dedup_rows(spark, sf):
    return clean.dedup_rows(dirty_events(spark, sf))


S["dedup_rows"] = f"WITH {DIRTY} SELECT DISTINCT * FROM dirty"


def _sparse(spark, sf):
    o = table(spark, sf, "orders")
    return o.withColumn("half", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).withColumn(
        "third", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")))


@query
def drop_sparse_cols(spark, sf):
    return clean.drop_sparse_cols(_sparse(spark, sf))


S["drop_sparse_cols"] = "SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS third FROM orders"


@query
def drop_constant_cols(spark, sf):
    o = table(spark, sf, "orders").withColumn("same", F.lit("x")).withColumn("void", F.lit(None).cast("double"))
    return clean.drop_constant_cols(o.withColumn("nearly", F.when(F.col("o_orderkey") > 0, F.lit(1).cast("long"))))


S["drop_constant_cols"] = "SELECT *, CASE WHEN o_orderkey > 0 THEN CAST(1 AS BIGINT) END AS nearly FROM orders"


@query
def drop_id_cols(spark, sf):
    return clean.drop_id_cols(table(spark, sf, "customer")).withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


S["drop_id_cols"] = "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query
def downcast(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").withColumn("big", F.col("o_orderkey") + 16777217)
    d = clean.downcast(o)
    kinds = [F.lit(d.schema[c].dataType.simpleString()).alias(f"{c}_type") for c in ("o_orderkey", "big")]
    return d.select(*[F.col(c).cast("double").alias(c) for c in d.columns], *kinds)


S["downcast"] = """WITH t AS (SELECT *, o_orderkey + 16777217 AS big FROM orders), f AS (SELECT
 max(abs(o_orderkey - CAST(CAST(o_orderkey AS FLOAT) AS DOUBLE))) <= 5e-4 AS a, max(abs(o_custkey - CAST(CAST(o_custkey AS FLOAT) AS DOUBLE))) <= 5e-4 AS b,
 max(abs(o_totalprice - CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE))) <= 5e-4 AS c, max(abs(big - CAST(CAST(big AS FLOAT) AS DOUBLE))) <= 5e-4 AS d FROM t)
SELECT CASE WHEN a THEN CAST(CAST(o_orderkey AS FLOAT) AS DOUBLE) ELSE o_orderkey END AS o_orderkey, CASE WHEN b THEN CAST(CAST(o_custkey AS FLOAT) AS DOUBLE) ELSE o_custkey END AS o_custkey,
 CASE WHEN c THEN CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) ELSE o_totalprice END AS o_totalprice, CASE WHEN d THEN CAST(CAST(big AS FLOAT) AS DOUBLE) ELSE big END AS big,
 CASE WHEN a THEN 'float' ELSE 'bigint' END AS o_orderkey_type, CASE WHEN d THEN 'float' ELSE 'bigint' END AS big_type FROM t, f"""


@query
def fill_bfill_ffill(spark, sf):
    return clean.fill_bfill_ffill(dirty_events(spark, sf).dropDuplicates(), ["value"], BY, ORDER)


FILLED = """coalesce(first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
S["fill_bfill_ffill"] = f"WITH {DIRTY}, d AS (SELECT DISTINCT * FROM dirty) SELECT event_id, ts, user_id, event_type, {FILLED} AS value, props FROM d"


@query
def fill_median_mode(spark, sf):
    d = dirty_events(spark, sf).withColumn("event_type", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    return rounded(clean.fill_median_mode(d))


S["fill_median_mode"] = f"""WITH {DIRTY}, t AS (SELECT * REPLACE (CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type) FROM dirty),
m AS (SELECT quantile_cont(value, 0.5) AS med FROM t), o AS (SELECT event_type AS mode FROM t WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, ts, user_id, coalesce(event_type, mode) AS event_type, {r("coalesce(value, med)")} AS value, props FROM t, m, o"""


@query
def inf_to_null(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).when(
        F.col("event_id") % 13 == 0, F.lit(float("-inf"))).when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return clean.inf_to_null(e)


S["inf_to_null"] = "SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 THEN value END AS value, props FROM events"


def _as_text(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("value").cast("string").alias("num_text"),
                    F.when(F.col("event_id") % 4 == 0, F.lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("when_text"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("all_dates"),
                    F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("event_type")).alias("mixed"))


WHEN = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query
def fix_types(spark, sf):
    d = clean.fix_types(_as_text(spark, sf))
    return d.select("event_id", F.round("num_text", 6).alias("num_text"), F.unix_timestamp("when_text").alias("when_text"),
                    F.unix_timestamp("all_dates").alias("all_dates"), "mixed")


S["fix_types"] = f"""SELECT event_id, round(value, 6) AS num_text, CASE WHEN event_id % 4 <> 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS when_text,
 CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS all_dates, CASE WHEN event_id % 3 = 0 THEN {WHEN} ELSE event_type END AS mixed FROM events"""


@query
def detect_datetime_cols(spark, sf):
    return clean.detect_datetime_cols(_as_text(spark, sf))


S["detect_datetime_cols"] = f"""WITH t AS (SELECT CAST(value AS VARCHAR) AS num_text, CASE WHEN event_id % 4 = 0 THEN 'not a date' ELSE {WHEN} END AS when_text, {WHEN} AS all_dates,
 CASE WHEN event_id % 3 = 0 THEN {WHEN} ELSE event_type END AS mixed FROM events)
""" + union_sql([f"SELECT '{c}' AS \"column\", bool_and(TRY_CAST({c} AS TIMESTAMP) IS NOT NULL) AS is_datetime FROM t" for c in ("num_text", "when_text", "all_dates", "mixed")])


@query
def clean_text(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(" NaN ")).when(F.col("event_id") % 5 == 1, F.lit("None")).when(
        F.col("event_id") % 5 == 2, F.lit("?")).when(F.col("event_id") % 50 == 3, F.lit("  ")).otherwise(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).alias("event_type"), "props")
    return clean.clean_text(e)


S["clean_text"] = "SELECT event_id, CASE WHEN event_id % 5 IN (3, 4) AND event_id % 50 <> 3 THEN lower(event_type) END AS event_type, trim(lower(props)) AS props FROM events"


def _clean(spark, sf):
    d = dirty_events(spark, sf).withColumn("same", F.lit(1)).withColumn("Half  Empty", F.when(F.col("event_id") % 2 == 0, F.lit(1.5)))
    return clean.clean_full(d, order_by=ORDER, partition_by=BY)


@query
def clean_full(spark, sf):
    return rounded(_clean(spark, sf)[0], 3)


S["clean_full"] = f"""WITH {DIRTY}, d AS (SELECT DISTINCT * FROM dirty), f AS (SELECT event_id, ts, user_id, event_type, {FILLED} AS value, props FROM d),
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f),
k AS (SELECT f.* FROM f, b WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
SELECT event_id, ts, user_id, trim(lower(event_type)) AS event_type, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS value, trim(lower(props)) AS props FROM k"""


@query
def clean_report(spark, sf):
    report = _clean(spark, sf)[1]
    return report.select(F.col("step_number").cast("long"), "step_name", "executed", "skipped", "nothing_to_do", F.array_join("messages", " | ").alias("messages"))


S["clean_report"] = f"""WITH {DIRTY}, d AS (SELECT DISTINCT * FROM dirty), f AS (SELECT {FILLED} AS value FROM d),
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f),
k AS (SELECT count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS out FROM f, b),
c AS (SELECT (SELECT count(*) FROM dirty) - (SELECT count(*) FROM d) AS dup, (SELECT CAST(floor(count(*) FILTER (value IS NULL) * 100.0 / count(*)) AS BIGINT) FROM d) AS hole,
 (SELECT CAST(floor(count(*) FILTER (event_id % 2 <> 0) * 100.0 / count(*)) AS BIGINT) FROM d) AS half)
SELECT CAST(n AS BIGINT) AS step_number, name AS step_name, true AS executed, false AS skipped, idle AS nothing_to_do, m AS messages FROM (
 SELECT 1 AS n, 'Normalize Column Names' AS name, false AS idle, 'Half  Empty → half_empty' AS m
 UNION ALL SELECT 2, 'Remove Duplicate Rows', false, 'Removed ' || dup || ' duplicate rows' FROM c
 UNION ALL SELECT 3, 'Handle Missing Values (Time-series Bfill)', false, 'value: filled ' || hole || '% missing using bfill/ffill | half_empty: dropped (>' || half || '% missing)' FROM c
 UNION ALL SELECT 4, 'Fix Data Types', true, '✅ No action needed'
 UNION ALL SELECT 5, 'Clean Text Columns', false, 'Cleaned 2 text column(s): [''event_type'', ''props'']'
 UNION ALL SELECT 6, 'Handle Infinite Values', true, '✅ No action needed'
 UNION ALL SELECT 7, 'Remove Constant Columns', false, 'Dropped 1 constant column(s): [''same'']'
 UNION ALL SELECT 8, 'Remove Identifier Columns', true, '✅ No action needed'
 UNION ALL SELECT 9, 'Outlier Removal (IQR)', out = 0, CASE WHEN out = 0 THEN '✅ No action needed' ELSE 'value: removed ' || out || ' outlier row(s)' END FROM k
 UNION ALL SELECT 10, 'Downcast Numeric Types & Reset Index', false, 'Downcast 1 column(s) to save memory; index reset')"""


# Time series ----------------------------------------------------------------------------------------------------

W = "PARTITION BY user_id ORDER BY ts, event_id"
DEDUP = f"WITH {DIRTY}, d AS (SELECT DISTINCT * FROM dirty)"


def _series(spark, sf):
    return dirty_events(spark, sf).dropDuplicates()


def _keep(df, *new):
    return rounded(df.select("event_id", "value", *new))


@query
def rolling_mean(spark, sf):
    return _keep(timeseries.add_rolling(_series(spark, sf), "value", BY, ORDER), "value_rolling_mean_5")


S["rolling_mean"] = f"{DEDUP} SELECT event_id, value, {r(f'avg(value) OVER ({W} ROWS 4 PRECEDING)')} AS value_rolling_mean_5 FROM d"


@query
def rolling_std(spark, sf):
    return rounded(timeseries.add_rolling(_series(spark, sf), "value", BY, ORDER).select("event_id", "value_rolling_std_5"), 5)


S["rolling_std"] = f"{DEDUP} SELECT event_id, {r(f'coalesce(stddev_samp(value) OVER ({W} ROWS 4 PRECEDING), 0)', 5)} AS value_rolling_std_5 FROM d"


@query
def lag_features(spark, sf):
    return _keep(timeseries.add_lags(_series(spark, sf), "value", BY, ORDER), "value_lag_1", "value_lag_2")


S["lag_features"] = f"{DEDUP} SELECT event_id, value, lag(value, 1) OVER ({W}) AS value_lag_1, lag(value, 2) OVER ({W}) AS value_lag_2 FROM d"


@query
def diff_feature(spark, sf):
    return _keep(timeseries.add_diff(_series(spark, sf), "value", BY, ORDER), "value_diff")


S["diff_feature"] = f"{DEDUP} SELECT event_id, value, {r(f'value - lag(value) OVER ({W})')} AS value_diff FROM d"


@query
def rate_of_change(spark, sf):
    return rounded(timeseries.add_rate_of_change(_series(spark, sf), "value", BY, ORDER).select("event_id", "value_rate_of_change"), 5)


ROC_CTE = f"p AS (SELECT *, last_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM d)"
ROC = f"CASE WHEN lag(f) OVER ({W}) <> 0 THEN (f / lag(f) OVER ({W}) - 1) * 100 END"
S["rate_of_change"] = f"{DEDUP}, {ROC_CTE} SELECT event_id, {r(ROC, 5)} AS value_rate_of_change FROM p"


@query
def zscore_feature(spark, sf):
    return rounded(timeseries.add_zscore(_series(spark, sf), "value").select("event_id", "value_zscore"))


S["zscore_feature"] = f"{DEDUP}, m AS (SELECT avg(value) AS a, stddev_samp(value) AS s FROM d) SELECT event_id, {r('(value - a) / s')} AS value_zscore FROM d, m"


@query
def datetime_parts(spark, sf):
    parts = timeseries.datetime_parts(table(spark, sf, "events").select("event_id", "ts"))
    return rounded(parts.drop("ts"))


PARTS = "hour(ts) AS ts_hour, day(ts) AS ts_day, month(ts) AS ts_month, isodow(ts) - 1 AS ts_weekday"
S["datetime_parts"] = f"SELECT event_id, {PARTS} FROM events"


@query
def engineer_features(spark, sf):
    out, _ = timeseries.engineer_features(_series(spark, sf), ORDER, BY)
    return rounded(out.drop("ts", "event_type", "props"), 5)


_NEW = {"value_rolling_mean_5": f"avg(value) OVER ({W} ROWS 4 PRECEDING)", "value_rolling_std_5": f"coalesce(stddev_samp(value) OVER ({W} ROWS 4 PRECEDING), 0)",
        "value_lag_1": f"lag(value, 1) OVER ({W})", "value_lag_2": f"lag(value, 2) OVER ({W})", "value_diff": f"value - lag(value) OVER ({W})",
        "value_rate_of_change": ROC, "value_zscore": "(value - a) / s"}
S["engineer_features"] = f"""{DEDUP}, {ROC_CTE}, m AS (SELECT avg(value) AS a, stddev_samp(value) AS s FROM d),
e AS (SELECT p.*, {", ".join(f"{x} AS {n}" for n, x in _NEW.items())} FROM p, m), q AS (SELECT {", ".join(f"quantile_cont({n}, 0.5) AS m{i}" for i, n in enumerate(_NEW))} FROM e)
SELECT event_id, user_id, {r("value", 5)} AS value, {PARTS}, {", ".join(f"{r(f'coalesce({n}, m{i}, 0)', 5)} AS {n}" for i, n in enumerate(_NEW))} FROM e, q"""


@query
def fe_summary(spark, sf):
    df = _series(spark, sf)
    out, _ = timeseries.engineer_features(df, ORDER, BY)
    return rounded(timeseries.fe_summary(df.columns, out))


S["fe_summary"] = "SELECT CAST(seq AS BIGINT) AS seq, g AS feature_group, c AS \"column\" FROM (VALUES " + ", ".join(
    f"({i}, '{g}', '{c}')" for i, (g, c) in enumerate([
        ("other", "ts_hour"), ("other", "ts_day"), ("other", "ts_month"), ("other", "ts_weekday"),
        ("rolling_mean", "value_rolling_mean_5"), ("rolling_std", "value_rolling_std_5"), ("lag", "value_lag_1"), ("lag", "value_lag_2"),
        ("diff", "value_diff"), ("rate_of_change", "value_rate_of_change"), ("zscore", "value_zscore")])) + ") t(seq, g, c)"


@query
def minmax_scale(spark, sf):
    return rounded(timeseries.minmax_scale(table(spark, sf, "part"), exclude=["p_partkey"]))


S["minmax_scale"] = f"""WITH m AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)
SELECT p_partkey, p_name, p_brand, p_type, {r("(p_size - a) / CAST(b - a AS DOUBLE)")} AS p_size, {r("(p_retailprice - c) / (d - c)")} AS p_retailprice FROM part, m"""
