"""Queries over sources, profiling, roles, statistics, outliers, chart numbers and insights."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from tabulens.catalog.tables import DIRTY, dirty_events, hash_sql, r, rounded, table, union_sql, unit_sql
from tabulens.operators import charts, insights, outliers, profile, roles, stats
from tabulens.plans.workspace import new_path
from tabulens.sources import load, sensors

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

Q, S = {}, {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


# Sources --------------------------------------------------------------------------------------------------------

def _plain(df, names):
    return df.select(*[F.col(c).cast(k).alias(c) for c, k in names.items()])


CUSTOMER = {"c_custkey": "long", "c_name": "string", "c_nationkey": "long", "c_acctbal": "double", "c_mktsegment": "string"}
SUPPLIER = {"s_suppkey": "long", "s_name": "string", "s_nationkey": "long", "s_acctbal": "double"}
PART = {"p_partkey": "long", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "long", "p_retailprice": "double"}


@query
def load_csv(spark, sf):
    path = new_path(spark, "customer") + ".csv"
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return _plain(load.load_csv(spark, path), CUSTOMER)


S["load_csv"] = """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"""


@query
def load_json(spark, sf):
    path = new_path(spark, "supplier") + ".json"
    table(spark, sf, "supplier").write.json(path)
    return _plain(load.load_json(spark, path), SUPPLIER)


S["load_json"] = "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"


@query
def load_parquet(spark, sf):
    return load.load_parquet(spark, f"{sf}/orders.parquet")


S["load_parquet"] = "SELECT * FROM orders"


def write_workbooks(df, folder):
    """A fixture: each partition of the frame as one minimal workbook, written by the text sink to any file system."""
    names = df.columns

    def cell(v):
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    def save(batches):
        rows = ["<row>" + "".join(cell(n) for n in names) + "</row>"]
        for batch in batches:
            for values in batch.astype(object).itertuples(index=False):
                rows.append("<row>" + "".join(cell(v) for v in values) + "</row>")
        if len(rows) > 1:
            sheet = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
                     + "".join(rows) + "</sheetData></worksheet>")
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
                book.writestr("xl/worksheets/sheet1.xml", sheet)
            yield pd.DataFrame({"book": [buffer.getvalue()]})

    # A line end after the archive does no harm: archives are read from their end.
    df.mapInPandas(save, "book binary").select(F.expr("CAST(book AS STRING)").alias("value")).write.text(folder)


@query
def load_xlsx(spark, sf):
    path = new_path(spark, "part") + ".xlsx"
    write_workbooks(table(spark, sf, "part").repartition(4), path)
    return _plain(load.load(spark, path), PART)


S["load_xlsx"] = "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"


@query
def load_dispatch(spark, sf):
    base, counts = new_path(spark, "dispatch"), []
    src = table(spark, sf, "supplier")
    src.write.parquet(base + ".parquet")
    src.write.json(base + ".json")
    src.write.option("header", True).csv(base + ".csv")
    for ext in ("csv", "json", "parquet"):
        df = load.load(spark, f"{base}.{ext}")
        counts.append(df.agg(F.lit(ext).alias("format"), F.count(F.lit(1)).alias("n_rows"),
                             F.round(F.sum("s_acctbal"), 2).alias("total")))
    return charts.union_all(counts)


S["load_dispatch"] = union_sql([
    f"SELECT '{e}' AS format, count(*) AS n_rows, round(sum(s_acctbal), 2) AS total FROM supplier" for e in ("csv", "json", "parquet")])


def _sources(spark, sf):
    base = new_path(spark, "many")
    c, s = f"{base}/customers.csv", f"{base}/suppliers.parquet"
    table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"),
                                        F.col("c_mktsegment").alias("segment")).write.option("header", True).csv(c)
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"),
                                        F.col("s_name").alias("name")).write.parquet(s)
    return load.union_sources(spark, [c, s])


@query
def union_sources(spark, sf):
    return _plain(_sources(spark, sf), {"key": "long", "balance": "double", "segment": "string", "name": "string", "source_file": "string"})


S["union_sources"] = """SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS name, 'customers.csv' AS source_file FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name, 'suppliers.parquet' FROM supplier"""


@query
def rows_per_source(spark, sf):
    return load.rows_per_source(_sources(spark, sf))


S["rows_per_source"] = """SELECT 'customers.csv' AS source_file, count(*) AS n FROM customer
UNION ALL SELECT 'suppliers.parquet', count(*) FROM supplier"""


@query
def gen_sensor(spark, sf):
    ids = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return rounded(sensors.sensor_readings(ids), 4)


def _gen_sensor_sql():
    k, pi = "id", "pi()"
    normal = lambda seed: f"(sqrt(-2.0 * ln({unit_sql(k, seed)})) * cos(2 * {pi} * {unit_sql(k, seed + 1)}))"
    sign = lambda seed: f"(CASE WHEN {unit_sql(k, seed)} < 0.5 THEN -1.0 ELSE 1.0 END)"
    rank = lambda seed: f"row_number() OVER (ORDER BY {hash_sql(k, seed)})"
    return f"""WITH base AS (SELECT event_id AS id FROM events),
ranked AS (SELECT id, count(*) OVER () AS n, {rank(1)} AS r1, {rank(2)} AS r2, {rank(3)} AS r3, {rank(4)} AS r4 FROM base),
f AS (SELECT id, id / CAST(n - 1 AS DOUBLE) AS phase, r1 <= round(0.08 * n) AS bad,
 r2 <= round(0.01 * n) AS h2, r3 <= round(0.01 * n) AS h3, r4 <= round(0.01 * n) AS h4 FROM ranked)
SELECT id, TIMESTAMP '2024-01-01' + to_minutes(id * 10) AS "timestamp",
 CASE WHEN NOT h2 THEN round(70.0 + 5.0 * sin(4 * {pi} * phase) + 1.0 * {normal(10)} + CASE WHEN bad THEN 20.0 * {sign(20)} ELSE 0 END, 2) END AS temperature,
 CASE WHEN NOT h3 THEN round(101.3 + 0.5 * {normal(12)}, 3) END AS pressure,
 round(-0.5 * ln({unit_sql(k, 14)}) + CASE WHEN bad THEN 5.0 + 5.0 * {unit_sql(k, 21)} ELSE 0 END, 4) AS vibration,
 CASE WHEN NOT h4 THEN round(greatest(20.0, least(90.0, 55.0 + 3.0 * {normal(15)})), 1) END AS humidity,
 round(5.0 + 0.3 * sin(6 * {pi} * phase) + 0.2 * {normal(17)} + CASE WHEN bad THEN 3.0 * {sign(22)} ELSE 0 END, 3) AS current,
 CAST(bad AS BIGINT) AS anomaly FROM f"""


S["gen_sensor"] = _gen_sensor_sql()


# Profile --------------------------------------------------------------------------------------------------------

EVENT_TYPES = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")]


@query
def preview(spark, sf):
    return profile.preview(table(spark, sf, "events"), ["ts", "event_id"])


S["preview"] = "SELECT * FROM events ORDER BY ts, event_id LIMIT 5"


@query
def validate_dataset(spark, sf):
    return profile.validate_dataset(table(spark, sf, "orders"))


S["validate_dataset"] = "SELECT count(*) > 0 AS is_valid, CASE WHEN count(*) > 0 THEN 'Dataset loaded successfully' ELSE 'Dataset is empty' END AS message FROM orders"


@query
def profile_overview(spark, sf):
    return rounded(profile.profile_overview(table(spark, sf, "events")))


S["profile_overview"] = union_sql([
    f'SELECT CAST({i} AS BIGINT) AS position, \'{c}\' AS "column", \'{k}\' AS dtype, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM events'
    for i, (c, k) in enumerate(EVENT_TYPES)])


@query
def profile_bytes(spark, sf):
    return profile.profile_bytes(table(spark, sf, "events"))


S["profile_bytes"] = union_sql([
    f'SELECT \'{c}\' AS "column", CAST({"sum(octet_length(encode(" + c + ")))" if k == "string" else "8 * count(*)"} AS BIGINT) AS n_bytes FROM events'
    for c, k in EVENT_TYPES])


@query
def missing_values(spark, sf):
    return rounded(profile.missing_values(dirty_events(spark, sf)))


S["missing_values"] = f"WITH {DIRTY}\n" + union_sql([
    f'SELECT \'{c}\' AS "column", count(*) FILTER ({c} IS NULL) AS missing_count, {r(f"count(*) FILTER ({c} IS NULL) * 100.0 / count(*)")} AS missing_pct FROM dirty'
    for c, _ in EVENT_TYPES])


@query
def duplicate_rows(spark, sf):
    return rounded(profile.duplicate_rows(dirty_events(spark, sf)))


S["duplicate_rows"] = f"""WITH {DIRTY}, g AS (SELECT count(*) AS n FROM dirty GROUP BY event_id, ts, user_id, event_type, value, props)
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, {r("sum(n - 1) * 100.0 / sum(n)")} AS duplicate_pct FROM g"""


@query
def nunique(spark, sf):
    return profile.nunique(dirty_events(spark, sf))


S["nunique"] = f"WITH {DIRTY}\n" + union_sql([
    f'SELECT \'{c}\' AS "column", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct_with_missing FROM dirty'
    for c, _ in EVENT_TYPES])


@query
def quality_issues(spark, sf):
    return rounded(profile.quality_issues(dirty_events(spark, sf)))


S["quality_issues"] = f"""WITH {DIRTY}, m AS (SELECT count(*) FILTER (value IS NULL) * 100.0 / count(*) AS pct FROM dirty),
g AS (SELECT count(*) AS n FROM dirty GROUP BY event_id, ts, user_id, event_type, value, props), d AS (SELECT sum(n - 1) * 100.0 / sum(n) AS pct FROM g)
SELECT CAST(0 AS BIGINT) AS seq, 'value' AS "column", 'missing' AS issue, 'info' AS severity, {r("pct")} AS value,
 'ℹ Column ''value'' has ' || printf('%.1f', CAST(pct AS DOUBLE)) || '% missing values' AS message FROM m
UNION ALL SELECT 1, NULL, 'duplicates', 'warning', {r("pct")}, '⚠ Dataset has ' || printf('%.1f', CAST(pct AS DOUBLE)) || '% duplicate rows' FROM d WHERE pct > 5
UNION ALL SELECT 2, 'props', 'high_cardinality', 'warning', count(DISTINCT props), '⚠ Column ''props'' has high cardinality (' || count(DISTINCT props) || ' unique values)'
 FROM dirty HAVING count(DISTINCT props) > 50 AND count(DISTINCT props) < 0.05 * count(*)"""


@query
def missing_map(spark, sf):
    return rounded(charts.missing_map(dirty_events(spark, sf), "event_id"))


S["missing_map"] = f"""WITH {DIRTY}, b AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM dirty),
t AS (SELECT least(CAST(floor((event_id - lo) / ((hi - lo) / 20.0::DOUBLE)) AS BIGINT), 19) AS bucket, dirty.* FROM dirty, b)
""" + union_sql([f'SELECT bucket, \'{c}\' AS "column", {r(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)")} AS missing_rate FROM t GROUP BY bucket'
                 for c, _ in EVENT_TYPES if c != "event_id"])


@query
def clean_compare(spark, sf):
    raw = dirty_events(spark, sf)
    return profile.clean_compare(raw, raw.dropDuplicates().na.fill({"value": 0.0}))


S["clean_compare"] = f"""WITH {DIRTY}
SELECT 'raw' AS stage, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns, count(*) FILTER (value IS NULL) AS missing_cells FROM dirty
UNION ALL SELECT 'cleaned', count(*), 6, 0 FROM (SELECT DISTINCT * FROM dirty)"""


# Roles ----------------------------------------------------------------------------------------------------------

KINDS = {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "int", "c_mktsegment": "text"}


def _roles_sql(tab, kinds):
    parts = []
    for i, (c, k) in enumerate(kinds.items()):
        if k == "int":
            rest = f"WHEN d <= 10 AND n > 50 THEN 'categorical' ELSE 'numerical'"
        elif k == "datetime":
            rest = "ELSE 'datetime'"
        else:
            rest = "WHEN len > 50 THEN 'text' WHEN d / n < 0.05 THEN 'categorical' ELSE 'text'"
        length = f"avg(coalesce(length({c}), 3))" if k == "text" else "0"
        parts.append(f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", CASE WHEN d = n AND n > 10 THEN 'identifier' {rest} END AS role, d AS n_distinct
FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS d, {length} AS len FROM {tab})""")
    return union_sql(parts)


@query
def column_roles(spark, sf):
    return rounded(roles.column_roles(table(spark, sf, "customer")))


S["column_roles"] = _roles_sql("customer", KINDS)


@query
def role_summary(spark, sf):
    return roles.role_summary(table(spark, sf, "customer"))


S["role_summary"] = f"""WITH roles AS ({_roles_sql("customer", KINDS)}), names(role) AS (VALUES ('numerical'), ('categorical'), ('datetime'), ('text'), ('identifier'))
SELECT n.role, count(r.role) AS n_columns, coalesce(string_agg(r."column", ',' ORDER BY position), '') AS columns
FROM names n LEFT JOIN roles r ON r.role = n.role GROUP BY n.role"""


@query
def target_guess(spark, sf):
    return roles.target_guess(table(spark, sf, "customer"))


S["target_guess"] = f"""WITH roles AS ({_roles_sql("customer", KINDS)}), low AS (SELECT min(c_custkey) AS a, min(c_nationkey) AS b, min(c_acctbal) AS c FROM customer)
SELECT "column" AS target FROM roles, low WHERE role = 'numerical' AND n_distinct > 10
 AND CASE "column" WHEN 'c_custkey' THEN a WHEN 'c_nationkey' THEN b ELSE c END >= 0 ORDER BY position LIMIT 1"""


@query
def problem_type(spark, sf):
    return roles.problem_type(table(spark, sf, "events"), ["event_type", "user_id", "value", "props"])


S["problem_type"] = "WITH roles AS (" + _roles_sql("events", {"event_type": "text", "user_id": "int", "value": "int", "props": "text"}) + """)
SELECT "column" AS target, CASE WHEN role = 'categorical' OR (role = 'numerical' AND n_distinct <= 10) THEN 'classification' ELSE 'regression' END AS problem_type FROM roles"""


# Statistics -----------------------------------------------------------------------------------------------------

@query
def numeric_stats(spark, sf):
    return rounded(stats.numeric_stats(table(spark, sf, "lineitem"), LINE), 4)


def _stats_sql(tab, cols, digits):
    forms = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
             "skewness": "skewness({c})", "kurtosis": "kurtosis({c})", "q25": "quantile_cont({c}, 0.25)", "q75": "quantile_cont({c}, 0.75)",
             "iqr": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"}
    return union_sql([f'SELECT \'{c}\' AS "column", count({c}) AS count, ' + ", ".join(
        f'{r(f.format(c=c), digits)} AS "{name}"' for name, f in forms.items()) + f" FROM {tab}" for c in cols])


S["numeric_stats"] = _stats_sql("lineitem", LINE, 4)


@query
def describe_all(spark, sf):
    df = table(spark, sf, "orders")
    return rounded(stats.describe_all(df, ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderdate", "o_orderpriority"]), 4)


S["describe_all"] = union_sql(
    [f"""SELECT '{c}' AS "column", count({c}) AS count, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq,
 {r(f"avg({c})", 4)} AS mean, {r(f"stddev_samp({c})", 4)} AS std, {r(f"min({c})", 4)} AS "min", {r(f"quantile_cont({c}, 0.25)", 4)} AS q25,
 {r(f"quantile_cont({c}, 0.5)", 4)} AS median, {r(f"quantile_cont({c}, 0.75)", 4)} AS q75, {r(f"max({c})", 4)} AS "max" FROM orders"""
     for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    + [f"""(WITH v AS (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1)
SELECT '{c}', (SELECT CAST(sum(n) AS BIGINT) FROM v), (SELECT count(*) FROM v), v, n, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM v ORDER BY n DESC, v LIMIT 1)"""
       for c in ("o_orderstatus", "o_orderdate", "o_orderpriority")])

CATS = [("events", "event_type"), ("orders", "o_orderpriority")]
COUNTS = 'SELECT \'{c}\' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}'


@query
def categorical_stats(spark, sf):
    return stats.categorical_stats(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


S["categorical_stats"] = "WITH v AS (" + union_sql([COUNTS.format(c=c, t="orders") for c in ("o_orderstatus", "o_orderpriority")]) + """),
k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS most, row_number() OVER (PARTITION BY "column" ORDER BY n, value) AS least FROM v)
SELECT "column", count(*) AS unique_count, max(value) FILTER (most = 1) AS most_frequent, max(n) AS most_frequent_count,
 max(value) FILTER (least = 1) AS least_frequent, min(n) AS least_frequent_count FROM k GROUP BY "column" """


@query
def top_values(spark, sf):
    return rounded(stats.top_values(table(spark, sf, "events"), ["event_type", "user_id", "props"]))


S["top_values"] = "WITH v AS (" + union_sql([COUNTS.format(c=c, t="events") for c in ("event_type", "user_id", "props")]) + """)
SELECT * FROM (SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM v) WHERE rank <= 10"""


@query
def value_counts(spark, sf):
    return stats.value_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_partkey"])


S["value_counts"] = union_sql([COUNTS.format(c=c, t="lineitem") for c in ("l_returnflag", "l_linestatus", "l_partkey")])


@query
def year_counts(spark, sf):
    return rounded(stats.year_counts(table(spark, sf, "orders"), "o_orderdate"))


S["year_counts"] = "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1"


@query
def corr_matrix(spark, sf):
    return rounded(stats.corr_matrix(table(spark, sf, "lineitem"), LINE))


S["corr_matrix"] = union_sql([f"SELECT '{x}' AS col_x, '{y}' AS col_y, {r(f'corr({x}, {y})')} AS r FROM lineitem" for x in LINE for y in LINE])

STRONG = ["l_quantity", "l_extendedprice", "net", "charge"]


def _with_net(spark, sf):
    return table(spark, sf, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn(
        "charge", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))


@query
def strong_corr(spark, sf):
    return rounded(stats.strong_corr(_with_net(spark, sf), STRONG))


S["strong_corr"] = """WITH t AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem),
p AS (""" + union_sql([f"SELECT '{x}' AS col_x, '{y}' AS col_y, {r(f'corr({x}, {y})')} AS r FROM t"
                        for i, x in enumerate(STRONG) for y in STRONG[i + 1:]]) + ") SELECT * FROM p WHERE abs(r) >= 0.7"


# Outliers -------------------------------------------------------------------------------------------------------

def _bounds(tab, c, name="b"):
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    return f"{name} AS (SELECT {q1} - 1.5 * ({q3} - {q1}) AS lo, {q3} + 1.5 * ({q3} - {q1}) AS hi, {q3} - {q1} AS iqr FROM {tab})"


@query
def outliers_iqr(spark, sf):
    return outliers.outliers_iqr(table(spark, sf, "events"), "value").select("event_id", "value", "is_outlier")


S["outliers_iqr"] = f"WITH {_bounds('events', 'value')} SELECT event_id, value, value < lo OR value > hi AS is_outlier FROM events, b"


@query
def outliers_zscore(spark, sf):
    return outliers.outliers_zscore(dirty_events(spark, sf), "value").select("event_id", "value", "is_outlier")


S["outliers_zscore"] = f"""WITH {DIRTY}, m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM dirty)
SELECT event_id, value, coalesce(abs((value - a) / s) > 3, false) AS is_outlier FROM dirty, m"""


@query
def outlier_summary(spark, sf):
    return outliers.outlier_summary(table(spark, sf, "lineitem"), LINE)


S["outlier_summary"] = union_sql([f"""(WITH {_bounds('lineitem', c)}, m AS (SELECT avg({c}) AS a, stddev_pop({c}) AS s FROM lineitem)
SELECT '{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi) AS iqr_outliers, count(*) FILTER (abs(({c} - a) / s) > 3) AS zscore_outliers FROM lineitem, b, m)""" for c in LINE])


@query
def iqr_filter_seq(spark, sf):
    return outliers.iqr_filter_seq(_with_net(spark, sf), ["net", "charge", "l_quantity"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round("net", 4).alias("net")).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


S["iqr_filter_seq"] = f"""WITH t0 AS (SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem),
{_bounds('t0', 'net', 'b0')}, t1 AS (SELECT t0.* FROM t0, b0 WHERE net BETWEEN lo AND hi),
{_bounds('t1', 'charge', 'b1')}, t2 AS (SELECT t1.* FROM t1, b1 WHERE charge BETWEEN lo AND hi),
{_bounds('t2', 'l_quantity', 'b2')}, t3 AS (SELECT t2.* FROM t2, b2 WHERE l_quantity BETWEEN lo AND hi)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity, round(net, 4) AS net FROM t3"""


@query
def iqr_filter_joint(spark, sf):
    return outliers.iqr_filter_joint(table(spark, sf, "events"), ["value", "user_id"])


S["iqr_filter_joint"] = f"""WITH {_bounds('events', 'value', 'b')}, {_bounds('events', 'user_id', 'u')}
SELECT events.* FROM events, b, u WHERE value BETWEEN b.lo AND b.hi AND user_id BETWEEN u.lo AND u.hi"""


@query
def iqr_cap(spark, sf):
    return rounded(outliers.iqr_cap(table(spark, sf, "events"), ["value"]).select("event_id", "value"))


S["iqr_cap"] = f"WITH {_bounds('events', 'value')} SELECT event_id, {r('greatest(least(value, hi), lo)')} AS value FROM events, b"


# Chart numbers --------------------------------------------------------------------------------------------------

@query
def histogram(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "events"), "value"))


S["histogram"] = f"""WITH m AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
k AS (SELECT *, greatest(1, ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1.0 / 3)))) AS bins FROM m),
w AS (SELECT *, (hi - lo) / bins AS width FROM k),
b AS (SELECT CAST(least(floor((value - lo) / width), bins - 1) AS BIGINT) AS bin, count(*) AS count FROM events, w GROUP BY 1)
SELECT bin, {r("lo + bin * width")} AS lower, {r("lo + (bin + 1) * width")} AS upper, count, {r("count / (n * width)")} AS density FROM b, w"""


DENSITY_POINTS = 60


@query
def density_curve(spark, sf):
    """The curve of every measure, in shares of its range so that columns of any scale compare."""
    t = table(spark, sf, "lineitem")
    span = t.agg(*[(F.max(c) - F.min(c)).alias(c) for c in LINE]).first()
    found = charts.density_curve(t, LINE, DENSITY_POINTS, cut=1.0)
    scale = F.element_at(F.create_map(*[F.lit(x) for c in LINE for x in (c, float(span[c]))]), F.col("column"))
    return rounded(found.select("column", "point", "x", (F.col("density") * scale).alias("density")))


S["density_curve"] = union_sql([f"""SELECT * FROM (WITH v AS (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem WHERE {c} IS NOT NULL),
m AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h FROM v),
g AS (SELECT CAST(p AS BIGINT) AS point, lo - h + p * (hi - lo + 2 * h) / {DENSITY_POINTS - 1} AS x, n, h, hi - lo AS span FROM m, range({DENSITY_POINTS}) t(p)),
d AS (SELECT point, any_value(x) AS x, sum(exp(-pow((x - v) / h, 2) / 2)) * any_value(span) / any_value(n) / any_value(h) / sqrt(2 * pi()) AS density FROM g, v GROUP BY point)
SELECT '{c}' AS "column", point, {r("x")} AS x, {r("density")} AS density FROM d)""" for c in LINE])


@query
def boxplot(spark, sf):
    return rounded(charts.boxplot(table(spark, sf, "lineitem"), LINE))


S["boxplot"] = union_sql([f"""(WITH {_bounds('lineitem', c)}, q AS (SELECT quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75 FROM lineitem)
SELECT '{c}' AS "column", {r("max(q25)")} AS q25, {r("max(median)")} AS median, {r("max(q75)")} AS q75, {r(f"min({c}) FILTER ({c} BETWEEN lo AND hi)")} AS whisker_low,
 {r(f"max({c}) FILTER ({c} BETWEEN lo AND hi)")} AS whisker_high, count(*) FILTER ({c} < lo OR {c} > hi) AS n_fliers FROM lineitem, b, q)""" for c in LINE])


@query
def pair_bins(spark, sf):
    return rounded(charts.pair_bins(table(spark, sf, "lineitem"), LINE))


S["pair_bins"] = "WITH m AS (SELECT " + ", ".join(f"min({c}) AS a{i}, max({c}) AS b{i}" for i, c in enumerate(LINE)) + " FROM lineitem),\nt AS (SELECT " + ", ".join(
    f"CAST(least(floor(({c} - a{i}) / ((b{i} - a{i}) / 20)), 19) AS BIGINT) AS g{i}" for i, c in enumerate(LINE)) + " FROM lineitem, m)\n" + union_sql(
    [f"SELECT '{LINE[i]}' AS col_x, '{LINE[j]}' AS col_y, g{i} AS bin_x, g{j} AS bin_y, count(*) AS n FROM t GROUP BY g{i}, g{j}"
     for i in range(4) for j in range(i + 1, 4)])


# Insights -------------------------------------------------------------------------------------------------------

@query
def insights_text(spark, sf):
    return insights.insights(dirty_events(spark, sf)).select(F.col("insight"))


Q["insights"] = Q.pop("insights_text")

NUMS = ["event_id", "user_id", "value"]
S["insights"] = f"""WITH {DIRTY}, n AS (SELECT count(*) AS n, count(*) FILTER (value IS NULL) AS holes FROM dirty),
st AS (""" + union_sql([f"SELECT '{c}' AS c, skewness({c}) AS sk FROM dirty" for c in NUMS]) + """),
co AS (""" + union_sql([f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS r FROM dirty" for i, x in enumerate(NUMS) for y in NUMS[i + 1:]]) + """),
o AS (""" + union_sql([f"""(WITH {_bounds('dirty', c)}, m AS (SELECT avg({c}) AS a, stddev_pop({c}) AS s FROM dirty)
SELECT '{c}' AS c, greatest(count(*) FILTER ({c} < lo OR {c} > hi), count(*) FILTER (abs(({c} - a) / s) > 3)) AS k FROM dirty, b, m)""" for c in NUMS]) + """)
SELECT 'Dataset contains ' || n || ' rows and 6 columns' AS insight FROM n
UNION ALL SELECT 'Dataset has ' || printf('%.1f', CAST(holes AS DOUBLE) / (n * 6) * 100) || '% missing values overall' FROM n WHERE holes > 0
UNION ALL SELECT 'Found 3 numerical and ' || CASE WHEN count(DISTINCT props) < 0.05 * count(*) THEN 2 ELSE 1 END || ' categorical columns' FROM dirty
UNION ALL SELECT 'Column ''' || c || ''' is highly ' || CASE WHEN sk > 0 THEN 'right' ELSE 'left' END || '-skewed (skewness: ' || printf('%.2f', sk) || ')' FROM st WHERE abs(sk) > 1
UNION ALL (SELECT CASE WHEN abs(r) > 0.8 THEN 'strong' ELSE 'moderate' END || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END || ' correlation (' || printf('%.2f', r) || ') between ''' || x || ''' and ''' || y || '''' FROM co WHERE abs(r) >= 0.7 ORDER BY abs(r) DESC LIMIT 3)
UNION ALL SELECT 'Column ''' || c || ''' has ' || k || ' outliers (' || printf('%.1f', k * 100.0::DOUBLE / n) || '%)' FROM o, n WHERE k > 0"""


@query
def fe_suggestions(spark, sf):
    return insights.suggestions(dirty_events(spark, sf)).select("suggestion")


S["fe_suggestions"] = f"WITH {DIRTY}, st AS (" + union_sql([f"SELECT '{c}' AS c, skewness({c}) AS sk FROM dirty" for c in NUMS]) + """)
SELECT CASE WHEN sk > 0 THEN 'Consider log transformation for right-skewed ''' ELSE 'Consider square transformation for left-skewed ''' END || c || '''' AS suggestion FROM st WHERE abs(sk) > 1
UNION ALL SELECT 'Consider one-hot encoding for categorical columns: [''event_type''' || CASE WHEN count(DISTINCT props) < 0.05 * count(*) THEN ', ''props'']' ELSE ']' END FROM dirty
UNION ALL SELECT 'Extract features from datetime columns: [''ts'']'
UNION ALL SELECT 'Consider standardizing numerical features for ML models'"""
