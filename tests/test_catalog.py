"""Every registered query that has SQL, compared with it on the smallest tables."""

import ast
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    verdict = compare(entry_module.queries()[name](spark, SF), ORACLE[name], con)
    assert verdict.startswith("ok"), verdict


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 4


def test_no_module_defines_a_name_twice():
    for path in (Path(__file__).parent.parent / "tabulens").rglob("*.py"):
        names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
        assert [n for n, k in names.items() if k > 1] == [], path
