"""Registered queries over the test tables and the SQL that checks them."""

from __future__ import annotations

from tabulens.catalog import cleaning, modelling, profiling

FAMILIES = [profiling, cleaning, modelling]


def queries() -> dict:
    return {name: fn for family in FAMILIES for name, fn in family.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.S.items()}
