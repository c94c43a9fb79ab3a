"""Column roles, role summary, target guess and problem type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens import fixed_values as fv
from tabulens.functions.columns import DATETIMES, NESTED, NUMBERS
from tabulens.operators.facts import Facts, column_facts
from tabulens.plans.workspace import rows_frame


def infer_roles(df: DataFrame, facts: Facts | None = None, float_ids: bool = True) -> dict[str, str]:
    """Role per column: identifier, datetime, numerical, categorical, text (nested types: other)."""
    facts = facts or column_facts(df)
    roles = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, NESTED):
            roles[f.name] = "other"
            continue
        distinct, n = facts.distinct[f.name], facts.rows
        measured = isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))
        if distinct == n and n > fv.IDENTIFIER_MIN_ROWS and (float_ids or not measured):
            roles[f.name] = "identifier"
        elif isinstance(f.dataType, DATETIMES):
            roles[f.name] = "datetime"
        elif isinstance(f.dataType, NUMBERS + (T.BooleanType,)):
            few = distinct <= fv.CATEGORICAL_MAX_DISTINCT and n > fv.CATEGORICAL_MIN_ROWS
            roles[f.name] = "categorical" if few else "numerical"
        elif (facts.mean_length.get(f.name) or 0) > fv.TEXT_MEAN_LENGTH:
            roles[f.name] = "text"
        else:
            roles[f.name] = "categorical" if n and distinct / n < fv.CATEGORICAL_RATIO else "text"
    return roles


def with_role(roles: dict[str, str], role: str) -> list[str]:
    return [c for c, r in roles.items() if r == role]


def column_roles(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    facts = facts or column_facts(df)
    roles = infer_roles(df, facts)
    rows = [(i, c, roles[c], facts.distinct.get(c)) for i, c in enumerate(df.columns)]
    return rows_frame(df.sparkSession, rows, "position int, column string, role string, n_distinct long")


def role_summary(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Number and names of the columns in each of the five roles."""
    roles = infer_roles(df, facts)
    rows = [(r, len(with_role(roles, r)), ",".join(with_role(roles, r))) for r in fv.ROLES]
    return rows_frame(df.sparkSession, rows, "role string, n_columns long, columns string")


def guess_target(df: DataFrame, roles: dict[str, str], facts: Facts) -> str:
    numerical, categorical = with_role(roles, "numerical"), with_role(roles, "categorical")
    wide = [c for c in numerical if facts.distinct[c] > 10 and (facts.minimum.get(c) or 0) >= 0
            and facts.minimum.get(c) is not None]
    binary = [c for c in categorical if facts.distinct[c] == 2]
    small = [c for c in categorical if 2 < facts.distinct[c] <= 5]
    for group in (wide, binary, small, numerical[-1:]):
        if group:
            return group[0]
    return df.columns[-1]


def problem_type_of(target: str, roles: dict[str, str], facts: Facts) -> str:
    if roles.get(target) == "categorical":
        return "classification"
    if roles.get(target) == "numerical" and facts.distinct[target] <= 10:
        return "classification"
    return "regression"


def target_guess(df: DataFrame) -> DataFrame:
    facts = column_facts(df)
    target = guess_target(df, infer_roles(df, facts), facts)
    return rows_frame(df.sparkSession, [(target,)], "target string")


def problem_type(df: DataFrame, targets: list[str]) -> DataFrame:
    facts = column_facts(df)
    roles = infer_roles(df, facts)
    rows = [(t, problem_type_of(t, roles, facts)) for t in targets]
    return rows_frame(df.sparkSession, rows, "target string, problem_type string")
