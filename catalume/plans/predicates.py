"""One compiler for all predicate languages: a condition tree becomes a Spark column.

A tree is ``{"logic": "AND" | "OR", "conditions": [...]}`` or a clause ``{"field", "operator", "value" or "values"}``, to
any depth. A clause with an unknown field or operator is left out, as is a group without clauses. Patterns take `%` and
`_` in values as wildcards unless ``escape`` is set. Nulls follow SQL: a comparison with null is unknown, `=` and `!=` with
a null value mean IS NULL and IS NOT NULL.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "=": operator.eq, "==": operator.eq, "eq": operator.eq, "equals": operator.eq,
    "!=": operator.ne, "<>": operator.ne, "ne": operator.ne, "not_equals": operator.ne,
    ">": operator.gt, "gt": operator.gt, "greater": operator.gt,
    ">=": operator.ge, "gte": operator.ge, "greaterequal": operator.ge,
    "<": operator.lt, "lt": operator.lt, "less": operator.lt,
    "<=": operator.le, "lte": operator.le, "lessequal": operator.le,
}
NEGATED = {operator.ne}


def all_of(columns: list[Column]) -> Column | None:
    return reduce(operator.and_, columns) if columns else None


def any_of(columns: list[Column]) -> Column | None:
    return reduce(operator.or_, columns) if columns else None


def resolve(df: DataFrame, field: str) -> str | None:
    """The column that a name means: exact first, then without regard to case."""
    if field in df.columns:
        return field
    return {c.lower(): c for c in df.columns}.get(str(field).lower())


def string_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def compare(column: Column, op: str, value: Any) -> Column | None:
    """``column op value``; a null value turns into IS [NOT] NULL."""
    if op not in COMPARE:
        return None
    if value is None:
        return column.isNotNull() if COMPARE[op] in NEGATED else column.isNull()
    return COMPARE[op](column, F.lit(value))


def literal(value: Any) -> str:
    return str(value).replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def pattern(column: Column, value: Any, before: str = "%", after: str = "%", case: bool = False, escape: bool = False) -> Column:
    text = f"{before}{literal(value) if escape else value}{after}"
    return column.like(text) if case else column.ilike(text)


def is_in(column: Column, values: list, negate: bool = False) -> Column:
    """IN and NOT IN; nothing is in an empty list."""
    if not values:
        return F.lit(negate)
    return ~column.isin(values) if negate else column.isin(values)


def flag_set(column: Column, value: Any) -> Column:
    """Whether a cell with a written-out dictionary of flags has ``value`` set to true."""
    return column.ilike(f"%'{value}': True%") | column.ilike(f'%"{value}": True%')


def clause(df: DataFrame, field: str, op: str | None, value: Any = None, values: list | None = None, escape: bool = False) -> Column | None:
    name = resolve(df, field) if field else None
    if name is None:
        return None
    c, op = F.col(f"`{name}`"), str(op or "contains").strip().lower()
    text = c.cast("string")
    many = list(values if values is not None else value if isinstance(value, (list, tuple, set)) else [] if value is None else [value])
    if op in COMPARE:
        if isinstance(value, (list, tuple, set)):
            return is_in(c, many, COMPARE[op] in NEGATED)
        return compare(c, op, value)
    match op:
        case "contains" | "like" | "ilike":
            return any_of([pattern(text, v, escape=escape) for v in many])
        case "contains_exact":
            return any_of([pattern(text, v, case=True, escape=escape) for v in many])
        case "contains_any":
            return any_of([text.ilike(f"%:{v}%") for v in many])
        case "has_flag":
            return any_of([flag_set(text, v) for v in many])
        case "starts_with":
            return any_of([pattern(text, v, before="", escape=escape) for v in many])
        case "ends_with":
            return any_of([pattern(text, v, after="", escape=escape) for v in many])
        case "in":
            return is_in(c, many)
        case "not_in":
            return is_in(c, many, negate=True)
        case "between":
            return c.between(many[0], many[1]) if len(many) == 2 else None
        case "not_between":
            return ~c.between(many[0], many[1]) if len(many) == 2 else None
        case "is_null" | "isnull":
            return c.isNull()
        case "is_not_null" | "isnotnull":
            return c.isNotNull()
        case "regex":
            return any_of([text.rlike(str(v)) for v in many])
        case _:
            part, _, inner = op.partition(" ")
            made = {"date": F.to_date, "year": F.year, "month": F.month}.get(part)
            if made is None:
                return None
            return compare(made(c), inner or "=", F.to_date(F.lit(value)) if part == "date" else value)


def compile_tree(df: DataFrame, tree: dict | list | None, escape: bool = False) -> Column | None:
    """The column of a condition tree; None if no clause is left. A list is an AND group."""
    if not tree:
        return None
    if isinstance(tree, list):
        tree = {"logic": "AND", "conditions": tree}
    if "conditions" in tree:
        made = [c for c in (compile_tree(df, x, escape) for x in tree["conditions"]) if c is not None]
        return any_of(made) if str(tree.get("logic", "AND")).upper() == "OR" else all_of(made)
    return clause(df, tree.get("field") or tree.get("column"), tree.get("operator") or tree.get("op"), tree.get("value"), tree.get("values"), escape)


def apply_tree(df: DataFrame, tree: dict | list | None, escape: bool = False) -> DataFrame:
    made = compile_tree(df, tree, escape)
    return df if made is None else df.where(made)


def any_column_like(df: DataFrame, value: Any, fields: list[str] | None = None) -> Column:
    """Whether any of the fields (default: all string columns) contains a value; no such field: never."""
    names = [n for n in (resolve(df, f) for f in (string_fields(df) if fields is None else fields)) if n]
    made = any_of([pattern(F.col(f"`{n}`").cast("string"), value) for n in names])
    return F.lit(False) if made is None else made


def comma_members(column: Column, values: list[str], separator: str = ", ") -> Column:
    """Whether a lower-cased list cell has any of the values."""
    return F.arrays_overlap(F.split(F.lower(column), separator), F.array(*(F.lit(str(v).lower()) for v in values)))
