"""The JSON query languages, each turned into a condition tree or a query."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import predicates as P
from .query import Query, aggregate, ordered

PART = "__hash__"
#: Columns that a filter on the title looks into.
TITLE_COLUMNS = ("title", "authors", "abstract", "country", "journal")
TYPES = {
    "where": "=", "notwhere": "!=", "inwhere": "in", "notinwhere": "not_in", "likewhere": "contains", "betweenwhere": "between",
    "greater": ">", "less": "<", "greaterequal": ">=", "lessequal": "<=", "isnull": "is_null", "isnotnull": "is_not_null",
}


def grouped_tree(filters: list[dict], across: str = "AND") -> dict:
    """Filters of a payload: OR within a group, ``across`` between groups. A group is a column, or the category of tag columns."""
    groups: dict[str, list[dict]] = {}
    for f in filters:
        kind = str(f.get("type", "where")).lower()
        names = f.get("columns") or [f.get("column")]
        if kind == "multi_column_like":
            made = {"logic": "OR", "conditions": [{"field": n, "operator": "contains", "value": f.get("value")} for n in names]}
        elif kind in TYPES:
            value = f.get("value")
            made = {"field": names[0], "operator": TYPES[kind], "value": None if isinstance(value, list) else value, "values": value if isinstance(value, list) else None}
        else:
            continue
        groups.setdefault(str(names[0]).split(PART)[0], []).append(made)
    return {"logic": across, "conditions": [{"logic": "OR", "conditions": g} for g in groups.values()]}


def normalise(payload: Any) -> dict:
    """A payload from a full one, from ``{column: [values]}`` or from a list of ``{column, op, value}``."""
    ops = {op: kind for kind, op in reversed(TYPES.items())} | {"==": "where", "equals": "where", "not in": "notinwhere", "like": "likewhere", "is null": "isnull", "is not null": "isnotnull"}
    if isinstance(payload, dict) and ("filters" in payload or "columns" in payload or "aggregations" in payload):
        return payload
    if isinstance(payload, dict):
        lists = {c: v if isinstance(v, list) else [v] for c, v in payload.items()}
        return {"filters": [{"type": "where" if len(v) == 1 else "inwhere", "column": c, "value": v[0] if len(v) == 1 else v} for c, v in lists.items() if v]}
    return {"filters": [{"type": ops.get(str(f.get("op", "=")).lower(), "where"), "column": f["column"], "value": f.get("value")} for f in payload or []]}


def run_payload(df: DataFrame, payload: Any) -> tuple[DataFrame, dict | None]:
    """Rows of a grouped payload, and its page's numbers if it asks for a page.

    columns (unknown ones are dropped), filters, filter_operator, group_by, aggregations, order_by, pagination.
    """
    payload = normalise(payload)
    q = Query(df).where_tree(grouped_tree(payload.get("filters", []), payload.get("filter_operator", "AND")))
    if payload.get("columns") and payload["columns"] != ["*"]:
        q = q.select_valid(*payload["columns"], any_case=True)
    for g in [payload["group_by"]] if isinstance(payload.get("group_by"), str) else payload.get("group_by") or []:
        q = q.group_by(g)
    for a in payload.get("aggregations") or []:
        q = q.aggregate(a["func"], a["column"], a.get("alias") or f"{a['func']}_{a['column']}")
    if order := payload.get("order_by"):
        q = q.order_by(order["column"], order.get("direction", "asc"))
    if page := payload.get("pagination"):
        return q.paginate(page.get("page", 1), page.get("page_size", 20), cap=None)
    return q.rows(), None


def expand_title(filters: list[dict]) -> list[dict]:
    """A filter on the title looks into all text columns."""
    return [{"type": "multi_column_like", "columns": list(TITLE_COLUMNS), "value": f.get("value")} if str(f.get("column", "")).lower() == "title" else f for f in filters]


def dynamic_search(df: DataFrame, search: dict) -> DataFrame:
    """``{query, fields}``, ``{conditions, logic}`` or ``{field, values, operator}``; an empty search finds all."""
    if search.get("query"):
        return df.where(P.any_column_like(df, search["query"], search.get("fields")))
    if "conditions" in search:
        return P.apply_tree(df, search)
    if "field" in search:
        op = search.get("operator", "in")
        return P.apply_tree(df, {"field": search["field"], "operator": "not_in" if op == "not_in" else "in", "values": search.get("values") or []})
    return df


def search_all_columns(df: DataFrame, text: str) -> DataFrame:
    return df.where(P.any_column_like(df, text, df.columns)) if text else df


def search_tree(df: DataFrame, request: dict) -> tuple[DataFrame, dict]:
    """``{search, sort_by, sort_direction, pagination}``: a tree of any depth, sorted (by the first column if the wanted one is unknown) and paged."""
    q = Query(P.apply_tree(df, request.get("search"))).order_by_known(request.get("sort_by", ""), request.get("sort_direction", "asc"), df.columns[0])
    page = request.get("pagination") or {}
    return q.paginate(page.get("page", 1), page.get("page_size", 20), cap=None)


def repository_search(df: DataFrame, term: str, fields: list[str]) -> DataFrame:
    return df.where(P.any_column_like(df, term, fields)) if term else df


def advanced_search(df: DataFrame, filters: dict[str, Any] | None = None, text: str = "", fields: list[str] | None = None, sort_by: str | None = None, direction: str = "asc") -> DataFrame:
    """Exact filters (a list: IN, None: IS NULL), then text in any field, then sorting."""
    out = P.apply_tree(df, [{"field": c, "operator": "in" if isinstance(v, list) else "=", "value": None if isinstance(v, list) else v, "values": v if isinstance(v, list) else None} for c, v in (filters or {}).items()])
    out = repository_search(out, text, fields or P.string_fields(df))
    return out.orderBy(ordered(sort_by, direction)) if sort_by and P.resolve(df, sort_by) else out


def field_search(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """All fields contain their values."""
    return P.apply_tree(df, [{"field": c, "operator": "contains", "value": v} for c, v in filters.items()])


def selection_tree(selections: dict[str, list]) -> dict:
    """Selections of a filter tree: a dotted path means that title and abstract contain each value, a plain name equality."""
    made: list[dict] = []
    for path, values in selections.items():
        values = values if isinstance(values, list) else [values]
        if "." in path:
            made += [{"field": f, "operator": "contains", "value": v} for v in values for f in ("title", "abstract")]
        else:
            made.append({"field": path, "operator": "in", "values": values})
    return {"logic": "AND", "conditions": made}


def invalid_selections(selections: dict[str, list], paths: set[str]) -> list[str]:
    return [p for p in selections if p not in paths]


def selection_columns(selections: list[str], tags: DataFrame) -> DataFrame:
    """selection, column for free-text selections, by display name or synonym without regard to case; the first tag column wins. ``tags`` has column, display, synonyms (array)."""
    spark = tags.sparkSession
    asked = spark.createDataFrame([(i, s) for i, s in enumerate(selections)], "i int, selection string")
    names = tags.select("column", F.explode_outer(F.transform(F.concat(F.array("display"), F.coalesce("synonyms", F.array().cast("array<string>"))), lambda s: F.lower(F.trim(s)))).alias("name"))
    hits = asked.join(names, F.lower(F.trim("selection")) == F.col("name"))
    return hits.groupBy("i", "selection").agg(F.min("column").alias("c")).select("selection", F.col("c").alias("column"))


def by_members(df: DataFrame, wanted: dict[str, list[str]], skip: tuple[str, ...] = ("intervention", "topic", "outcome")) -> DataFrame:
    """Rows whose comma lists have any of the values, for all columns; an unknown column is an error."""
    for c, values in wanted.items():
        if c.lower() in skip or not values:
            continue
        if c not in df.columns:
            raise KeyError(c)
        df = df.where(P.comma_members(F.col(c), values))
    return df


def year_range(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """By `year`, if there is such a column and a bound."""
    if "year" not in df.columns:
        return df
    year = F.col("year").try_cast("int")
    return df.where(P.all_of([c for c in (year >= low if low else None, year <= high if high else None) if c is not None] or [F.lit(True)]))


def with_topics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which each of the tag columns is filled."""
    made = P.all_of([F.col(f"`{c}`").isNotNull() for c in columns if c in df.columns])
    return df if made is None else df.where(made)


def valid_value(df: DataFrame, field: str, value: Any) -> bool:
    """Whether a value can stand in a filter on a field: known field, nullable for None, parseable for numbers and booleans."""
    found = next((f for f in df.schema if f.name == field), None)
    if found is None:
        return False
    if value is None:
        return found.nullable
    kind = found.dataType.typeName()
    if kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal"):
        return re.fullmatch(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?", str(value).strip()) is not None
    return kind != "boolean" or str(value).lower() in ("true", "false", "1", "0", "yes", "no")


def aggregates(specs: list[dict]) -> list:
    return [aggregate(s["func"], s["column"], s["alias"]) for s in specs]
