"""An immutable query builder over a DataFrame.

Filters are joined by AND. ``or_where`` filters form a group of their own: the rows that pass are those of AND(filters) AND
OR(or filters) (``mode="split"``), or, with ``mode="either"``, of AND(filters) OR OR(or filters). Every method returns a
new query; terminal methods give DataFrames, or plain values where they must act. Ascending order puts nulls last,
descending order first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import predicates as P

AGGREGATES = {"count", "sum", "avg", "min", "max", "count_distinct", "stddev", "variance", "median", "mode", "first", "last", "bool_and", "bool_or"}
MAX_PAGE = 100


class NotFound(LookupError):
    """No row where one was demanded."""


def aggregate(func: str, column: str, alias: str) -> Column:
    """A named aggregate; ``*`` counts rows. Functions are from a fixed list, for names come from outside."""
    name = func.lower()
    if name not in AGGREGATES:
        raise ValueError(f"no aggregate: {func}")
    if name == "count":
        return F.count(F.lit(1) if column == "*" else F.col(column)).alias(alias)
    return getattr(F, name)(F.col(column)).alias(alias)


def ordered(column: str | Column, direction: str = "asc") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.desc_nulls_first() if direction.lower() == "desc" else c.asc_nulls_last()


def pages(total: int, page: int, per_page: int) -> dict[str, Any]:
    count = math.ceil(total / per_page) if per_page else 0
    return {"total": total, "page": page, "per_page": per_page, "pages": count, "has_prev": page > 1, "has_next": page < count, "prev": page - 1 if page > 1 else None, "next": page + 1 if page < count else None}


@dataclass(frozen=True)
class Query:
    source: DataFrame
    filters: tuple[Column, ...] = ()
    or_filters: tuple[Column, ...] = ()
    columns: tuple[str, ...] = ()
    distinct_on: tuple[str, ...] | None = None
    groups: tuple[str, ...] = ()
    aggregates: tuple[Column, ...] = ()
    havings: tuple[Column, ...] = ()
    orders: tuple[Column, ...] = ()
    order_names: tuple[tuple[str, str], ...] = ()
    limit_to: int | None = None
    skip_to: int | None = None
    mode: str = "split"

    # filters
    def _column(self, name: str) -> Column:
        found = P.resolve(self.source, name)
        if found is None:
            raise AttributeError(f"no column: {name}")
        return F.col(f"`{found}`")

    def _condition(self, field: Any, *rest: Any) -> Column:
        if isinstance(field, Column):
            return field
        if callable(field):
            return field(self.source)
        op, value = rest if len(rest) == 2 else ("=", rest[0])
        made = P.compare(self._column(field), op, value)
        if made is None:
            raise ValueError(f"no operator: {op}")
        return made

    def _and(self, *made: Column | None) -> Query:
        return replace(self, filters=(*self.filters, *(m for m in made if m is not None)))

    def where(self, field: Any, *rest: Any) -> Query:
        """``where(column, value)``, ``where(column, operator, value)``, ``where(condition)`` or ``where(function of the DataFrame)``."""
        return self._and(self._condition(field, *rest))

    def or_where(self, field: Any, *rest: Any) -> Query:
        return replace(self, or_filters=(*self.or_filters, self._condition(field, *rest)))

    def where_in(self, name: str, values: Iterable) -> Query:
        return self._and(P.is_in(self._column(name), list(values)))

    def where_not_in(self, name: str, values: Iterable) -> Query:
        return self._and(P.is_in(self._column(name), list(values), negate=True))

    def where_null(self, name: str) -> Query:
        return self._and(self._column(name).isNull())

    def where_not_null(self, name: str) -> Query:
        return self._and(self._column(name).isNotNull())

    def where_between(self, name: str, low: Any, high: Any) -> Query:
        return self._and(self._column(name).between(low, high))

    def where_not_between(self, name: str, low: Any, high: Any) -> Query:
        return self._and(~self._column(name).between(low, high))

    def where_like(self, name: str, value: str, case: bool = False) -> Query:
        return self._and(P.pattern(self._column(name), value, "", "", case))

    def where_starts_with(self, name: str, value: str, case: bool = True) -> Query:
        return self._and(P.pattern(self._column(name), value, "", "%", case))

    def where_ends_with(self, name: str, value: str, case: bool = True) -> Query:
        return self._and(P.pattern(self._column(name), value, "%", "", case))

    def where_contains(self, name: str, value: str, case: bool = True) -> Query:
        return self._and(P.pattern(self._column(name), value, case=case))

    def where_date(self, name: str, op: str, value: str) -> Query:
        return self._and(P.clause(self.source, name, f"date {op}", value))

    def where_year(self, name: str, op: str, value: int) -> Query:
        return self._and(P.clause(self.source, name, f"year {op}", value))

    def where_month(self, name: str, op: str, value: int) -> Query:
        return self._and(P.clause(self.source, name, f"month {op}", value))

    def where_any_like(self, name: str, values: Iterable[str]) -> Query:
        """Any of the values in one column."""
        return self._and(P.any_of([P.pattern(self._column(name), v) for v in values]))

    def where_columns_like(self, names: Iterable[str], value: str) -> Query:
        """A value in any of the columns, all of which must be there."""
        return self._and(P.any_of([P.pattern(self._column(n).cast("string"), value) for n in names]))

    def where_tree(self, tree: dict | list | None) -> Query:
        return self._and(P.compile_tree(self.source, tree))

    def _nested(self, build: Callable[[Query], Query]) -> Column | None:
        return build(Query(self.source, mode=self.mode)).predicate()

    def where_nested(self, build: Callable[[Query], Query]) -> Query:
        return self._and(self._nested(build))

    def or_where_nested(self, build: Callable[[Query], Query]) -> Query:
        made = self._nested(build)
        return self if made is None else replace(self, or_filters=(*self.or_filters, made))

    def predicate(self) -> Column | None:
        both = [c for c in (P.all_of(list(self.filters)), P.any_of(list(self.or_filters))) if c is not None]
        return (P.any_of if self.mode == "either" else P.all_of)(both)

    # shape
    def select(self, *names: str) -> Query:
        """Columns by name; an unknown one is an error."""
        for n in names:
            self._column(n)
        return replace(self, columns=(*self.columns, *names))

    def select_valid(self, *names: str, any_case: bool = False) -> Query:
        """The known ones of the columns; an error if there is none."""
        known = [n for n in ((P.resolve(self.source, n) if any_case else n) for n in names) if n in self.source.columns]
        if not known:
            raise ValueError("no valid column")
        return replace(self, columns=(*self.columns, *known))

    def distinct(self, *names: str) -> Query:
        return replace(self, distinct_on=names)

    def group_by(self, *names: str) -> Query:
        return replace(self, groups=(*self.groups, *names))

    def aggregate(self, func: str, column: str, alias: str) -> Query:
        return replace(self, aggregates=(*self.aggregates, aggregate(func, column, alias)))

    def having(self, condition: Column | str) -> Query:
        return replace(self, havings=(*self.havings, F.expr(condition) if isinstance(condition, str) else condition))

    def order_by(self, column: str | Column, direction: str = "asc") -> Query:
        names = (*self.order_names, (column, direction)) if isinstance(column, str) else self.order_names
        return replace(self, orders=(*self.orders, ordered(column, direction)), order_names=names)

    def order_by_desc(self, column: str) -> Query:
        return self.order_by(column, "desc")

    def order_by_known(self, column: str, direction: str, fallback: str) -> Query:
        """By a column if it is there, else by the fallback."""
        return self.order_by(P.resolve(self.source, column) or fallback, direction)

    def latest(self, column: str = "created_at") -> Query:
        return self.order_by_desc(column)

    def oldest(self, column: str = "created_at") -> Query:
        return self.order_by(column)

    def limit(self, n: int) -> Query:
        return replace(self, limit_to=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip_to=n)

    take, skip = limit, offset

    # results
    def rows(self) -> DataFrame:
        """Filter, distinct, select, group, having, order, offset and limit, in this order."""
        df, made = self.source, self.predicate()
        if made is not None:
            df = df.where(made)
        orders = self.orders
        if self.distinct_on is not None:
            names = self.distinct_on or self.columns or tuple(df.columns)
            df = df.select(*names).distinct()
            # distinct rows have no other columns to be sorted by
            orders = tuple(ordered(c if c in names else names[0], d) for c, d in self.order_names)
        elif self.groups or self.aggregates:
            df = df.groupBy(*self.groups).agg(*self.aggregates) if self.aggregates else df.select(*self.groups).distinct()
            for h in self.havings:
                df = df.where(h)
        if orders:
            df = df.orderBy(*orders)
        if self.columns and self.distinct_on is None and not (self.groups or self.aggregates):
            df = df.select(*self.columns)
        if self.skip_to:
            df = df.offset(self.skip_to)
        return df if self.limit_to is None else df.limit(self.limit_to)

    def counted(self) -> DataFrame:
        return self.rows().agg(F.count(F.lit(1)).alias("n"))

    def count(self) -> int:
        return self.rows().count()

    def exists(self) -> bool:
        return not self.rows().isEmpty()

    def doesnt_exist(self) -> bool:
        return not self.exists()

    def total(self, column: str) -> DataFrame:
        return self.rows().agg(F.coalesce(F.sum(column), F.lit(0)).alias("sum"))

    def average(self, column: str) -> DataFrame:
        return self.rows().agg(F.coalesce(F.avg(column), F.lit(0)).alias("avg"))

    def extremes(self, column: str) -> DataFrame:
        return self.rows().agg(F.min(column).alias("min"), F.max(column).alias("max"))

    def pluck(self, column: str) -> DataFrame:
        return self.rows().select(column)

    def first(self) -> Row | None:
        return next(iter(self.limit(1).rows().collect()), None)

    def first_or_fail(self) -> Row:
        if (found := self.first()) is None:
            raise NotFound("no row")
        return found

    def value(self, column: str) -> Any:
        found = self.first()
        return None if found is None else found[column]

    def find(self, key: Any, column: str) -> Row | None:
        return self.where(column, key).first()

    def find_or_fail(self, key: Any, column: str) -> Row:
        return self.where(column, key).first_or_fail()

    def paginate(self, page: int = 1, per_page: int = 20, cap: int | None = MAX_PAGE) -> tuple[DataFrame, dict[str, Any]]:
        """The rows of a page and what there is to page through; groups are counted as rows. A page beyond the end has no rows and the true totals."""
        per_page, page = min(per_page, cap) if cap else per_page, max(page, 1)
        whole = replace(self, limit_to=None, skip_to=None).rows()
        return whole.offset((page - 1) * per_page).limit(per_page), pages(whole.count(), page, per_page)

    def chunk(self, size: int, handle: Callable[[list[Row]], Any]) -> int:
        """Calls ``handle`` with lists of up to ``size`` rows, partition by partition, until it returns False; the number of rows handled."""
        batch, n = [], 0
        for row in self.rows().toLocalIterator():
            batch.append(row)
            if len(batch) == size:
                n += size
                if handle(batch) is False:
                    return n
                batch = []
        if batch:
            handle(batch)
        return n + len(batch)

    def explain(self) -> str:
        return self.rows()._jdf.queryExecution().toString()
