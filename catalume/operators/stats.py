"""Statistics of tables and the dashboard's roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows_n() -> Column:
    return F.count(F.lit(1)).alias("n")


def filled(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, sum, avg, min, max of each numeric column, in one pass."""
    columns = columns or numeric_columns(df)
    one = df.agg(*(F.struct(F.sum(c).cast("double").alias("sum"), F.avg(c).cast("double").alias("avg"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "s").select("column", "s.*")


def column_stats(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """column, non_null, nulls, distinct_values, min, max (of numbers) of each column; ``exact=False`` estimates the distinct values, for large tables."""
    columns, numbers = columns or df.columns, set(numeric_columns(df))
    many = F.count_distinct if exact else F.approx_count_distinct
    stat = lambda c: F.struct(
        F.count(c).alias("non_null"), F.count_if(F.col(c).isNull()).alias("nulls"), many(F.col(c)).alias("distinct_values"),
        (F.min(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("min"), (F.max(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("max"),
    ).alias(c)
    return df.agg(*map(stat, columns)).unpivot([], columns, "column", "s").select("column", "s.*")


def describe(df: DataFrame) -> DataFrame:
    """column, count, unique, top (the most frequent value, the smallest of equals) and freq of each column: one unpivot, two shuffles."""
    counts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)).unpivot([], df.columns, "column", "value").where("value IS NOT NULL").groupBy("column", "value").agg(rows_n())
    best = F.min(F.struct((-F.col("n")).alias("k"), "value", "n"))
    return counts.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("b")).select("column", "count", "unique", F.col("b.value").alias("top"), F.col("b.n").alias("freq"))


def year_source_counts(df: DataFrame) -> DataFrame:
    return df.where("year IS NOT NULL AND source IS NOT NULL").groupBy("year", "source").agg(rows_n()).orderBy("year", "source")


def country_counts(df: DataFrame) -> DataFrame:
    return filled(df, "country").groupBy("country").agg(rows_n()).orderBy(F.desc("n"), "country")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent filled values; of equals the smaller first."""
    return filled(df, column).groupBy(column).agg(rows_n()).orderBy(F.desc("n"), column).limit(k)


def summary(df: DataFrame) -> dict[str, DataFrame | None]:
    """The dashboard's tables; None for those whose columns are missing."""
    has = lambda *cs: set(cs) <= set(df.columns)
    return {
        "year_source": year_source_counts(df) if has("year", "source") else None,
        "country": country_counts(df) if has("country") else None,
        "journal": top_values(df, "journal", 3) if has("journal") else None,
        "source": top_values(df, "source", 4) if has("source") else None,
        "database": top_values(df.where("source = 'OVID'"), "database", 4) if has("source", "database") else None,
    }


def roll_up(df: DataFrame, sections: dict[str, tuple[str, ...]]) -> DataFrame:
    """section, key, n in long form: counts by each section's columns (null groups kept), all by one grouping-sets aggregation."""
    columns = list(dict.fromkeys(c for cs in sections.values() for c in cs))
    df = df.select(*columns)
    sets = [[F.col(c) for c in cs] for cs in sections.values()]
    rows = df.groupingSets(sets, *columns).agg(rows_n(), F.grouping_id().alias("g"))
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    section, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, cs in sections.items():
        here = F.col("g") == sum(b for c, b in bit.items() if c not in cs)
        section = F.when(here, name).otherwise(section)
        key = F.when(here, F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs))).otherwise(key)
    return rows.select(section.alias("section"), key.alias("key"), "n")


def dashboard(df: DataFrame, journals: int = 3, sources: int = 4, most: int = 10_000) -> DataFrame:
    """One row of JSON texts: year_source (null groups kept), country, journal (empty names kept), source, database; `[]` for a missing column.

    All counts come from one pass over the rows. year_source and country list up to ``most`` groups, the first in order,
    which bounds the row; counts of more groups are `roll_up`'s.
    """
    parts = {"year_source": ("year", "source"), "country": ("country",), "journal": ("journal",), "source": ("source",), "database": ("database",)}
    limits = {"journal": journals, "source": sources, "database": sources}
    there = {k: cs for k, cs in parts.items() if set(cs) <= set(df.columns)}
    columns = list(dict.fromkeys(c for cs in there.values() for c in cs))
    out = df.sparkSession.range(1).select()
    if there:
        counts = df.select(*columns).groupingSets([[F.col(c) for c in cs] for cs in there.values()], *columns).agg(rows_n(), F.grouping_id().alias("g"))
        bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
        section = F.lit(None).cast("string")
        for name, cs in there.items():
            section = F.when(F.col("g") == sum(b for c, b in bit.items() if c not in cs), name).otherwise(section)
        counts = counts.withColumn("section", section)
        counts = counts.where(F.when(F.col("section") == "year_source", True).otherwise(F.coalesce(*(F.when(F.col("section") == k, F.col(cs[0]).isNotNull()) for k, cs in there.items()))))
        by_count = F.when(F.col("section") != "year_source", -F.col("n"))
        place = F.row_number().over(Window.partitionBy("section").orderBy(by_count, *columns))
        limit = F.coalesce(*(F.when(F.col("section") == k, F.lit(v)) for k, v in limits.items() if k in there), F.lit(most))
        counts = counts.withColumn("place", place).where(F.col("place") <= limit)
        row = lambda cs: F.struct("place", F.struct(*cs, "n").alias("x"))
        listed = {k: F.to_json(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == k, row(cs)))), lambda r: r["x"])).alias(k) for k, cs in there.items()}
        out = counts.agg(*listed.values())
    return out.select(*(F.col(k) if k in there else F.lit("[]").alias(k) for k in parts))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(rows_n()).where("n > 1").orderBy(F.desc("n"), key)


def duplicates_by(df: DataFrame, group: str, key: str) -> DataFrame:
    """The group and the number of rows of it whose key, not null, more rows of the table have; groups without any are left out. Keys are counted first, by group, so that no task holds all rows of one."""
    parts = df.where(F.col(key).isNotNull()).groupBy(key, group).agg(rows_n())
    many = parts.groupBy(key).agg(F.sum("n").alias("__all")).where("__all > 1").select(key)
    return parts.join(many, key, "left_semi").groupBy(group).agg(F.sum("n").alias("n"))


def filled_by(df: DataFrame, group: str) -> DataFrame:
    """The group and the non-null counts of all other columns."""
    return df.groupBy(group).agg(*(F.count(c).alias(c) for c in df.columns if c != group))


def year_span(df: DataFrame, low: int = 2000, high: int = 2025) -> DataFrame:
    year = F.col("year").try_cast("int") if "year" in df.columns else F.lit(None).cast("int")
    return df.agg(F.coalesce(F.min(year), F.lit(low)).alias("min_year"), F.coalesce(F.max(year), F.lit(high)).alias("max_year"))


def busiest_year(df: DataFrame) -> DataFrame:
    return df.where("year IS NOT NULL").groupBy("year").agg(rows_n()).agg(F.max("n").alias("n"))
