"""What a catalogue can be filtered by: options, trees and synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tags import PART, tag_tree
from ..functions.text import split_list, ultra_clean

#: Columns that are no filters.
EXCLUDED = {"id", "primary_id", "created_at", "updated_at", "deleted_at", "abstract", "title", "doi", "password"}


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return "datetime"
    return "boolean" if isinstance(kind, T.BooleanType) else "text"


def discover(df: DataFrame, excluded: set[str] | None = None) -> DataFrame:
    """column, family, display, low, high, distinct_values of each column that can be a filter: ranges of numbers and times, counts of values, in one pass."""
    names = [f.name for f in df.schema if f.name not in (EXCLUDED if excluded is None else excluded) and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    kinds = {f.name: family(f.dataType) for f in df.schema}
    low = lambda c, f: f(c).cast("string") if kinds[c] in ("numeric", "datetime") else F.lit(None).cast("string")
    one = df.agg(*(F.struct(F.lit(kinds[c]).alias("family"), F.initcap(F.lit(c.replace("_", " "))).alias("display"), low(c, F.min).alias("low"), low(c, F.max).alias("high"), F.count_distinct(F.col(c)).alias("distinct_values")).alias(c) for c in names))
    return one.unpivot([], names, "column", "s").select("column", "s.*")


def options(df: DataFrame, columns: list[str], extra: dict[str, list[str]] | None = None) -> DataFrame:
    """column, value: cleaned, split, distinct values of the columns and the extra ones that are always offered."""
    texts = df.select(*(F.col(c).cast("string").alias(c) for c in columns if c in df.columns))
    rows = texts.unpivot([], texts.columns, "column", "cell").where("cell IS NOT NULL")
    rows = rows.select("column", F.explode(F.transform(split_list(F.col("cell")), lambda x: ultra_clean(x, 2))).alias("value")).where("value <> ''")
    more = [(c, v) for c, vs in (extra or {}).items() for v in vs]
    if more:
        rows = rows.unionByName(df.sparkSession.createDataFrame(more, "column string, value string"))
    return rows.distinct()


def sorted_options(rows: DataFrame, numeric: tuple[str, ...] = ("year",)) -> DataFrame:
    """Options by column; years with the latest first, others by name."""
    year = F.when(F.lower("column").isin(*numeric), -F.col("value").try_cast("int"))
    return rows.orderBy("column", year.asc_nulls_last(), "value")


def tag_filters(df: DataFrame) -> DataFrame:
    """category, subgroup, term, column, synonyms for each tag column: the distinct `phrase:code` entries in its cells."""
    tree = tag_tree(df.columns)
    if not tree:
        return df.sparkSession.createDataFrame([], "category string, subgroup string, term string, column string, synonyms array<string>")
    names = df.sparkSession.createDataFrame(tree, "category string, subgroup string, term string, column string")
    cells = df.select(*(F.col(f"`{t[3]}`").cast("string").alias(t[3]) for t in tree)).unpivot([], [t[3] for t in tree], "column", "cell").where("cell IS NOT NULL")
    found = cells.select("column", F.explode(split_list(F.col("cell"), "[,;]")).alias("entry")).groupBy("column").agg(F.array_sort(F.collect_set("entry")).alias("synonyms"))
    return names.join(found, "column", "left").select("category", "subgroup", "term", "column", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))


def flatten_tree(tree: dict) -> list[tuple[str, str, str, str, str, list[str]]]:
    """Rows category, subgroup, code, column, display, synonyms of a nested filter tree."""
    return [(cat, sub, code, v.get("column", PART.join((cat, sub, code))), v.get("display", code), list(v.get("synonyms", []))) for cat, subs in tree.items() for sub, codes in subs.items() for code, v in codes.items()]


def tree_frame(spark, tree: dict) -> DataFrame:
    return spark.createDataFrame(flatten_tree(tree), "category string, subgroup string, code string, column string, display string, synonyms array<string>")


def search_tags(tags: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Tags whose display name or a synonym contains a text."""
    like = f"%{text}%"
    return tags.where(F.col("display").ilike(like) | F.exists("synonyms", lambda s: s.ilike(like))).orderBy("category", "subgroup", "code").limit(limit)


def expand_synonym(tags: DataFrame, synonym: str) -> DataFrame:
    """Where a synonym leads: category, subgroup, code, column."""
    return tags.where(F.exists("synonyms", lambda s: F.lower(F.element_at(F.split(s, ":"), 1)) == synonym.lower())).select("category", "subgroup", "code", "column")


def merge_trees(given: DataFrame, reference: DataFrame) -> DataFrame:
    """The given tags with the reference's that are missing, and the synonyms of both."""
    keys = ["category", "subgroup", "code"]
    other = reference.select(*keys, *(F.col(c).alias(f"__{c}") for c in ("column", "display", "synonyms")))
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("synonyms", none), F.coalesce("__synonyms", none)))
    return given.join(other, keys, "full").select(*keys, F.coalesce("column", "__column").alias("column"), F.coalesce("display", "__display").alias("display"), both.alias("synonyms"))
