"""New versions of tables: inserts, updates, deletes and upserts. Tables are files, so each gives the changed DataFrame; `swap` puts it in a table's place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import normalise_doi
from ..functions.numbers import from_year
from .numbering import with_places


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """With more rows; columns that either side lacks are null."""
    return df.unionByName(rows, allowMissingColumns=True)


def update_where(df: DataFrame, condition: Column, values: dict) -> DataFrame:
    """Rows that meet the condition (not those where it is unknown) with new values."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({c: F.when(condition, as_column(v)).otherwise(F.col(c)) for c, v in values.items()})


def update_by_key(df: DataFrame, key: str, value, values: dict) -> DataFrame:
    return update_where(df, F.col(key) == F.lit(value), values)


def increment(df: DataFrame, condition: Column, column: str, by=1) -> DataFrame:
    return update_where(df, condition, {column: F.col(column) + by})


def decrement(df: DataFrame, condition: Column, column: str, by=1) -> DataFrame:
    return increment(df, condition, column, -by)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("__rank = 1").drop("__rank")


def update_from(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows that ``rows`` (unique by key) has, with its values of the shared columns, nulls too; its other columns and keys are ignored."""
    shared = [c for c in rows.columns if c in df.columns and c != key]
    new = rows.select(key, F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in shared))
    joined = df.join(new, key, "left")
    return joined.select(*(F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in df.columns))


def insert_absent(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """With those rows whose key is neither null nor there."""
    return insert(df, rows.where(F.col(key).isNotNull()).join(df.select(key), key, "left_anti"))


def merge(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Updated by key, and the new rows added."""
    return insert_absent(update_from(df, rows, key), rows, key)


def first_or_create(df: DataFrame, filters: dict, values: dict) -> DataFrame:
    """With a row of filters and values if no row meets the filters."""
    met = df
    for c, v in filters.items():
        met = met.where(F.col(c).eqNullSafe(F.lit(v)))
    row = df.sparkSession.range(1).select(*(F.lit((filters | values).get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns))
    return insert(df, row.join(met.limit(1).select(F.lit(1).alias("__there")), F.lit(True), "left_anti"))


def update_or_create(df: DataFrame, filters: dict, values: dict) -> DataFrame:
    condition = F.lit(True)
    for c, v in filters.items():
        condition = condition & F.col(c).eqNullSafe(F.lit(v))
    return first_or_create(update_where(df, condition, values), filters, values)


def put_values(df: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """A key/value table with later values in the place of earlier ones."""
    return merge(df, last_wins(rows, ["key"], order).select("key", "value"), "key")


def upsert_papers(df: DataFrame, rows: DataFrame, order: str, least_year: int = 2011) -> DataFrame:
    """Papers from ``least_year`` on that have a DOI, updated or added.

    A row is matched by verification_id, else by cleaned DOI, else by DOI; of several rows that match the same paper, or
    are new and share a DOI, the last by ``order`` counts. Only columns of ``df`` are taken; `primary_id` of new papers
    goes on from the largest one in the rows' order.
    """
    rows = rows.where(from_year(F.col("year").cast("string"), least_year) & (F.trim(F.coalesce("doi", F.lit(""))) != "")).withColumn("cleaned_doi", normalise_doi(F.col("doi")))
    key = lambda c, name: df.where(F.coalesce(F.trim(c), F.lit("")) != "").groupBy(F.col(c).alias(f"__{name}")).agg(F.min("primary_id").alias(f"__by_{name}"))
    met = rows
    for column, name in (("verification_id", "v"), ("cleaned_doi", "c"), ("doi", "d")):
        met = met.join(key(column, name), F.col(column) == F.col(f"__{name}"), "left")
    met = met.withColumn("primary_id", F.coalesce("__by_v", "__by_c", "__by_d")).drop("__v", "__c", "__d", "__by_v", "__by_c", "__by_d")
    known = last_wins(met.where("primary_id IS NOT NULL"), ["primary_id"], order)
    new = last_wins(met.where("primary_id IS NULL"), ["cleaned_doi"], order)
    top = df.agg(F.coalesce(F.max("primary_id"), F.lit(0)).alias("__top"))
    new = with_places(new.drop("primary_id"), order, name="__place").crossJoin(top).withColumn("primary_id", F.col("__top") + F.col("__place") + 1)
    keep = [c for c in df.columns if c in new.columns]
    return insert(update_from(df, known.select(*keep), "primary_id"), new.select(*keep))


def add_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def swap(df: DataFrame, path: str) -> str:
    """Writes a new version beside ``path`` and returns its path: readers go over to it once it is complete, a failed write leaves the old one."""
    out = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return out
