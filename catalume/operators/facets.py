"""Facet counts in one pass over the filtered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import facet_codes

#: Facet categories by exact column and by the beginning of a tag column.
EXACT = {"country": "Country", "year": "Year", "amstar_label": "Amstar_Label"}
PREFIXES = {"topic": "Topics", "intervention": "Interventions", "vaccine_options": "Vaccine Options", "outcome": "Outcomes", "population": "Population"}


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """category, value, n for the non-null values of the columns: the rows are unpivoted once and counted in one shuffle."""
    texts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns if c in df.columns))
    return texts.unpivot([], texts.columns, "category", "value").where("value IS NOT NULL").groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"))


def category(column: str) -> str | None:
    return EXACT.get(column.lower()) or next((v for k, v in PREFIXES.items() if column.lower().startswith(k)), None)


def tag_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """category, value, n: plain columns by value, tag columns by the codes in their cells; empty texts are left out."""
    named = {c: category(c) or c for c in (columns or [c for c in df.columns if category(c)])}
    plain = [c for c in named if c.lower() in EXACT]
    texts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in named)).unpivot([], list(named), "column", "cell").where("cell IS NOT NULL AND cell <> ''")
    values = F.when(F.col("column").isin(plain), F.array("cell")).otherwise(facet_codes(F.col("cell"))) if plain else facet_codes(F.col("cell"))
    names = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
    return texts.select(names[F.col("column")].alias("category"), F.explode(values).alias("value")).groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"))
