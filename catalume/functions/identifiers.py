"""DOIs and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_doi(c: Column) -> Column:
    """Lower case without a resolver's address; null and blank give an empty text."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^(https?://)?(dx\.)?doi\.org/", ""))


def extract_doi(c: Column) -> Column:
    """The first DOI in a text, null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1), F.lit(""))


def doi_in_path(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"/doi/(10\.[^/]+/.+?)(?:\.pub\d+)?/full", 1), F.lit(""))


def doi_list(c: Column) -> Column:
    """DOIs of a list literal whose entries are marked `[doi]`; another text is its own only entry."""
    inner = F.transform(F.split(F.regexp_replace(c, r"^\[|\]$", ""), ","), lambda x: F.trim(F.regexp_replace(x, "['\"]", "")))
    marked = F.transform(F.filter(inner, lambda x: x.contains("[doi]")), lambda x: F.trim(F.replace(x, F.lit("[doi]"), F.lit(""))))
    return F.when(c.startswith("["), marked).when(F.trim(c) != "", F.array(F.trim(c))).otherwise(F.array().cast("array<string>"))


def doi_url(c: Column) -> Column:
    return F.when(c.startswith("http"), c).when(F.trim(c) != "", F.concat(F.lit("https://doi.org/"), F.trim(c)))


def host_label(c: Column) -> Column:
    """The second-level label of a URL's host."""
    return F.try_element_at(F.split(F.regexp_extract(c, r"^[a-zA-Z]+://([^/?#:]+)", 1), r"\."), F.lit(-2))


def is_url(c: Column) -> Column:
    return c.rlike(r"(?i)https?://")


def sciencedirect_url(c: Column) -> Column:
    """The article page of a linking-hub address; other addresses stay."""
    pii = F.regexp_extract(c, r"/pii/([A-Za-z0-9()-]+)", 1)
    return F.when(c.contains("linkinghub") & (pii != ""), F.concat(F.lit("https://www.sciencedirect.com/science/article/pii/"), pii)).otherwise(c)
