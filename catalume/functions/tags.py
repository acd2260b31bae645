"""Tag cells: `phrase:code` lists in columns named category, subgroup and term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "__hash__"
NONE = "array<string>"


def cell_codes(c: Column) -> Column:
    """Codes of a cell, split at commas and semicolons: what follows the last colon; written-out flags give the keys that are true. Each once, in order."""
    listed = F.transform(F.split(c, "[,;]"), lambda x: F.trim(F.element_at(F.split(x, ":"), -1)))
    flags = F.regexp_extract_all(c, F.lit(r"""['"]([^'"]+)['"]\s*:\s*[Tt]rue"""), F.lit(1))
    codes = F.when(F.trim(c).startswith("{"), flags).otherwise(listed)
    return F.coalesce(F.array_distinct(F.filter(codes, lambda x: x != "")), F.array().cast(NONE))


def facet_codes(c: Column, longest: int = 10) -> Column:
    """Codes that can be facets: at most ``longest`` characters and not figures or underscores alone."""
    return F.filter(cell_codes(c), lambda x: (F.length(x) <= longest) & ~x.rlike("^[0-9_]+$"))


def roll_up(columns: list[str]) -> Column:
    """The codes of several tag columns: distinct, sorted, comma-joined; null if there is none."""
    every = F.flatten(F.array(*(cell_codes(F.col(f"`{c}`")) for c in columns))) if columns else F.array().cast(NONE)
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(every)), ", "), F.lit(""))


#: Which tag columns go into which notes column; the first group that has a column takes it.
NOTES = {"research_notes": (f"topic{PART}vpd", f"topic{PART}coverage"), "topic_notes": (f"topic{PART}",), "notes": (f"outcome{PART}",)}


def note_columns(names: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {k: [] for k in NOTES}
    for n in names:
        if PART in n and (group := next((k for k, starts in NOTES.items() if n.lower().startswith(starts)), None)):
            out[group].append(n)
    return out


def add_notes(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in NOTES), *(roll_up(cs).alias(k) for k, cs in note_columns(df.columns).items()))


def notes_as_arrays(df: DataFrame, names: tuple[str, ...] = tuple(NOTES)) -> DataFrame:
    """Comma lists of the notes columns as arrays of trimmed, non-empty items."""
    split = lambda c: F.coalesce(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast(NONE))
    return df.withColumns({c: split(F.col(c)) for c in names if c in df.columns})


def wide_to_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, phrase, code: a row for each entry of each tag cell."""
    rows = df.unpivot(key, columns, "column", "cell").where("cell IS NOT NULL")
    rows = rows.select(key, "column", F.explode(F.split("cell", "[,;]")).alias("entry"))
    entry = F.trim("entry")
    return rows.select(key, "column", F.trim(F.regexp_replace(entry, ":[^:]*$", "")).alias("phrase"), F.trim(F.element_at(F.split(entry, ":"), -1)).alias("code")).where("code <> ''")


def long_to_wide(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A column of sorted `phrase:code` lists for each of the given tag columns; null where a key has no entry."""
    cell = F.when(F.count(F.lit(1)) > 0, F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "phrase", "code"))), ", "))
    return df.groupBy(key).pivot("column", columns).agg(cell)


def tag_tree(names: list[str]) -> list[tuple[str, str, str, str]]:
    """category, subgroup, term, column for the columns that have all three parts."""
    return [(*n.split(PART)[:3], n) for n in names if len(n.split(PART)) == 3]


def matching_column(name: str, names: list[str], limit: int = 63) -> str | None:
    """The column of a tag name that a store may have cut: exact first, then the only one that shares the cut beginning."""
    if name in names:
        return name
    found = [n for n in names if n == name[:limit] or (len(n) >= limit and name.startswith(n)) or n.startswith(name)]
    return found[0] if len(found) == 1 else None
