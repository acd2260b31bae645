"""Records, sections and tables in web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_text

#: What hides tags, and the rest of a tag after its name. What is not finished goes to the text's end, so that no character is looked at over and over.
HIDDEN = r"<!--.*?(?:-->|\Z)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z)"
REST = r"""(?=[\s/>])(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+(>|\Z)"""
#: An attribute: name, value in double quotes, in single ones, without.
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


def attributes(tag: str) -> dict[str, str]:
    """The attributes of an opening tag by lower-case names; of equal ones the first."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(re.sub(r"^<[^\s/>]+", "", tag)):
        out.setdefault(name.lower(), "".join(values))
    return out


def elements(page: str | None, names: str) -> list[tuple[int, int, str]]:
    """inner_start, inner_end, tag (the opening one) of all elements of ``names`` (a tag's name, or several as alternatives of a pattern), nested ones too, by their start.

    A stack holds the elements that are open: a closing tag ends the one that was opened last, so that an element reaches
    past those within it. A closing tag without an open element counts for nothing, an element that is not closed ends with
    the text; tags in comments, scripts and styles and a tag that is cut off are none. One pass, in time by the page's length; a null page has none.
    """
    found, open_ones = [], []
    for m in re.finditer(rf"(?is){HIDDEN}|<(/?)(?:{names}){REST}", page or ""):
        if not m[2]:
            continue
        if not m[1]:
            open_ones.append(len(found))
            found.append([m.end(), len(page), m[0]])
        elif open_ones:
            found[open_ones.pop()][1] = m.start()
    return [tuple(e) for e in found]


def selected(page: str | None, step: str) -> list[tuple[str, str]]:
    """What stands within each element of a step ``tag`` or ``tag.class``, and its opening tag."""
    name, _, css_class = step.partition(".")
    return [(page[a:b], tag) for a, b, tag in elements(page, name) if not css_class or css_class in attributes(tag).get("class", "").split()]


def first_match(page: str, path: str) -> str | None:
    """What stands in the first element on a path of steps (``h3.title a``), or an attribute of it (``h3.title a@href``)."""
    path, _, wanted = path.partition("@")
    *above, last = path.split()
    within = [page]
    for step in above:
        within = [inner for text in within for inner, _ in selected(text, step)]
    for text in within:
        for inner, tag in selected(text, last):
            return attributes(tag).get(wanted.lower()) if wanted else inner
    return None


def over_pages(html: Column, kind: str, of) -> Column:
    """``of`` a page for each page, as Spark's type ``kind``."""

    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield pd.Series([of(p) for p in s], dtype="object")

    run.__annotations__ = {"pages": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)(html)


def headings(html: Column) -> Column:
    """Structs level, title, body for each h1 to h4: the text up to the next heading."""
    parts = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-4][^>]*>.*?</h[1-4]>.*?(?=<h[1-4][\s>]|$)"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(?i)^<h([1-4])", 1).try_cast("int").alias("level"), html_text(F.regexp_extract(p, r"(?is)^<h[1-4][^>]*>(.*?)</h[1-4]>", 1)).alias("title"), html_text(F.regexp_replace(p, r"(?is)^<h[1-4][^>]*>.*?</h[1-4]>", "")).alias("body")))


def tables(html: Column) -> Column:
    """Tables as texts: a line a row, tabs between cells. A table within a cell is a table of its own too; in the outer one its text is part of the cell, and its cells and rows follow those that hold it. Null and empty pages give an empty array."""
    cut = lambda page: [[[cell for cell, _ in selected(row, "t[hd]")] for row, _ in selected(table, "tr")] for table, _ in selected(page, "table")]
    row = lambda r: F.array_join(F.transform(r, html_text), "\t")
    return F.transform(over_pages(html, "array<array<array<string>>>", cut), lambda t: F.array_join(F.transform(t, row), "\n"))


def numbered_tables(html: Column) -> Column:
    """The tables with rows in one text, each under a line with its number among all tables; an empty text if there are none."""
    named = F.transform(tables(html), lambda t, i: F.when(t != "", F.concat(F.lit("===== Table "), (i + 1).cast("string"), F.lit(" =====\n"), t)))
    return F.array_join(named, "\n\n")


def title(html: Column) -> Column:
    return F.nullif(html_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def records(pages: DataFrame, item: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """A row for each match of ``item`` (a pattern of one result's block) with the first group of each field's pattern, tags removed; null where there is none."""
    keys = [c for c in pages.columns if c != html]
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(item), F.lit(0))).alias("item_no", "__block"))
    return rows.select(*keys, "item_no", *(F.nullif(html_text(F.regexp_extract("__block", p, 1)), F.lit("")).alias(k) for k, p in fields.items()))


def select_records(pages: DataFrame, item: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """A row for each element ``item`` (``tag`` or ``tag.class``) with item_no (from 0) and the fields; other columns but ``html`` stay, unless a field or item_no has their name.

    A field is the text of the first element on a path of such steps (``h3.title a``: an `a` within an `h3` of class `title`)
    within the item, or an attribute of it (``h3.title a@href``); null if there is none or it is empty. A page is read once.
    """
    paths = list(fields.values())
    items = over_pages(F.col(f"`{html}`"), "array<array<string>>", lambda page: [[first_match(block, p) for p in paths] for block, _ in selected(page, item)])
    keys = [f"`{c}`" for c in pages.columns if c not in (html, "item_no", *fields)]
    rows = pages.select(*keys, F.posexplode(items).alias("item_no", "__found"))
    value = lambda i, p: F.get("__found", F.lit(i)) if "@" in p else html_text(F.get("__found", F.lit(i)))
    return rows.select(*keys, "item_no", *(F.nullif(value(i, p), F.lit("")).alias(k) for i, (k, p) in enumerate(fields.items())))


def site_rules(url: Column, rules: dict[str, str], default: str = "universal") -> Column:
    """The name of the extraction rules for a page's host."""
    out = F.lit(default)
    for part, name in reversed(rules.items()):
        out = F.when(F.lower(url).contains(part), name).otherwise(out)
    return out
