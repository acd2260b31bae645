"""Cleaning, splitting and reading texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_WORDS = ("", "none", "null", "nan", "n/a", "[]", "()")


def ultra_clean(c: Column, passes: int = 5) -> Column:
    """Strips brackets and quotes around a value, several times; words for nothing give an empty text."""
    out = F.trim(c)
    for _ in range(passes):
        out = F.trim(F.regexp_replace(out, r"""^\((.*?),?\)$|^\[(.*)\]$|^'(.*)'$|^"(.*)"$""", "$1$2$3$4"))
    return F.when(F.lower(out).isin(*NULL_WORDS), "").otherwise(out)


def split_list(c: Column, separator: str = ",") -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def literal_list(c: Column) -> Column:
    """The entries of `['a', 'b']`; another text is split at commas."""
    return split_list(F.regexp_replace(c, r"[\[\]'\"]", ""))


def set_flags(c: Column) -> Column:
    """The keys with a true value of a written-out dictionary."""
    return F.regexp_extract_all(c, F.lit(r"""['"]([^'"]+)['"]\s*:\s*[Tt]rue"""), F.lit(1))


def display_name(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def column_name(c: Column, limit: int = 63) -> Column:
    """Lower case with underscores; a name that is too long ends in a part of its MD5."""
    name = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    return F.when(F.length(name) > limit, F.concat(F.substring(name, 1, limit - 9), F.lit("_"), F.substring(F.md5(name), 1, 8))).otherwise(name)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_characters(c: Column) -> Column:
    """Plain dashes and quotes, no addresses, only letters, digits and common marks, single spaces."""
    out = F.translate(c, "–—‐−‘’“”", "----''\"\"")
    out = F.regexp_replace(F.regexp_replace(out, r"https?://\S+", " "), r"""[^\p{L}\p{N}\s.,;:!?()%'"/&+<>=-]""", " ")
    return squeeze(out)


def strip_heading_number(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^\s*\d+(\.\d+)*\.?\s+(?=\p{L})", "")


def sentences(c: Column, least: int = 1) -> Column:
    """Parts that end in `.`, `!` or `?` before white space, of ``least`` characters or more."""
    return F.filter(F.transform(F.split(c, r"(?<=[.?!])\s+"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def units(c: Column) -> Column:
    """Sentences and lines, each once, in order."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.concat(sentences(c), lines))


def context(c: Column, at: Column, length: Column, width: int = 50) -> Column:
    """The text around a match that starts at ``at`` (from 1)."""
    begin = F.greatest(at - width, F.lit(1))
    return F.substr(c, begin, at - begin + length + width)


def replace_items(c: Column, mapping: dict[str, str], separator: str = ",") -> Column:
    """Items of a list replaced by their short forms."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)) if mapping else F.create_map().cast("map<string,string>")
    return F.array_join(F.transform(split_list(c, separator), lambda x: F.coalesce(table[x], x)), ", ")


#: Parts of a Python literal: texts in single and in double quotes, words, all else. Possessive, so that a text of any length is matched in a loop.
LITERAL_PARTS = r"""(?s)'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[\p{L}_][\p{L}\p{N}_]*+|[^'"\p{L}_]++|['"]"""


def repair_json(c: Column) -> Column:
    """JSON from a Python literal: null for NaN and None, true and false, double quotes. Texts are told apart from what stands between them, so that apostrophes, quotes and such words within a text stay."""

    def part(x: Column) -> Column:
        inner = F.substr(x, F.lit(2), F.length(x) - 2)
        plain = F.replace(inner, F.lit("\\'"), F.lit("'"))
        single = F.concat(F.lit('"'), F.regexp_replace(plain, r'(?<!\\)((?:\\\\)*)"', '$1\\\\"'), F.lit('"'))
        double = F.concat(F.lit('"'), plain, F.lit('"'))
        first = F.left(x, F.lit(1))
        whole = F.length(x) > 1
        return F.when(whole & (first == "'"), single).when(whole & (first == '"'), double).when(x.isin("None", "NaN"), "null").when(x == "True", "true").when(x == "False", "false").otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(LITERAL_PARTS), F.lit(0)), part), "")


def literal_field(c: Column, key: str) -> Column:
    """The field ``key`` of each entry of a list literal, comma-joined."""
    parsed = F.from_json(repair_json(c), "array<map<string,string>>")
    return F.array_join(F.filter(F.transform(parsed, lambda m: m[key]), lambda x: x.isNotNull()), ", ")


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!^)([A-Z])", " $1")


def plain_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, r"(\w)-(\d)", "$1 $2")


def answer_normal(c: Column) -> Column:
    """Lower case, no articles, no marks but `%./=-`, single spaces. Letters and digits are those of any script."""
    word = r"\p{L}\p{N}_"
    out = F.regexp_replace(F.lower(c), rf"(?<![{word}])(a|an|the)(?![{word}])", " ")
    return squeeze(F.regexp_replace(out, rf"[^{word}\s%./=-]", " "))


def html_text(c: Column) -> Column:
    """A page's text without scripts, styles, head, footer and tags."""
    out = F.regexp_replace(c, r"(?is)<(script|style|head|noscript|footer)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return squeeze(out)


def normal_lines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n")


def prune(m: Column) -> Column:
    """A map without null values; zero and empty texts stay."""
    return F.map_filter(m, lambda k, v: v.isNotNull())
