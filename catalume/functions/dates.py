"""Dates in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
FORMATS = ("d MMMM yyyy", "MMMM d yyyy", "MMMM yyyy", "yyyy-MM-dd", "d/M/yyyy", "yyyy")


def parse_date(c: Column) -> Column:
    """A date in one of the usual forms (ordinal endings and commas are dropped), null else."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"(\d)(?:st|nd|rd|th)\b", "$1"), r",\s*", " "))
    return F.coalesce(*(F.to_date(F.try_to_timestamp(plain, F.lit(f))) for f in FORMATS))


def latest_of(candidates: Column) -> Column:
    """The entry, as written, with the latest date of an array; null if none parses."""
    dated = F.filter(F.transform(candidates, lambda x: F.struct(parse_date(x).alias("d"), x.alias("x"))), lambda s: s["d"].isNotNull())
    return F.array_max(dated)["x"]


def month_number(c: Column) -> Column:
    """1 to 12 by name or its first three letters; 1 for others."""
    short = F.substring(F.lower(F.trim(c)), 1, 3)
    out = F.lit(1)
    for i, m in enumerate(MONTHS):
        out = F.when(short == m[:3], i + 1).otherwise(out)
    return out


def reformat_date(c: Column, given: str = "yyyyMMdd", wanted: str = "yyyy-MM-dd") -> Column:
    """A date in another form; what doesn't parse stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit(given)), wanted), c)


def date_mentions(c: Column) -> Column:
    """All dates in a text, as written."""
    month = "(?:" + "|".join(m.capitalize() for m in MONTHS) + ")"
    return F.regexp_extract_all(c, F.lit(rf"(?i)\b(\d{{1,2}}(?:st|nd|rd|th)?\s+{month},?\s+\d{{4}}|{month}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|{month},?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})\b"), F.lit(1))


# A grammar of dates in running text. A point is a day, a month or, in ranges and after words such as `until`, a year.
_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\\.?"
_DAY, _YEAR = r"\d{1,2}(?:st|nd|rd|th)?", r"(?:19|20)\d\d"
_DATED = rf"(?:{_YEAR}-\d\d-\d\d|{_DAY}\s+{_MONTH},?\s+{_YEAR}|{_MONTH}\s+{_DAY},?\s+{_YEAR}|{_MONTH},?\s+{_YEAR})"
_POINT = rf"(?:{_DATED}|{_YEAR})"
_TO = r"(?:\s*[-–—]\s*|\s+(?:to|until|through)\s+)"
_BETWEEN, _AND = r"between\s+", r"\s+(?:and|to)\s+"
_OPEN = r"(?:inception\s+(?:up\s+)?(?:to|until|through)|up\s+(?:to|until)|until|through|before|prior\s+to)\s+"
_SEASON = rf"{_YEAR}[-–/]\d\d"
EXPRESSION = rf"(?i)\b(?:{_BETWEEN}(?:{_POINT}|{_MONTH}){_AND}{_POINT}|(?:{_POINT}|{_MONTH}){_TO}{_POINT}|{_OPEN}{_POINT}|{_DATED}|{_SEASON})(?![\w-])"
#: White space after a sentence, but not after a month's short form.
SENTENCE_END = r"(?i)(?<=[.?!])(?<!\b(?:jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\.)\s+"
#: Words by which a sentence speaks of a search for literature.
SEARCHES = r"(?i)\b(?:search(?:ed|es|ing)?|retriev(?:ed|al|als)|inception|updated?|published|publications?|databases?)\b"


def _point(c: Column, fallback_year: Column | None = None) -> Column:
    """A struct of the first and last day of a day, month or year; nulls if it is none."""
    lower = F.lower(c)
    found = F.regexp_extract(lower, _YEAR, 0)
    year = F.when(found != "", found) if fallback_year is None else F.when(found != "", found).otherwise(fallback_year)
    name = F.regexp_extract(lower, f"({'|'.join(m[:3] for m in MONTHS)})", 1)
    numeric = F.regexp_extract(lower, r"^\d{4}-(\d\d)-\d\d$", 1)
    month = F.when(numeric != "", numeric).when(name != "", F.lpad(month_number(name).cast("string"), 2, "0"))
    figures = F.regexp_extract(F.when(numeric != "", F.substr(lower, F.lit(9))).otherwise(F.regexp_replace(lower, _YEAR, "")), r"\d{1,2}", 0)
    day = F.when((figures != "") & month.isNotNull(), F.lpad(figures, 2, "0"))
    low = F.to_date(F.try_to_timestamp(F.concat_ws("-", year, F.coalesce(month, F.lit("01")), F.coalesce(day, F.lit("01"))), F.lit("yyyy-MM-dd")))
    high = F.when(day.isNotNull(), low).when(month.isNotNull(), F.last_day(low)).otherwise(F.to_date(F.try_to_timestamp(F.concat(year, F.lit("-12-31")), F.lit("yyyy-MM-dd"))))
    return F.struct(low.alias("low"), high.alias("high"))


def _interval(c: Column) -> Column:
    """A struct first, last, text of one date expression."""
    opened = c.rlike(f"(?i)^{_OPEN}")
    bare = F.regexp_replace(c, f"(?i)^(?:{_OPEN}|{_BETWEEN})", "")
    left = F.regexp_extract(bare, rf"(?i)^({_POINT}|{_MONTH})(?:{_TO}|{_AND}){_POINT}$", 1)
    right = F.regexp_extract(bare, rf"(?i)^(?:{_POINT}|{_MONTH})(?:{_TO}|{_AND})({_POINT})$", 1)
    season = F.regexp_extract(bare, rf"^({_YEAR})[-–/]\d\d$", 1)
    century = F.regexp_extract(bare, rf"^(\d\d)\d\d[-–/]\d\d$", 1)
    short = F.regexp_extract(bare, rf"^{_YEAR}[-–/](\d\d)$", 1)
    only, to = _point(bare), _point(right)
    since = _point(left, F.regexp_extract(right, _YEAR, 0))
    first = F.when(season != "", _point(season)["low"]).when(right != "", since["low"]).when(opened, F.lit(None)).otherwise(only["low"])
    last = F.when(season != "", _point(F.concat(century, short))["high"]).when(right != "", to["high"]).otherwise(only["high"])
    return F.struct(first.cast("date").alias("first"), last.alias("last"), c.alias("text"))


def date_intervals(text: Column) -> Column:
    """The dates and ranges of dates in a text, from left to right, as structs first, last (days) and text.

    A month stands for its days, a year in a range for its own; of `May to June 2020` the first month has the second's year;
    `2018-19` is a season of two years; `until May 2021` has no first day. Lone years are no dates. What no calendar has is
    left out, and so are ranges that end before they begin. A null text gives null.
    """
    every = F.transform(F.regexp_extract_all(text, F.lit(EXPRESSION), F.lit(0)), _interval)
    return F.filter(every, lambda x: x["last"].isNotNull() & (x["first"].isNull() | (x["first"] <= x["last"])))


def latest_interval(intervals: Column) -> Column:
    """The interval that ends last; of these the one that begins last, then the one whose text is the greatest. Null if there is none."""
    return F.array_max(F.transform(intervals, lambda x: F.struct(x["last"].alias("last"), x["first"].alias("first"), x["text"].alias("text"))))


def last_search(text: Column) -> Column:
    """The latest interval (struct last, first, text) in the sentences of a text that speak of a search."""
    told = F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(SEARCHES))
    return latest_interval(F.flatten(F.transform(told, date_intervals)))
