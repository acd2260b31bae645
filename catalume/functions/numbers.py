"""Numbers in figures and words, years and types of cells."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen").split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
VALUES = {w: i for i, w in enumerate(UNITS)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
SCALES = {"hundred": 100, "thousand": 1000, "million": 1_000_000}


def _map(d: dict[str, int]) -> Column:
    return F.create_map(*map(F.lit, chain(*d.items())))


def comma_int(c: Column) -> Column:
    """The first whole number, with or without commas."""
    return F.regexp_replace(F.regexp_extract(c, r"\d[\d,]*", 0), ",", "").try_cast("long")


def words_to_int(c: Column) -> Column:
    """A number in words: units and tens add up, `hundred` multiplies, `thousand` and `million` close a group; a scale alone counts once. Null if a word is none of these."""
    words = F.filter(F.split(F.lower(c), r"[\s-]+"), lambda w: (w != "") & (w != "and"))
    values, scales = _map(VALUES), _map(SCALES)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"), F.lit(True).alias("ok"))

    def step(a: Column, w: Column) -> Column:
        unit, scale = values[w].cast("long"), scales[w].cast("long")
        scaled = F.greatest(a["now"], F.lit(1).cast("long")) * scale
        return F.struct(
            F.when(scale >= 1000, a["total"] + scaled).otherwise(a["total"]).alias("total"),
            F.when(unit.isNotNull(), a["now"] + unit).when(scale == 100, scaled).when(scale >= 1000, F.lit(0).cast("long")).otherwise(a["now"]).alias("now"),
            (a["ok"] & (unit.isNotNull() | scale.isNotNull())).alias("ok"),
        )

    return F.when(F.size(words) > 0, F.aggregate(words, start, step, lambda a: F.when(a["ok"], a["total"] + a["now"])))


def to_int(c: Column) -> Column:
    """Figures first, then words."""
    return F.coalesce(comma_int(c), words_to_int(c))


def int_to_words(c: Column) -> Column:
    """English words of a whole number from 0 to 999,999,999; null for others."""
    units, tens = F.array(*map(F.lit, UNITS)), F.array(*map(F.lit, TENS))

    def below_hundred(n: Column) -> Column:
        n = n.cast("int")
        ten, one = (n / 10).cast("int"), n % 10
        return F.when(n < 20, F.get(units, n)).otherwise(F.concat_ws("-", F.get(tens, ten - 2), F.when(one > 0, F.get(units, one))))

    def below_thousand(n: Column) -> Column:
        hundred, rest = (n / 100).cast("int"), n % 100
        return F.concat_ws(" ", F.when(hundred > 0, F.concat(F.get(units, hundred), F.lit(" hundred"))), F.when((rest > 0) | (hundred == 0), below_hundred(rest)))

    million, thousand, rest = (c / 1_000_000).cast("int"), (c / 1000).cast("int") % 1000, (c % 1000).cast("int")
    scaled = lambda n, name: F.when(n > 0, F.concat(below_thousand(n), F.lit(f" {name}")))
    words = F.concat_ws(" ", scaled(million, "million"), scaled(thousand, "thousand"), F.when((rest > 0) | (c == 0), below_thousand(rest)))
    return F.when(c.between(0, 999_999_999), words)


def year_of(c: Column) -> Column:
    """The year of a cell: a number or a text that starts with four figures."""
    return F.coalesce(F.trim(c).try_cast("double").try_cast("int"), F.regexp_extract(F.trim(c), r"^(\d{4})", 1).try_cast("int"))


def from_year(c: Column, least: int = 2011) -> Column:
    """Whether a cell has a year of at least ``least``; false for blanks and other texts."""
    return F.coalesce(F.trim(c).try_cast("double").try_cast("int") >= least, F.lit(False))


def typed(c: Column, kind: T.DataType) -> Column:
    """A text cell as a value: blanks and what doesn't parse are null, `2012.0` is a whole number."""
    text = F.nullif(F.trim(c), F.lit(""))
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def quotient(c: Column, by: int) -> Column:
    return F.struct(F.floor(c / by).alias("quotient"), (c % by).alias("remainder"))
