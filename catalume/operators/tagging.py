"""Sections, taxonomy terms and facts in full texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import inside, matches, once
from ..functions.numbers import to_int
from ..functions.tags import long_to_wide
from ..functions.text import sentences, squeeze

HEAD = r"(?m)^={3,}\s*(.+?)\s*={3,}\s*$"
NO_LIMIT = 1_000_000


def sections(text: Column) -> Column:
    """A map from lower-case section names to bodies, for texts with `===== Name =====` lines; of equal names the first counts."""
    names = F.transform(F.regexp_extract_all(text, F.lit(HEAD), F.lit(1)), lambda x: F.lower(F.trim(x)))
    bodies = F.transform(F.slice(F.split(text, HEAD, -1), 2, F.greatest(F.size(names), F.lit(1))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    pairs = F.arrays_zip(names.alias("name"), bodies.alias("body"))
    firsts = F.filter(pairs, lambda p, i: F.array_position(names, p["name"]) == i + 1)
    return F.map_from_entries(F.filter(firsts, lambda p: p["name"].isNotNull()))


def combined(text: Column, found: Column, names: list[str]) -> Column:
    """The named sections, joined; the whole text if they are blank or `main_content` is asked for."""
    if "main_content" in names:
        return text
    joined = F.trim(F.concat_ws(" ", *(found[n] for n in names)))
    return F.when(joined == "", text).otherwise(joined)


def headed_sections(df: DataFrame, key: str, text: str, canon: dict[str, str]) -> DataFrame:
    """key, section, body: lines under upper-case headings of less than 100 characters; ``canon`` maps patterns to section names. Lines before the first known heading are left out."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    heading = (F.length(F.trim("line")).between(1, 99)) & (F.upper("line") == F.col("line")) & F.col("line").rlike("[A-Z]")
    name = F.lit(None).cast("string")
    for pattern, section in reversed(canon.items()):
        name = F.when(F.lower("line").rlike(pattern), section).otherwise(name)
    lines = lines.withColumns({"heading": heading, "own": F.when(heading, name)})
    lines = lines.withColumn("section", F.last("own", ignorenulls=True).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return lines.where("section IS NOT NULL AND NOT (heading AND own IS NOT NULL)").groupBy(key, "section").agg(body.alias("body"))


def term_pattern(term: str, raw: bool = False) -> str:
    return rf"(?i)\b{term if raw else re.escape(term)}\b"


def tag_terms(docs: DataFrame, taxonomy: list[tuple[str, str, str, str, str]], key: str = "doc_id", text: str = "text", raw: bool = False) -> DataFrame:
    """key, category, subgroup, term, phrase, code for each phrase of the taxonomy (category, subgroup, term, phrase, code) that stands in a text as words.

    The taxonomy is a short list that comes with the call: every text is scanned where it is read, without a join, once for
    each subgroup and only then for the phrases of those that it has.
    """
    groups: dict[tuple[str, str], list] = {}
    for t in taxonomy:
        groups.setdefault(t[:2], []).append(t)
    entry = lambda t: F.struct(*(F.lit(v).alias(n) for n, v in zip(("category", "subgroup", "term", "phrase", "code"), t)))
    has = lambda ts: F.col(text).rlike("(?:" + "|".join(term_pattern(t[3], raw) for t in ts) + ")")
    hits = [F.when(has(ts), F.array_compact(F.array(*(F.when(has([t]), entry(t)) for t in ts)))) for ts in groups.values()]
    found = F.flatten(F.array_compact(F.array(*hits)))
    return docs.select(key, F.explode(found).alias("h")).select(key, "h.*")


def parent_tags(docs: DataFrame, taxonomy: list[tuple[str, str, str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, parent, terms: for each `category#subgroup` the terms, sorted and comma-joined, of which a phrase (category, subgroup, term, phrase) stands in a text.

    A term that ends in a range of ages, such as `Adults_18-64`, is also found by an age range in the text that overlaps it.
    """
    hits = tag_terms(docs, [(*t[:4], t[2]) for t in taxonomy], key, text, raw=True).select(key, "category", "subgroup", "term")
    ages = {t[:3]: m for t in taxonomy if (m := re.search(r"_(\d+)-(\d+)$", t[2]))}
    if ages:
        groups = docs.sparkSession.createDataFrame([(*t, int(m[1]), int(m[2])) for t, m in ages.items()], "category string, subgroup string, term string, group_low int, group_high int")
        ranges = docs.select(key, F.explode(age_ranges(F.col(text))).alias("r")).select(key, "r.low", "r.high")
        hits = hits.unionByName(overlapping(ranges, groups).select(key, "category", "subgroup", "term"))
    return hits.groupBy(key, F.concat_ws("#", "category", "subgroup").alias("parent")).agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"))


def tag_columns(tagged: DataFrame, taxonomy: list[tuple[str, str, str, str, str]], key: str = "doc_id") -> DataFrame:
    """A column category__hash__subgroup__hash__term of sorted `phrase:code` lists for each term; null where a text has none."""
    names = list(dict.fromkeys("__hash__".join(t[:3]) for t in taxonomy))
    return long_to_wide(tagged.withColumn("column", F.concat_ws("__hash__", "category", "subgroup", "term")), key, names)


AGES = r"(?i)(?:\bages?\s+|(?:less|greater|more)\s+than\s+|[<>]\s*)?\d{1,3}\s*(?:(?:-|–|to)\s*\d{1,3})?\s*(?:years?|yrs?)\b|\bages?\s+\d{1,3}\s*(?:-|–|to)\s*\d{1,3}"


def age_ranges(text: Column) -> Column:
    """Age ranges in a text as structs of low, high and operator (`=`, `<`, `>`); each once."""

    def parse(m: Column) -> Column:
        first = F.regexp_extract(m, r"(\d{1,3})", 1).try_cast("int")
        second = F.regexp_extract(m, r"\d{1,3}\s*(?:-|–|to)\s*(\d{1,3})", 1).try_cast("int")
        less, more = m.rlike(r"(?i)less\s+than|<"), m.rlike(r"(?i)(greater|more)\s+than|>")
        low = F.when(less, 0).when(more, first + 1).otherwise(first)
        high = F.when(less, first).when(more, NO_LIMIT).otherwise(F.coalesce(second, first))
        return F.struct(low.alias("low"), high.alias("high"), F.when(less, "<").when(more, ">").otherwise("=").alias("operator"))

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(AGES), F.lit(0)), parse))


def overlapping(ranges: DataFrame, groups: DataFrame) -> DataFrame:
    """Ranges (low, high) joined with the groups (name, group_low, group_high) that they overlap. The groups are a short list, which Spark may broadcast by its size."""
    return ranges.join(groups, (F.col("low") <= F.col("group_high")) & (F.col("high") >= F.col("group_low")))


def participants(text: Column, words: list[str]) -> Column:
    """Structs indicator, n, types for each `number word (types)`; each word and number once."""
    alternatives = "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
    whole = rf"(?i)\d[\d,]*\s+(?:{alternatives})\s*(?:\([^)]+\))?"

    def parse(m: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(m, rf"(?i)({alternatives})", 1)).alias("indicator"),
            F.replace(F.regexp_extract(m, r"^(\d[\d,]*)", 1), F.lit(","), F.lit("")).try_cast("long").alias("n"),
            F.nullif(F.regexp_extract(m, r"\(([^)]+)\)", 1), F.lit("")).alias("types"),
        )

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(0)), parse))


def participant_types(types: Column) -> Column:
    """`males=1197, females=1906` as a map; of equal names the last counts."""
    parts = F.filter(F.split(types, ","), lambda x: x.rlike(r"[A-Za-z][A-Za-z\s-]*=\s*\d+"))
    pair = lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"([A-Za-z][A-Za-z\s-]*?)\s*=", 1))).alias("k"), F.regexp_extract(x, r"=\s*(\d+)", 1).try_cast("long").alias("v"))
    return F.aggregate(F.transform(parts, pair), F.create_map().cast("map<string,bigint>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


COUNTED = r"(?i)(\d[\d,]*|\b(?:(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand)(?:[\s-]+(?:and\s+)?)?)+)\s*"


def study_counts(df: DataFrame, key: str, text: str, designs: dict[str, str]) -> DataFrame:
    """key, design, n: sums of the numbers, in figures or words, that stand before a design's name (name: category)."""
    names = "|".join(map(re.escape, sorted(designs, key=len, reverse=True)))
    matches = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(rf"{COUNTED}(?:{names})"), F.lit(0))).alias("m"))
    name = F.lower(F.regexp_extract("m", rf"(?i)({names})$", 1))
    table = F.create_map(*(F.lit(x.lower() if i == 0 else x) for kv in designs.items() for i, x in enumerate(kv)))
    number = to_int(F.trim(F.regexp_extract("m", COUNTED, 1)))
    return matches.select(key, table[name].alias("design"), number.alias("number")).where("number IS NOT NULL").groupBy(key, "design").agg(F.sum("number").alias("n"))


def study_total(text: Column, least: int = 1, most: int = 10_000) -> Column:
    """The first plausible number of included studies."""
    tries = (r"(?i)included\s+(?:a\s+total\s+of\s+)?(\d[\d,]*)\s+(?:\w+\s+){0,3}?(?:studies|trials|articles|rcts)", r"(?i)(\d[\d,]*)\s+(?:\w+\s+){0,3}?(?:studies|trials|articles|rcts)\s+(?:were|was)\s+included", r"(?i)(\d[\d,]*)\s+(?:studies|trials|articles|rcts)")
    number = lambda p: F.replace(F.regexp_extract(text, p, 1), F.lit(","), F.lit("")).try_cast("long")
    return F.coalesce(*(F.when(number(p).between(least, most), number(p)) for p in tries))


def databases(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The literature databases that a text names, by canonical name, sorted."""
    hits = [F.when(text.rlike(r"(?i)(?<!\w)(?:" + "|".join(map(re.escape, [name, *aliases])) + r")(?!\w)"), F.lit(name)) for name, aliases in vocabulary.items()]
    return F.array_sort(F.array_compact(F.array(*hits)))


# Phrases by which a text speaks of a search, and the characters around them in which databases are named.
SEARCH_PHRASES = (
    r"\b(systematic\s+)?search(?:es)?\s+(?:were|was)?\s*(?:conducted|performed|carried\s+out)?",
    r"\b(?:databases?|data\s+sources?)\s+(?:used|searched|included|screened)",
    r"\bsearch\s+(?:strategy|methodology|approach)",
    r"\b(?:literature|database)\s+search",
    r"\b(?:conducted|performed)\s+a\s+(?:database|literature)?\s*search",
    r"\b(?:screened|searched)\s+(?:databases?|sources)",
    r"\b(?:electronic|online)\s+databases?",
    r"\b(?:We)\s+searched?",
    r"\b(?:searches|strategies)\s+(?:included|used|involved)",
)
AROUND_SEARCH = 200


def databases_searched(text: Column, vocabulary: dict[str, list[str]], phrases: tuple[str, ...] = SEARCH_PHRASES, width: int = AROUND_SEARCH) -> Column:
    """The literature databases that a text names near a phrase of searching, by canonical name, sorted, each once.

    ``vocabulary`` has each database's other names; of names that begin at one place the longest counts. A name counts if
    all of it lies within ``width`` characters of a phrase's ends, in the text in lower case with single spaces. A null text
    gives null, one without phrases or names an empty array.
    """
    names = {n.lower(): canon for canon, others in reversed(vocabulary.items()) for n in [*others, canon]}
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    pattern = r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=lambda n: (-len(n), n)))) + r")(?!\w)"

    def found(t: Column) -> Column:
        around = F.flatten(F.array(*(F.transform(matches(t, f"(?i){p}"), lambda m: F.struct((m["start"] - width).alias("start"), (m["end"] + width).alias("end"))) for p in phrases)))
        named = F.when(F.size(around) > 0, inside(matches(t, pattern), around)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
        return F.array_sort(F.array_distinct(F.transform(named, lambda m: table[m["value"]])))

    return F.when(text.isNotNull(), once(F.lower(squeeze(text)), found))


def country_counts(df: DataFrame, key: str, text: str, countries: list[str]) -> DataFrame:
    """key, country, n from `Country (n)`, `Country (n = x)` and `x from Country`, added up."""
    names = "|".join(map(re.escape, sorted(countries, key=len, reverse=True)))
    after = rf"(?:{names})\s*\(\s*(?:[nN]\s*=\s*)?\d+\s*\)"
    before = rf"\d+\s+(?:\w+\s+){{0,3}}?(?:from|in)\s+(?:the\s+)?(?:{names})(?!\s*\()"
    rows = df.select(key, F.explode(F.concat(F.regexp_extract_all(text, F.lit(after), F.lit(0)), F.regexp_extract_all(text, F.lit(before), F.lit(0)))).alias("m"))
    return rows.select(key, F.regexp_extract("m", rf"({names})", 1).alias("country"), F.regexp_extract("m", r"(\d+)", 1).try_cast("long").alias("number")).groupBy(key, "country").agg(F.sum("number").alias("n"))


def effect_spans(text: Column, terms: list[str]) -> Column:
    """From a keyword to the number or interval that follows within 100 characters."""
    names = "|".join(map(re.escape, terms))
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{names})\b[^.:\n]{{0,100}}?(?:\d{{1,3}}(?:\.\d+)?\s*%|\d+\.\d+\s*[–-]\s*\d+\.\d+|\(\s*95%\s*CI[^)]*\))"), F.lit(0)), lambda x: F.trim(x))))


def first_label(text: Column, labels: list[tuple[str, str]]) -> Column:
    """`keyword: label` of the first keyword in a list that a text contains, else an empty text."""
    out = F.lit("")
    for word, label in reversed(labels):
        out = F.when(F.lower(text).contains(word.lower()), f"{word}: {label}").otherwise(out)
    return out


def sentence_counts(docs: DataFrame, taxonomy: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, code, n: the number of sentences in which a phrase (phrase, code) of each code stands."""
    rows = docs.select(key, F.posexplode(sentences(F.col(text))).alias("i", "sentence"))
    hits = F.array_distinct(F.array_compact(F.array(*(F.when(F.col("sentence").rlike(term_pattern(p)), F.lit(c)) for p, c in taxonomy))))
    return rows.select(key, F.explode(hits).alias("code")).groupBy(key, "code").agg(F.count(F.lit(1)).alias("n"))


def confidence(fields: list[str]) -> Column:
    """The share of filled fields, to two decimals."""
    return F.round(sum(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), 1).otherwise(0) for f in fields) / len(fields), 2)
