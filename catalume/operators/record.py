"""One record a text: what all extractors find in it, in named fields, with the sentences that it was found in."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.arrays import once
from ..functions.text import sentences
from . import facts, included, tagging

# Patterns of study designs and ages, caps of terms and of evidence.
DESIGNS = {
    "rct": r"\brandomi[sz]ed\s+controlled\s+trial(s)?\b|\bRCTs?\b",
    "cohort": r"\bcohort\s+stud(?:y|ies)\b",
    "case_control": r"\bcase[-\s]?control\s+stud(?:y|ies)\b",
    "cross_sectional": r"\bcross[-\s]?sectional\s+stud(?:y|ies)\b",
    "nrsi": r"\b(non[-\s]?randomi[sz]ed|observational)\s+stud(?:y|ies)\b",
}
AGE = r"\b(\d{1,2})\s*(?:to|-|–|—)\s*(\d{1,2})\s*(?:years?|yrs?)\b|\b(\d{1,2})\s*(?:years?|yrs?)\b"
MOST_TERMS = 150
CAPS = {"studies": 8, "countries": 20, "designs": 12, "topics": 20, "interventions": 20, "ages": 20, "databases": 5, "treatment": 15}
MOST_EVIDENCE = 60

#: Own rules. A number stands in figures or in the four words before a design; a country is up to six capitalised words, so that a long run of them takes time by its length.
NUMBER = r"(\b(?:[A-Za-z-]{1,30}\s+){1,4}|\d[\d,]*\s+)"
NAME = r"[A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+){0,5}"
STUDIES_OF = rf"\b({NAME})\s*\(\s*(\d{{1,4}})\s*\)"
SAMPLES_OF = rf"\b({NAME})\s*\(\s*[nN]\s*=\s*(\d[\d,]*)\s*\)"
SAMPLES_FROM = rf"\b(\d[\d,]*)\s+(?:participants|subjects)\s+(?:from|in)\s+(?:the\s+)?({NAME})"
SAMPLES_HAD = rf"\b({NAME})\s+(?:had|with)\s+(\d[\d,]*)\s+(?:participants|subjects)\b"


@dataclass
class Vocabulary:
    """What a record looks for: codes with their phrases (of a code the first phrase that stands in a sentence counts), names of regions, databases with their other names, countries' other names, and short codes of the term maps."""

    topics: dict[str, list[str]] = field(default_factory=dict)
    outcomes: dict[str, list[str]] = field(default_factory=dict)
    diseases: dict[str, list[str]] = field(default_factory=dict)
    vaccine_options: dict[str, list[str]] = field(default_factory=dict)
    age_groups: dict[str, list[str]] = field(default_factory=dict)
    specific_groups: dict[str, list[str]] = field(default_factory=dict)
    immune_status: dict[str, list[str]] = field(default_factory=dict)
    regions: list[str] = field(default_factory=list)
    databases: dict[str, list[str]] = field(default_factory=dict)
    countries: dict[str, str] = field(default_factory=dict)
    short: dict[str, str] = field(default_factory=dict)


HIT = "array<struct<code:string,term:string,short:string,sentence:string>>"


def _hit(code: Column, term: Column, short: Column, sentence: Column) -> Column:
    return F.struct(code.alias("code"), term.alias("term"), short.alias("short"), sentence.alias("sentence"))


def phrase_hits(sentence: Column, words: dict[str, list[str]], short: dict[str, str], cased: bool = False) -> Column:
    """A hit for each code of which a phrase stands in a sentence as words: code, the phrase as written, short code, sentence."""
    flag = "" if cased else "(?i)"
    as_words = lambda ws: rf"{flag}\b(?:{'|'.join(map(re.escape, ws))})\b"
    term = lambda ws: F.coalesce(*(F.nullif(F.regexp_extract(sentence, as_words([w]), 0), F.lit("")) for w in ws))
    found = [F.when(sentence.rlike(as_words(ws)), _hit(F.lit(c), term(ws), F.lit(short.get(c, c)), sentence)) for c, ws in words.items() if ws]
    return F.array_compact(F.array(*found)).cast(HIT)


def age_hits(sentence: Column) -> Column:
    """A hit for each range of ages or age in years: `range_10_17` or `age_12`, with the short code of the middle of the range."""

    def of(m: Column) -> Column:
        low, high, single = (F.regexp_extract(m, f"(?i){AGE}", i) for i in (1, 2, 3))
        whole = lambda c: c.try_cast("int")
        middle = F.coalesce(F.floor((whole(low) + whole(high)) / 2), whole(single))
        short = F.when(middle <= 1, "nb").when(middle <= 9, "chi").when(middle <= 17, "ado").when(middle <= 64, "adu").otherwise("eld")
        code = F.when(single != "", F.concat(F.lit("age_"), whole(single))).otherwise(F.concat(F.lit("range_"), whole(low), F.lit("_"), whole(high)))
        return _hit(code, F.concat(F.when(single != "", single).otherwise(F.concat(low, F.lit("–"), high)), F.lit(" years")), short, sentence)

    return F.transform(F.regexp_extract_all(sentence, F.lit(f"(?i){AGE}"), F.lit(0)), of).cast(HIT)


def design_hits(sentence: Column) -> Column:
    """Structs code, n and sentence for each design that a sentence names: the number that stands before it, else 1."""
    number = lambda p: included.loose_int(F.regexp_extract(sentence, f"(?i){NUMBER}(?:{p})", 1))
    found = [F.when(sentence.rlike(f"(?i){p}"), F.struct(F.lit(c).alias("code"), F.coalesce(number(p), F.lit(1)).cast("long").alias("n"), sentence.alias("sentence"))) for c, p in DESIGNS.items()]
    return F.array_compact(F.array(*found))


def _filled(values: Column) -> Column:
    """An array or map, null if it is empty."""
    return once(values, lambda v: F.when(F.size(v) > 0, v))


def _any(**columns: Column) -> Column:
    """A struct, null if all its fields are."""
    return once(F.struct(*(c.alias(n) for n, c in columns.items())), lambda x: F.when(F.coalesce(*(F.when(x[n].isNotNull(), True) for n in columns)), x))


def _fold(pairs: Column, whole: Callable[[Column], Column], most: int | None = None) -> Column:
    """A map of the codes of an array of structs code, n and the ``whole`` of each code's n, in the order of the first, ``most`` in all; null without any. Equal codes are brought together by a sort, so that it takes time by the array's length."""

    def by_start(xs: Column) -> Column:
        starts = F.filter(F.transform(xs, lambda x, i: F.when(~F.get(xs, i - 1)["code"].eqNullSafe(x["code"]), i)), lambda i: i.isNotNull())

        def of(begins: Column) -> Column:
            size = lambda b, j: F.coalesce(F.get(begins, j + 1), F.size(xs)) - b
            run = lambda b, j: F.transform(F.slice(xs, b + 1, size(b, j)), lambda x: x["n"])
            return F.transform(begins, lambda b, j: F.struct(F.get(xs, b)["i"].alias("i"), F.get(xs, b)["code"].alias("code"), whole(run(b, j)).alias("n")))

        return once(starts, of)

    ordered = F.array_sort(F.transform(pairs, lambda x, i: F.struct(x["code"].alias("code"), i.alias("i"), x["n"].alias("n"))))
    runs = F.array_sort(once(ordered, by_start))
    runs = F.slice(runs, 1, most) if most else runs
    return _filled(F.map_from_entries(F.transform(runs, lambda r: F.struct(r["code"], r["n"]))))


def _sum(ns: Column) -> Column:
    return F.aggregate(ns, F.lit(0).cast("long"), lambda a, n: a + n)


def _counts(hits: Column) -> Column:
    return _fold(F.transform(hits, lambda h: F.struct(h["code"].alias("code"), F.lit(1).cast("long").alias("n"))), _sum)


def _terms(hits: Column) -> Column:
    """A map of the phrases as written and their short codes: of a phrase the first, MOST_TERMS in all."""
    return _fold(F.transform(hits, lambda h: F.struct(h["term"].alias("code"), h["short"].alias("n"))), lambda ns: F.get(ns, F.lit(0)), MOST_TERMS)


def _named(text: Column, pattern: str, name: int, number: int, aliases: dict[str, str]) -> Column:
    """Structs code (a country), n and sentence (the words that tell it) of a pattern's matches."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else None

    def of(m: Column) -> Column:
        plain = F.regexp_replace(F.regexp_extract(m, pattern, name), r"^The\s+", "")
        code = F.coalesce(table[plain], plain) if aliases else plain
        return F.struct(code.alias("code"), F.regexp_replace(F.regexp_extract(m, pattern, number), ",", "").try_cast("long").alias("n"), m.alias("sentence"))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of), lambda x: x["n"].isNotNull())


def _by_size(counts: Column) -> Column:
    """A map with its largest values first, of equal ones the first name."""
    key = lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("key"), e["value"].alias("value"))
    return F.map_from_entries(F.transform(F.array_sort(F.transform(F.map_entries(counts), key)), lambda e: F.struct(e["key"], e["value"])))


def _said(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["sentence"])


FIELDS = (
    "lit_search_date", "articles", "studies", "design_counts", "topics", "topics_terms", "outcomes", "interventions", "intervention_terms", "age_groups",
    "age_group_terms", "specific_groups", "specific_group_terms", "immune_status", "countries", "regions", "databases", "treatment",
)


def assemble(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, record, evidence and confidence of each row's text, without a shuffle.

    record is a struct of FIELDS, in this order; what is not found is null, at every depth, so that `to_json` leaves it out
    (numbers of 0 stay). evidence are structs field and text: the sentences, or words, that a field was found in, for each
    field up to CAPS and MOST_EVIDENCE in all. confidence is the share of filled fields, to two decimals. Counts are of
    sentences, each code once in a sentence; all sentences are read, as no model ranks them. A design counts the number
    before it. Groups of people are told apart by capitals, other phrases aren't. Databases are those near a phrase of
    searching, else those anywhere. An empty or null text gives a record of nulls, no evidence and a confidence of 0; rows
    are not told apart by their key, and other columns are left out.
    """
    v, t, sents = vocabulary, F.col("_text"), F.col("_sentences")
    hits = lambda words, cased=False: F.flatten(F.transform(sents, lambda s: phrase_hits(s, words, v.short, cased)))
    either = lambda a, b, cased=False: F.flatten(F.transform(sents, lambda s: F.concat(phrase_hits(s, a, v.short, cased), b(s))))
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_sentences", sentences(t))
    near = tagging.databases_searched(t, v.databases) if v.databases else F.array().cast("array<string>")
    anywhere = tagging.databases(t, v.databases) if v.databases else near
    rows = rows.withColumns({
        "_date": dates.last_search(t),
        "_included": included.included_counts(t),
        "_designs": F.flatten(F.transform(sents, design_hits)),
        "_topics": hits(v.topics),
        "_outcomes": hits(v.outcomes),
        "_diseases": hits(v.diseases),
        "_options": hits(v.vaccine_options),
        "_interventions": either(v.diseases, lambda s: phrase_hits(s, v.vaccine_options, v.short)),
        "_ages": either(v.age_groups, age_hits),
        "_groups": hits(v.specific_groups, True),
        "_immune": hits(v.immune_status),
        "_studies_of": _named(t, STUDIES_OF, 1, 2, v.countries),
        "_samples": F.concat(_named(t, SAMPLES_OF, 1, 2, v.countries), _named(t, SAMPLES_FROM, 2, 1, v.countries), _named(t, SAMPLES_HAD, 1, 2, v.countries)),
        "_regions": F.array_compact(F.array(*(F.when(t.rlike(rf"\b{re.escape(r)}\b"), F.lit(r)) for r in v.regions))).cast("array<string>"),
        "_near": near,
        "_treated": F.filter(sents, lambda s: s.rlike("(?i)" + "|".join(f"(?:{p})" for p in (facts.DURATION, facts.DOSE_UNITS, facts.DOSE_SCHEDULE, facts.COMPARATOR)))),
        "_treatment": facts.treatment(t),
    }).withColumn("_databases", F.when(F.size("_near") > 0, F.col("_near")).otherwise(anywhere))
    c, got, cure = F.col, F.col("_included"), F.col("_treatment")
    told = (got["articles_included"] > 0) | (got["total"] > 0)
    zero = F.lit(0).cast("long")
    typed = sum((got[k] for k in included.TYPED), zero)
    values = {
        "lit_search_date": c("_date")["text"],
        "articles": F.when(told, F.struct(*(got[n].alias(n) for n in ("articles_included", "unique_studies", "num_countries_included")))),
        "studies": F.when((got["total"] > 0) | (typed > 0), F.struct(*(got[n].alias(n) for n in ("total", *included.TYPED)))),
        "design_counts": _fold(c("_designs"), _sum),
        "topics": _counts(c("_topics")),
        "topics_terms": _terms(c("_topics")),
        "outcomes": _counts(c("_outcomes")),
        "interventions": _any(diseases=_counts(c("_diseases")), vaccine_options=_counts(c("_options"))),
        "intervention_terms": _terms(c("_interventions")),
        "age_groups": _counts(c("_ages")),
        "age_group_terms": _terms(c("_ages")),
        "specific_groups": _counts(c("_groups")),
        "specific_group_terms": _terms(c("_groups")),
        "immune_status": _counts(c("_immune")),
        "countries": _any(study_counts=_by_size(_fold(c("_studies_of"), _sum)), sample_sizes=_by_size(_fold(c("_samples"), F.array_max))),
        "regions": _filled(c("_regions")),
        "databases": F.when(F.size("_databases") > 0, F.struct(F.size("_databases").alias("num_databases"), c("_databases").alias("database_list"))),
        "treatment": _any(
            duration_of_intervention=_filled(cure["durations"]),
            dosage=_any(amounts=_filled(cure["doses"]), schedules=_filled(cure["schedules"])),
            comparator=_filled(cure["comparators"]),
        ),
    }
    speaks = F.filter(sents, lambda s: F.exists(c("_databases"), lambda d: s.contains(d)))
    evidence = facts.evidence({
        "lit_search_date": F.array_compact(F.array(c("_date")["text"])),
        "studies": F.transform(got["evidence"], lambda e: e["text"]),
        "countries": _said(F.concat("_samples", "_studies_of")),
        "designs": _said(c("_designs")),
        "topics": F.concat(_said(c("_topics")), _said(c("_outcomes"))),
        "interventions": _said(c("_interventions")),
        "ages": F.flatten(F.array(_said(c("_ages")), _said(c("_groups")), _said(c("_immune")))),
        "databases": speaks,
        "treatment": c("_treated"),
    }, CAPS, MOST_EVIDENCE)
    filled = sum((F.when(c(f"_r.{n}").isNotNull(), 1).otherwise(0) for n in FIELDS), F.lit(0))
    out = rows.select(key, F.struct(*(values[n].alias(n) for n in FIELDS)).alias("_r"), evidence.alias("evidence"))
    return out.select(key, F.col("_r").alias("record"), "evidence", F.round(filled / len(FIELDS), 2).alias("confidence"))
