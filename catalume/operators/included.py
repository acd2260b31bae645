"""How many articles and studies a review includes: candidates of several forms, scored by the clause that they stand in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import SCALES, VALUES
from ..functions.text import sentences

# Patterns that decide the results, in the order in which they are tried.
INCLUSION_VERBS = r"\b(included|were included|was included|retained|synthesi[sz]ed|meta-?analy[sz]ed|analy[sz]ed|used for analysis|for data extraction|in the review)\b"
INCLUDED_STUDIES = r"\b(included|eligible)\s+stud(?:y|ies)\b"
DECOYS = r"\b(excluded|screened|removed|not included|missing data|non-eligible|eligibility)\b"
FINAL = (
    r"\b(?:final|overall)\s+(?:number|count)\s+of\s+(?:articles?|stud(?:y|ies))\s+(?:included|includ(?:ed|ing))"
    r"(?:\s+in\s+this\s+review)?\s*(?:is|was|were|:)?\s*([A-Za-z][A-Za-z\-\s]*|\d[\d,]*)"
    r"(?:\s*(?:representing|corresponding\s+to)\s+([A-Za-z][A-Za-z\-\s]*|\d[\d,]*)\s+unique\s+stud(?:y|ies))?"
)
IN_REVIEW = (
    r"\b([A-Za-z][A-Za-z\-\s]*|\d[\d,]*)\s+(?:articles?|stud(?:y|ies))\s+were?\s+included\s+in\s+this\s+review"
    r"(?:[^.]{0,160}?\b(?:representing|corresponding\s+to)\s+([A-Za-z][A-Za-z\-\s]*|\d[\d,]*)\s+unique\s+stud(?:y|ies))?"
)
MEETING = r"\b([A-Za-z][A-Za-z\-\s]*|\d[\d,]*)\s+(?:met|meeting)\s+inclusion\s+criteria\b"
GENERIC = (
    r"\b([A-Za-z][A-Za-z\- ]+|\d[\d,]*)\s+(?:stud(?:y|ies)|articles?|trials?)\b[^.]{0,160}?\b"
    r"(?:included|analy[sz]ed|synthesi[sz]ed|meta-?analy[sz]ed|used for analysis|for data extraction|in the review)\b"
)
GENERIC_BEFORE = (
    r"\b(?:included|analy[sz]ed|synthesi[sz]ed|meta-?analy[sz]ed|used for analysis|for data extraction|in the review)\b"
    r"[^.]{0,160}?\b([A-Za-z][A-Za-z\- ]+|\d[\d,]*)\s+(?:stud(?:y|ies)|articles?|trials?)\b"
)
TYPED = {
    "rct": r"\b([A-Za-z][A-Za-z\- ]+|\d[\d,]*)\s+(?:randomi[sz]ed\s+controlled\s+trials?|rcts?)\b",
    "cohort": r"\b([A-Za-z][A-Za-z\- ]+|\d[\d,]*)\s+(?:cohort\s+stud(?:y|ies))\b",
    "case_control": r"\b([A-Za-z][A-Za-z\- ]+|\d[\d,]*)\s+(?:case[-\s]?control\s+stud(?:y|ies))\b",
    "cross_sectional": r"\b([A-Za-z][A-Za-z\- ]+|\d[\d,]*)\s+(?:cross[-\s]?sectional\s+stud(?:y|ies))\b",
    "nrsi": r"\b([A-Za-z][A-Za-z\- ]+|\d[\d,]*)\s+(?:non[-\s]?randomi[sz]ed\s+stud(?:y|ies)|observational\s+stud(?:y|ies))\b",
}
COUNTRIES = r"\b(?:span|from)\s+([A-Za-z][A-Za-z\-\s]*|\d[\d,]*)\s+countries?\b"
#: Words that a clause must have for a pattern: they are looked for first, as the words before a noun take long to try at each place of a long clause.
NOUNS = {k: p.partition(r"\s+")[2] for k, p in TYPED.items()}
CRITERIA, COUNTED, INCLUDING, REGION = r"inclusion\s+criteria", r"(?:stud(?:y|ies)|articles?|trials?)\b", r"\b(?:included|analy[sz]ed|synthesi[sz]ed|meta-?analy[sz]ed|used for analysis|for data extraction|in the review)\b", r"\bcountr"
#: What a clause's score gains where it has a pattern: the lowest score wins.
SCORES = ((r"\b(final|overall)\b", -6), (r"\bin this review\b", -5), (r"\brepresenting\s+\d", -3), (r"\bmet(?:ting)? inclusion criteria\b", 2), (DECOYS, 6))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, f"(?i){pattern}", n)


def loose_int(text: Column) -> Column:
    """The number of a phrase, null without one or for 0: its first figures, else its number words, whatever else stands between them. `hundred`, `thousand` and `million` multiply what stands before and close it."""
    values, scales = (F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) for d in (VALUES, SCALES))
    words = F.split(F.regexp_replace(F.lower(text), r"[–—−-]", " "), r"\s+")
    zero = F.lit(0).cast("long")

    def step(a: Column, w: Column) -> Column:
        unit, scale = values[w].cast("long"), scales[w].cast("long")
        closed = F.greatest(a["now"], F.lit(1)) * scale
        return F.struct(
            F.when(scale.isNotNull(), a["total"] + closed).otherwise(a["total"]).alias("total"),
            F.when(scale.isNotNull(), zero).otherwise(a["now"] + F.coalesce(unit, zero)).alias("now"),
        )

    spoken = F.aggregate(words, F.struct(zero.alias("total"), zero.alias("now")), step, lambda a: a["total"] + a["now"])
    figures = F.regexp_replace(F.regexp_extract(text, r"\d[\d,]*", 0), ",", "")
    number = F.when(figures != "", figures.try_cast("long")).otherwise(spoken)
    return F.when(number > 0, number)


def clause_score(clause: Column) -> Column:
    return sum((F.when(_has(clause, p), n).otherwise(0) for p, n in SCORES), F.lit(0))


def _best(found: Column) -> Column:
    """The candidate with the lowest score, of these the shortest match, of these the first (an array of structs that begin with score and size)."""
    ranked = F.transform(found, lambda x, i: F.struct(x["score"].alias("score"), x["size"].alias("size"), i.alias("i"), x.alias("x")))
    return F.array_min(ranked)["x"]


def _candidate(clause: Column, match: Column, pattern: str, field: str, unique: bool) -> Column:
    studies = loose_int(_group(match, pattern, 2)) if unique else F.lit(None).cast("long")
    return F.struct(clause_score(clause).alias("score"), F.length(match).alias("size"), loose_int(_group(match, pattern, 1)).alias("articles"), studies.alias("studies"), F.lit(field).alias("field"), clause.alias("clause"))


def _all(clauses: Column, patterns: tuple[str, ...], field: str) -> Column:
    """The candidates of all matches of two-number patterns, clause by clause."""
    of = lambda c, p: F.transform(F.regexp_extract_all(c, F.lit(f"(?i){p}"), F.lit(0)), lambda m: _candidate(c, m, p, field, True))
    return F.filter(F.flatten(F.transform(clauses, lambda c: F.concat(*(of(c, p) for p in patterns)))), lambda x: x["articles"].isNotNull())


def _every(clauses: Column, pattern: str, field: str) -> Column:
    of = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"(?i){pattern}"), F.lit(0)), lambda m: _candidate(c, m, pattern, field, False))
    return F.filter(F.flatten(F.transform(F.filter(clauses, lambda c: _has(c, CRITERIA)), of)), lambda x: x["articles"].isNotNull())


def _first_of(clauses: Column, patterns: tuple[str, ...], field: str) -> Column:
    """A candidate for the first match of each clause without decoys; of the first pattern that matches."""
    rest = F.filter(clauses, lambda c: _has(c, INCLUDING) & _has(c, COUNTED) & ~_has(c, DECOYS))

    def of(c: Column) -> Column:
        out = F.lit(None)
        for p in reversed(patterns):
            out = F.when(_has(c, p), _candidate(c, _group(c, p, 0), p, field, False)).otherwise(out)
        return out

    return F.filter(F.transform(rest, of), lambda x: x["articles"].isNotNull())


def _typed(clauses: Column, pattern: str, noun: str) -> Column:
    """The number of the first clause that speaks of included studies and has one."""
    told = F.filter(F.filter(clauses, lambda c: _has(c, noun)), lambda c: F.lower(c).contains("stud") | (~_has(c, DECOYS) & (_has(c, INCLUSION_VERBS) | _has(c, INCLUDED_STUDIES))))
    found = F.transform(told, lambda c: F.struct(loose_int(_group(c, pattern, 1)).alias("n"), c.alias("clause")))
    return F.get(F.filter(found, lambda x: x["n"].isNotNull()), F.lit(0))


def included_counts(text: Column) -> Column:
    """A struct of the numbers that a review states of what it includes.

    articles_included, unique_studies and total; rct, cohort, case_control, cross_sectional and nrsi, scaled down (half to
    even) if they add up to more than a total; num_countries_included (null if not told); evidence, an array of structs
    field and text. A final or overall number, or one that is included in this review, goes before what met inclusion
    criteria, and that before other numbers of included studies; of several candidates the one with the lowest clause score
    counts, of these the shortest. All sentences are read, and the whole text as one more clause for the first form. A text
    without numbers has zeros; a null text gives null. Each form is only sought in texts that hold its words.
    """
    clauses = sentences(text)
    none = F.array().cast("array<struct<score:int,size:int,articles:bigint,studies:bigint,field:string,clause:string>>")
    where = lambda words, found: F.when(_has(text, words), found).otherwise(none)
    final = where(r"(?:final|overall)\s+(?:number|count)|included\s+in\s+this\s+review", _all(F.concat(clauses, F.array(text)), (FINAL, IN_REVIEW), "studies.final"))
    meeting = where(CRITERIA, _every(clauses, MEETING, "studies.inclusion_criteria"))
    generic = where(r"stud(?:y|ies)|articles?|trials?", _first_of(clauses, (GENERIC, GENERIC_BEFORE), "studies.generic"))
    chosen = F.coalesce(_best(final), _best(meeting), _best(generic))
    typed = F.struct(*(F.when(_has(text, NOUNS[k]), _typed(clauses, p, NOUNS[k])).alias(k) for k, p in TYPED.items()))
    countries = F.when(_has(text, REGION), _typed_any(F.filter(clauses, lambda c: _has(c, REGION)), COUNTRIES))

    def assembled(found: Column) -> Column:
        zero = F.lit(0).cast("long")
        articles, studies = F.coalesce(found["chosen"]["articles"], zero), F.coalesce(found["chosen"]["studies"], zero)
        total = F.when((studies > 0) & ((studies <= articles) | (articles == 0)), studies).otherwise(articles)
        numbers = {k: F.coalesce(found["typed"][k]["n"], zero) for k in TYPED}
        added = sum(numbers.values(), zero)
        scaled = lambda n: F.when((total > 0) & (added > total), F.rint(n * (total / added)).cast("long")).otherwise(n)
        told = [F.struct(found["chosen"]["field"].alias("field"), found["chosen"]["clause"].alias("text"))]
        told += [F.struct(F.when(found["typed"][k]["n"].isNotNull(), f"studies.{k}").alias("field"), found["typed"][k]["clause"].alias("text")) for k in TYPED]
        told += [F.struct(F.when(found["countries"]["n"].isNotNull(), "studies.num_countries_included").alias("field"), found["countries"]["clause"].alias("text"))]
        return F.struct(
            articles.alias("articles_included"), studies.alias("unique_studies"), total.alias("total"),
            *(scaled(n).alias(k) for k, n in numbers.items()),
            found["countries"]["n"].alias("num_countries_included"),
            F.filter(F.array(*told), lambda e: e["field"].isNotNull()).alias("evidence"),
        )

    found = F.struct(chosen.alias("chosen"), typed.alias("typed"), countries.alias("countries"))
    return F.when(text.isNotNull(), F.get(F.transform(F.array(found), assembled), F.lit(0)))


def _typed_any(clauses: Column, pattern: str) -> Column:
    found = F.transform(clauses, lambda c: F.struct(loose_int(_group(c, pattern, 1)).alias("n"), c.alias("clause")))
    return F.get(F.filter(found, lambda x: x["n"].isNotNull()), F.lit(0))
