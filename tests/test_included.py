"""Numbers of included studies against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from catalume.functions.numbers import SCALES, VALUES
from catalume.operators import included as I


def loose(s):
    if m := re.search(r"\d[\d,]*", s or ""):
        return int(m[0].replace(",", "")) or None
    total = now = 0
    for w in re.sub("[–—−-]", " ", (s or "").lower()).split():
        if w in SCALES:
            total, now = total + max(1, now) * SCALES[w], 0
        else:
            now += VALUES.get(w, 0)
    return total + now or None


def score(c):
    return sum(n for p, n in I.SCORES if re.search(p, c, re.I))


def counted(text):
    if text is None:
        return None
    clauses = [c.strip() for c in re.split(r"(?<=[.?!])\s+", text) if c.strip()]
    found = [(score(c), len(m[0]), a, loose(m[2])) for c in [*clauses, text] for p in (I.FINAL, I.IN_REVIEW) for m in re.finditer(p, c, re.I) if (a := loose(m[1]))]
    best = min(found, key=lambda x: x[:2], default=None)
    if not best:
        found = [(score(c), len(m[0]), a, None) for c in clauses for m in re.finditer(I.MEETING, c, re.I) if (a := loose(m[1]))]
        best = min(found, key=lambda x: x[:2], default=None)
    if not best:
        found = [(score(c), len(m[0]), a, None) for c in clauses if not re.search(I.DECOYS, c, re.I) and (m := re.search(I.GENERIC, c, re.I) or re.search(I.GENERIC_BEFORE, c, re.I)) and (a := loose(m[1]))]
        best = min(found, key=lambda x: x[:2], default=(0, 0, 0, None))
    articles, studies = best[2], best[3] or 0
    total = studies if studies and studies <= (articles or studies) else articles
    typed = {}
    for k, p in I.TYPED.items():
        told = [c for c in clauses if "stud" in c.lower() or (not re.search(I.DECOYS, c, re.I) and (re.search(I.INCLUSION_VERBS, c, re.I) or re.search(I.INCLUDED_STUDIES, c, re.I)))]
        typed[k] = next((n for c in told if (m := re.search(p, c, re.I)) and (n := loose(m[1]))), 0)
    if total and sum(typed.values()) > total:
        factor = total / sum(typed.values())
        typed = {k: round(n * factor) for k, n in typed.items()}
    countries = next((n for c in clauses if (m := re.search(I.COUNTRIES, c, re.I)) and (n := loose(m[1]))), None)
    return (articles, studies, total, *typed.values(), countries)


TEXTS = [
    None,
    "",
    "No numbers stand here.",
    "We screened 900 articles. The final number of articles included was 25 representing 20 unique studies. Overall, 30 studies were included in this review.",
    "Forty-two articles were included in this review. Of these, 12 RCTs and thirty cohort studies were analysed.",
    "Twelve met inclusion criteria. After removal of duplicates 14 met inclusion criteria.",
    "14 met inclusion criteria after 9 were excluded. A total of twelve met inclusion criteria.",
    "We included 1,204 studies. 700 observational studies, 600 case-control studies and 5 cross-sectional studies were analysed from eleven countries.",
    "Five trials were excluded. Nine trials were synthesised. 8 trials were analyzed.",
    "Two hundred and five articles were included in this review representing 300 unique studies.",
    "In total 5 studies were included: 3 RCTs, 3 cohort studies, 3 nonrandomized studies. Studies came from two countries.",
    "0 studies were included in this review.",
]


def found(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", I.included_counts(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_against_a_loop(spark):
    assert [v and tuple(v)[:9] for v in found(spark, TEXTS)] == [counted(t) for t in TEXTS]


@pytest.mark.parametrize("seed", range(2))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    parts = ["the final number of articles included was", "overall count of studies including", "were included in this review", "representing", "unique studies", "met inclusion criteria", "articles", "studies", "trials", "RCTs", "randomised controlled trials", "cohort studies", "case control studies", "cross-sectional studies", "observational studies", "excluded", "analysed", "retained", "from", "countries", "12", "1,030", "seven", "thirty-one", "two hundred", "0", "and", ",", ". ", ". ", "? "]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(4, 30))) for _ in range(150)]
    assert [tuple(v)[:9] for v in found(spark, texts)] == [counted(t) for t in texts]


def test_evidence(spark):
    (v,) = found(spark, ["We screened 900. Six articles were included in this review. Four RCTs were analysed from 3 countries."])
    assert [(e["field"], e["text"]) for e in v["evidence"]] == [
        ("studies.final", "Six articles were included in this review."),
        ("studies.rct", "Four RCTs were analysed from 3 countries."),
        ("studies.num_countries_included", "Four RCTs were analysed from 3 countries."),
    ]
