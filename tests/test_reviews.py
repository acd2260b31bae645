"""Phrase tables, databases near phrases of searching, date intervals and literals."""

import ast
import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from catalume.functions import dates, text
from catalume.operators import phrases, tagging

D = datetime.date


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("sent", [200_000, 0])
def test_five_thousand_phrases(spark, monkeypatch, sent):
    """Against a search for each phrase; with a table that is sent and one that is shuffled."""
    monkeypatch.setattr(phrases, "SENT_ROWS", sent)
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice(["flu", "Ärzte", "hpv", "in", "x_1", "19"]) + rng.choice(["", "", "s"]) for _ in range(n))
    texts = [None, "", "one-two", "FLU, hpv", *(some(rng.randrange(60)).replace(" ", rng.choice([" ", "-", ", "])) for _ in range(200))]
    table = [(some(rng.randrange(1, 6)), i) for i in range(5000)] + [("...", -1), (None, -2), ("One Two", -3)]
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    wanted = {(i, c) for i, t in enumerate(texts) for p, c in table if plain(p) and f" {plain(p)} " in f" {plain(t)} "}
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id int, text string, h1 int")
    found = phrases.tag_phrases(docs, spark.createDataFrame(table, "phrase string, row int")).select("doc_id", "row").collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == wanted
    assert phrases.tag_phrases(docs, spark.createDataFrame([], "phrase string, row int")).isEmpty()


def test_taxonomy_table(spark):
    """The groups and phrases of a population taxonomy."""
    table = [("population", "sex", "Male", p, "ma") for p in ("men", "male", "males")] + [("population", "sex", "Female", "women", "fe"), ("topic", "uptake", "Uptake", "vaccine uptake", "up"), ("population", "age", "Adults", "older adults", "ad")]
    docs = spark.createDataFrame([(1, "Vaccine-uptake in men and women; males"), (2, "Older adults."), (3, "womens"), (4, None)], "doc_id int, text string")
    found = phrases.tag_table(docs, spark.createDataFrame(table, "category string, subgroup string, term string, phrase string, code string"))
    assert sorted(map(tuple, found.collect())) == [(1, "population#sex", "Female, Male", "fe, ma"), (1, "topic#uptake", "Uptake", "up"), (2, "population#age", "Adults", "ad")]


VOCABULARY = {"MEDLINE": ["MEDLINE via Ovid"], "PubMed": ["PubMed Central"], "Embase": ["Excerpta Medica"], "ClinicalTrials.gov": []}


def test_databases_near_searches(spark):
    pad = lambda n: "x" * n
    texts = [
        None,
        "",
        "PubMed is large. " + pad(400) + " Embase is larger.",
        f"Embase {pad(150)} We searched   PubMed\nCentral and excerpta medica. {pad(300)} MEDLINE",
        f"Electronic databases {pad(190)} MEDLINE",
        f"Electronic databases {pad(191)} MEDLINE via Ovid",
        f"clinicaltrials.gov and pubmedx were databases used. {pad(250)} MEDLINE {pad(100)} Search strategy: none",
    ]
    found = values(spark, lambda t: tagging.databases_searched(t, VOCABULARY), *texts)
    assert found == [None, [], [], ["Embase", "PubMed"], ["MEDLINE"], [], ["ClinicalTrials.gov", "MEDLINE"]]


def test_databases_against_windows(spark):
    rng = random.Random(8)
    bits = ["we searched", "pubmed", "embase", "data sources included", "a" * 30, "b" * 70, "medline via ovid", "medline", "search strategy", "."]
    texts = [" ".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(80)]
    names = {"medline via ovid": "MEDLINE", "medline": "MEDLINE", "pubmed": "PubMed", "embase": "Embase"}

    def plain(t):
        t = re.sub(r"\s+", " ", t).strip().lower()
        spans = [(m.start() - 200, m.end() + 200) for p in tagging.SEARCH_PHRASES for m in re.finditer(p, t, re.I)]
        return sorted({names[m[0]] for m in re.finditer(r"(?<!\w)(?:medline via ovid|medline|pubmed|embase)(?!\w)", t) if any(a <= m.start() and m.end() <= b for a, b in spans)})

    assert values(spark, lambda t: tagging.databases_searched(t, VOCABULARY), *texts) == [plain(t) for t in texts]


DATES = [
    ("on 3 May 2021", [(D(2021, 5, 3), D(2021, 5, 3))]),
    ("May 3rd, 2021 and Feb. 2020", [(D(2021, 5, 3), D(2021, 5, 3)), (D(2020, 2, 1), D(2020, 2, 29))]),
    ("2020-02-29, 2021-02-29", [(D(2020, 2, 29), D(2020, 2, 29))]),
    ("between May and September 2019", [(D(2019, 5, 1), D(2019, 9, 30))]),
    ("from 1 January 2010 to 30 June 2012", [(D(2010, 1, 1), D(2012, 6, 30))]),
    ("2019-2021 and 2018–19", [(D(2019, 1, 1), D(2021, 12, 31)), (D(2018, 1, 1), D(2019, 12, 31))]),
    ("until May 2021; up to 2015", [(None, D(2021, 5, 31)), (None, D(2015, 12, 31))]),
    ("from inception to Dec 2, 2020", [(None, D(2020, 12, 2))]),
    ("2021-2019", []),
    ("2000 people, 31 February 2020, mayor 2020", []),
    ("", []),
]


def test_date_intervals(spark):
    found = values(spark, dates.date_intervals, *(t for t, _ in DATES))
    assert [[(x["first"], x["last"]) for x in xs] for xs in found] == [wanted for _, wanted in DATES]
    assert values(spark, dates.date_intervals, None) == [None]


def test_last_search(spark):
    texts = ["Searched to Sept. 2021. Then 2024-01-01", "We searched PubMed until May 2021. The trial ended on 3 June 2022.", "Databases were searched from 2019 to 2021 and updated in March 2020.", "It ended in May 2021.", None]
    found = values(spark, dates.last_search, *texts)
    assert [x and (x["first"], x["last"], x["text"]) for x in found] == [(D(2021, 9, 1), D(2021, 9, 30), "Sept. 2021"), (None, D(2021, 5, 31), "until May 2021"), (D(2019, 1, 1), D(2021, 12, 31), "2019 to 2021"), None, None]


LITERALS = [
    [{"name": "O'Brien", "n": 1, "ok": True, "gone": None}],
    [{"name": 'say "None" or True'}, {"name": "NaN's"}],
    [{"name": "both ' and \" here"}],
    [{"name": "back\\slash", "other": "tab\tend\n"}],
    [{"name": ""}, {"name": "'"}, {"name": '"'}],
    [{"name": "x" * 50_000 + "'"}],
    {"Trueish": False, "None_": "é"},
]


def test_literals_come_through(spark):
    found = values(spark, text.repair_json, *(repr(x) for x in LITERALS))
    assert [json.loads(x) for x in found] == LITERALS == [ast.literal_eval(repr(x)) for x in LITERALS]
    assert values(spark, lambda c: text.literal_field(c, "name"), "[{'name': \"O'Brien\"}, {'name': 'Li'}]", "no literal", "['", None) == ["O'Brien, Li", None, None, None]
