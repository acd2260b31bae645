"""The assembled record against plain Python on random sentences, and on empty, null, repeated and long texts."""

import random
import re

from pyspark.sql import functions as F

from catalume.operators import included, record

WORDS = {"a": ["red fox", "red"], "b": ["Blue"], "c": ["gr.en", "x-ray"]}
SHORT = {"a": "A"}


def by_hand(text):
    """Counts of sentences by code and first phrases with their short codes."""
    counts, terms = {}, {}
    for s in filter(None, (p.strip() for p in re.split(r"(?<=[.?!])\s+", text))):
        for code, phrases in WORDS.items():
            for p in phrases:
                if m := re.search(rf"\b{re.escape(p)}\b", s, re.I):
                    counts[code] = counts.get(code, 0) + 1
                    terms.setdefault(m[0], SHORT.get(code, code))
                    break
    return counts, terms


def test_counts_and_terms_equal_plain_python(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["red", "RED fox", "reds", "blue", "Blue", "gr.en", "green", "X-ray", "sky.", "sea!", "so?"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in record.assemble(df, record.Vocabulary(topics=WORDS, short=SHORT)).select("doc_id", "record.topics", "record.topics_terms").collect()}
    for i, text in enumerate(texts):
        counts, terms = by_hand(text)
        assert (found[i].topics or {}) == counts and (found[i].topics_terms or {}) == terms, text


def test_empty_null_repeated_and_extra_columns(spark):
    rows = [(1, "", "x"), (2, None, None), (None, "We tried RCTs.", "y"), (None, "We tried RCTs.", "y"), (3, "word " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, record string")
    found = [(r.doc_id, r.j, r.evidence, r.confidence) for r in record.assemble(df, record.Vocabulary()).select("doc_id", F.to_json("record").alias("j"), "evidence", "confidence").collect()]
    designs = (None, '{"design_counts":{"rct":1}}', [("designs", "We tried RCTs.")], 0.06)
    assert sorted(map(str, found)) == sorted(map(str, [(i, "{}", [], 0.0) for i in (1, 2, 3)] + [(*designs[:2], [record_row(*e) for e in designs[2]], designs[3])] * 2))
    assert record.assemble(df.limit(0), record.Vocabulary()).count() == 0


def record_row(field, text):
    from pyspark.sql import Row

    return Row(field=field, text=text)


def test_numbers_before_designs_and_greatest_samples(spark):
    text = "We pooled twenty one cohort studies. One RCT and 1,200 case-control studies, observational studies too. Peru had 20 participants. There were 30 subjects in the Peru. Peru (n = 25). Mali (2), Mali (3) and USA (9)."
    got = record.assemble(spark.createDataFrame([(1, text)], "doc_id long, text string"), record.Vocabulary(countries={"USA": "United States"})).first().record
    assert got.design_counts == {"cohort": 21, "rct": 1, "case_control": 1200, "nrsi": 1}
    assert got.countries.sample_sizes == {"Peru": 30} and list(got.countries.study_counts.items()) == [("United States", 9), ("Mali", 5)]


def test_terms_and_evidence_are_capped(spark):
    text = " ".join(f"Aged {i % 90 + 1} to {i % 97 + 1} years." for i in range(2000))
    got = record.assemble(spark.createDataFrame([(1, text)], "doc_id long, text string"), record.Vocabulary()).first()
    assert len(got.record.age_group_terms) == record.MOST_TERMS and sum(got.record.age_groups.values()) == 2000
    assert len(got.evidence) == record.CAPS["ages"]


def test_long_clauses_without_numbers_take_time_by_their_length(spark):
    """Texts of letters alone with a word of the rules were tried from each place before their nouns were looked for."""
    text = "among many included words " * 4000 + "."
    assert spark.createDataFrame([(text,)], "t string").select(included.included_counts(F.col("t")).alias("v")).first().v.total == 0
