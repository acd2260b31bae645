"""Facts, slot rules and pieces of texts on nulls, empty texts and ties."""

import json

import pytest
from pyspark.sql import functions as F

from catalume.operators import facts, ingest, mining, spans


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_treatment_without_text(spark):
    none, empty, many = values(spark, facts.treatment, None, "", "; ".join(f"{i} mg for {i} weeks" for i in range(1, 9)))
    assert none["doses"] is None
    assert empty.asDict() == {"durations": [], "doses": [], "schedules": [], "comparators": []}
    assert many["doses"] == [f"{i} mg" for i in range(1, 6)] and many["durations"] == ["1 weeks", "2 weeks", "3 weeks"]


def test_title_first_place_of_list(spark):
    (found,) = values(spark, lambda t: facts.title_metadata(t, F.lit(None).cast("string"), ["Peru", "Kenya"], ["flu"]), "Flu in Kenya and Peru")
    assert found["location"] == "Peru" and found["topic"] == ["flu"] and found["num_databases"] == 0 and found["dosage"] == ""


def test_prune_keeps_filled_facts(spark):
    (found,) = values(spark, lambda t: facts.prune({"n": F.lit(3), "zero": F.lit(0), "text": t, "null": F.lit(None).cast("string"), "list": F.array(t)}), 'a"b')
    assert found == {"n": "3", "text": '"a\\"b"', "list": '["a\\"b"]'}


def pieces(text, size, overlap, within):
    out, i = [], 0
    while True:
        j = min(len(text), i + size)
        k = text.rfind("\n", i, j)
        if j < len(text) and k != -1 and j - k < within:
            j = k
        out.append((i, j, text[i:j]))
        if j == len(text):
            return out
        i = j - overlap


def test_line_chunks_against_a_loop(spark):
    texts = ["", "a", "x" * 100, "x" * 101, "\n" * 250, "ab\n" * 200, ("x" * 59 + "\n") * 9, ("é" * 61 + "\n") * 9, "x" * 99 + "\n" + "y" * 300 + "\n"]
    found = values(spark, lambda t: spans.line_chunks(t, 100, 10, 40), None, *texts)
    assert found[0] is None
    assert [[tuple(c) for c in cs] for cs in found[1:]] == [pieces(t, 100, 10, 40) for t in texts]
    with pytest.raises(ValueError):
        spans.line_chunks(F.lit("a"), 100, 60, 40)


def test_decoys_are_no_positives(spark):
    rules = mining.slot_rules({"studies": ["how many?"], "design_rct": ["which?"]}, {}, {}, {})
    docs = spark.createDataFrame([(1, "Nine RCTs were included.\nWe screened nine RCTs."), (2, None), (3, "")], "doc_id int, text string")
    found = {(r["slot"], r["positive"]): r["negatives"] for r in mining.mine(docs, rules).collect()}
    assert found == {("design_rct", "Nine RCTs were included."): ["We screened nine RCTs."]}


def test_bags_of_odd_texts(spark):
    """Null texts give nulls, empty ones empty tags; marks of JSON and characters outside ASCII come through."""
    df = spark.createDataFrame([(1, None), (2, ""), (3, 'é "adults" ü')], "k int, t string")
    found = {r["k"]: r for r in spans.with_bags(df, "t", {"age": "adults"}, {}, 3).collect()}
    assert found[1]["age_tags"] is None and found[1]["age_bag"] is None
    assert (found[2]["age_tags"], found[2]["age_bag"]) == ("", "[]")
    assert json.loads(found[3]["age_bag"]) == [{"Matched Content": "adults", "Text Before": 'é "', "Text After": '" ü'}]
    assert spans.with_bags(df, "t", {"age": "adults"}, {"age": {"adults": "AD"}}).where("k = 3").first()["age_acronyms"] == "AD"


def test_medline_without_ids(spark):
    """Records without a PMID count as one, as the empty id; missing arrays are empty texts."""
    fields = "PMID string, TI string, AB string, DP string, JT string, PL string, AU array<string>, LA array<string>, MH array<string>, PT array<string>, AID array<string>, is_oa boolean, best_oa_url string, n int"
    rows = [(None, f"t{i}", None, None, None, None, None, ["English"], None, ["Meta-Analysis"], ["", " 10.1/a [doi]"], None, None, i) for i in (2, 1)]
    df = spark.createDataFrame(rows, fields)
    found = ingest.assemble_medline(df, "n").collect()
    assert [(r["pmid"], r["title"], r["authors"], r["doi"]) for r in found] == [("", "t1", "", "10.1/a")]
    assert ingest.assemble_medline(df.limit(0), "n").isEmpty() and ingest.assemble_medline(df, "n", open_only=True).isEmpty()
