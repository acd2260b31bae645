import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalume.operators import appraisal, filters, ingest, mining, qa, retrieval, spans, tagging, writes
from catalume.sources import files, html
from catalume.streaming import batches


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_first_seen_keeps_blank_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, ""), (5, None)], "i int, k string")
    first, later = ingest.first_seen(df, F.col("k"), ["i"])
    assert [r[0] for r in rows(first, "i")] == [1, 3, 4, 5] and [r[0] for r in rows(later)] == [2]
    assert [r[0] for r in rows(ingest.duplicated(spark.createDataFrame([(1, "v1"), (2, "v1"), (3, "v2"), (4, ""), (5, "")], "i int, k string"), "k").select("i"))] == [1, 2]


def test_types(spark):
    df = spark.createDataFrame([("1", "1.5", "x", "", "7"), ("9999999999", "2", "1", None, "8")], "a string, b string, c string, d string, verification_id string")
    kinds = [f.dataType for f in ingest.infer_types(df)]
    assert kinds == [T.LongType(), T.DoubleType(), T.StringType(), T.StringType(), T.StringType()]


def test_region(spark):
    df = spark.createDataFrame([(1, "USA"), (2, "france"), (3, None)], "i int, country string")
    regions = spark.createDataFrame([("United States", "Americas"), ("France", "Europe")], "country string, region string")
    assert [r["region"] for r in ingest.with_region(df, regions).orderBy("i").collect()] == ["Americas", "Europe", "Unknown"]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "v1", "10.1/a", "10.1/a", "2015", "old"), (2, "v2", "10.1/b", "10.1/b", "2015", "old")], "primary_id int, verification_id string, cleaned_doi string, doi string, year string, title string")
    new = spark.createDataFrame([(1, "v1", "10.1/z", "2016", "by id"), (2, "v9", "10.1/B", "2016", "by doi"), (3, None, "10.1/c", "2016", "new"), (4, "v8", "10.1/C", "2017", "newer"), (5, "v7", "10.1/d", "2009", "old year"), (6, "v6", "", "2015", "no doi")], "o int, verification_id string, doi string, year string, title string")
    out = writes.upsert_papers(old, new, "o")
    assert rows(out.select("primary_id", "title")) == [(1, "by id"), (2, "by doi"), (3, "newer")]


def test_create_or_update(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    assert rows(writes.first_or_create(df, {"id": 1}, {"v": "x"})) == [(1, "a")]
    assert rows(writes.first_or_create(df, {"id": 2}, {"v": "x"})) == [(1, "a"), (2, "x")]
    assert rows(writes.update_or_create(df, {"id": 1}, {"v": "x"})) == [(1, "x")]
    assert rows(writes.delete_where(spark.createDataFrame([(1, None), (2, 3)], "id int, v int"), F.col("v") > 1)) == [(1, None)]


def test_ages_and_participants(spark):
    df = spark.createDataFrame([("aged 10-17 years and less than 5 years, ages 0 to 1; 20 to 30 yrs; 1,234 children (boys=600, girls=634)",)], "t string")
    row = df.select(tagging.age_ranges(F.col("t")).alias("a"), tagging.participants(F.col("t"), ["children", "adults"]).alias("p")).first()
    assert {(a["low"], a["high"], a["operator"]) for a in row["a"]} == {(10, 17, "="), (0, 5, "<"), (0, 1, "="), (20, 30, "=")}
    assert [(p["indicator"], p["n"], p["types"]) for p in row["p"]] == [("children", 1234, "boys=600, girls=634")]
    assert df.select(tagging.participant_types(F.lit("boys=600, girls=634")).alias("m")).first()["m"] == {"boys": 600, "girls": 634}


def test_study_and_country_counts(spark):
    df = spark.createDataFrame([(1, "We included 67 studies: twenty-five RCTs, 3 cohort studies and 2 RCTs. From China (12), Kenya (n = 3) and 4 trials from Kenya.")], "id int, t string")
    assert rows(tagging.study_counts(df, "id", "t", {"RCTs": "rct", "cohort studies": "cohort"})) == [(1, "cohort", 3), (1, "rct", 27)]
    assert rows(tagging.country_counts(df, "id", "t", ["China", "Kenya"])) == [(1, "China", 12), (1, "Kenya", 7)]
    assert df.select(tagging.study_total(F.col("t"))).first()[0] == 67


def test_terms_are_escaped(spark):
    df = spark.createDataFrame([(1, "this or that"), (2, "odds ratio (OR) of 2"), (3, None)], "doc_id int, text string")
    taxonomy = [("topic", "x", "or", "odds ratio", "or")]
    assert rows(tagging.tag_terms(df, taxonomy).select("doc_id", "code")) == [(2, "or")]


def test_headings(spark):
    df = spark.createDataFrame([(1, "intro\nMETHODS\nwe did\nRESULTS\nwe saw\nmore")], "id int, t string")
    out = tagging.headed_sections(df, "id", "t", {"method": "methods", "result": "results"})
    assert rows(out) == [(1, "methods", "we did"), (1, "results", "we saw\nmore")]


@pytest.mark.parametrize("no,wanted", [((), "High"), ((1, 3), "Moderate"), ((2,), "Low"), ((2, 4), "Critically Low")])
def test_label(spark, no, wanted):
    answers = {i: F.lit("NO" if i in no else "Partial Yes" if i == 5 else "Yes") for i in range(1, 17)}
    name, flaws, met = appraisal.label(answers)
    row = spark.range(1).select(name.alias("n"), flaws.alias("f"), met.alias("m")).first()
    assert row["n"] == wanted and set(row["f"]) == set(no) and 5 not in row["m"]


def test_appraisal_items(spark):
    text = "PROSPERO CRD42012345. Searched MEDLINE and Embase; search strategy described; no restrictions. Randomized controlled trial, RoB 2, Table 2, each study."
    row = appraisal.appraise(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert row[0]["item_2"] == "Yes" and row[0]["item_4"] == "Partial Yes" and row[0]["item_9"] == "Yes" and row[0]["item_11"] == "Not applicable"
    assert row[1]["item_1"] == "No" and row[1]["amstar_label"] == "Critically Low"


def test_spans(spark):
    df = spark.createDataFrame([([(0, 5, "A"), (3, 10, "B"), (10, 12, "A"), (0, 5, "A")],)], f"s {spans.SPANS}")
    row = df.select(spans.keep_first(F.col("s")).alias("f"), spans.keep_longest(F.col("s")).alias("l"), spans.dedupe(F.col("s")).alias("d")).first()
    assert [tuple(x) for x in row["f"]] == [(0, 5, "A"), (10, 12, "A")]
    assert [tuple(x) for x in row["l"]] == [(3, 10, "B"), (10, 12, "A")]
    assert len(row["d"]) == 3
    text = spark.createDataFrame([("one 12 and 12 here near hint",)], "t string")
    assert text.select(spans.best_occurrence(F.col("t"), F.lit("12"), ["hint"], 15)).first()[0] == 11
    assert [tuple(x) for x in text.select(spans.regex_spans(F.col("t"), {"N": r"\d+"})).first()[0]] == [(4, 6, "N"), (11, 13, "N")]


def test_metrics(spark):
    gold = spark.createDataFrame([(1, 0, 5), (1, 7, 9)], "d int, s int, e int")
    row = spans.entity_metrics(gold, gold.where("s = 0"), ["d", "s", "e"]).first()
    assert (row["precision"], row["recall"]) == (1.0, 0.5)
    f1 = lambda a, b: spark.range(1).select(qa.token_f1(F.lit(a), F.lit(b))).first()[0]
    assert f1("the red cat", "red cat") == 1.0 and f1("x", "y") == 0.0 and abs(f1("a b c", "b d") - 0.5) < 1e-9
    ranked = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True)], "query int, rank int, r boolean")
    assert dict(rows(retrieval.average_precision(ranked, F.col("r"), (1, 3)))) == {1: 1.0, 3: round((1 + 2 / 3) / 2, 6)}


def test_qa(spark):
    docs = spark.createDataFrame([(1, "Intro here. The dose was 5 mg daily. End.")], "doc_id int, text string")
    found = docs.withColumns({"start": F.lit(25), "end": F.lit(29), "label": F.lit("DOSE")})
    row = qa.squad_examples(found, {"DOSE": "What dose?"}).first()
    assert row["answers"]["text"] == ["5 mg"] and row["context"][row["answers"]["answer_start"][0] :][:4] == "5 mg"
    assert rows(qa.unanswerable(docs, found, {"DOSE": "What dose?", "AGE": "What age?"})) == [(1, "What age?")]


def test_mining(spark):
    docs = spark.createDataFrame([(1, "We found 12 trials. Nothing else.")], "doc_id int, text string")
    row = mining.mine(docs, {"n": (r"\d+ trials", ["how many?"])}).first()
    assert (row["query"], row["positive"]) == ("how many?", "We found 12 trials.") and "Nothing else." in row["negatives"]
    assert docs.select(mining.verbalise_first(F.col("text"))).first()[0].startswith("We found twelve trials")


def test_filter_trees(spark):
    tree = {"topic": {"vpd": {"flu": {"display": "Influenza", "synonyms": ["grippe:flu"]}}}}
    tags = filters.tree_frame(spark, tree)
    assert filters.search_tags(tags, "GRIP").count() == 1
    assert filters.expand_synonym(tags, "grippe").first()["code"] == "flu"
    more = filters.tree_frame(spark, {"topic": {"vpd": {"flu": {"synonyms": ["flu:flu"]}, "hpv": {"display": "HPV"}}}})
    assert [r["synonyms"] for r in filters.merge_trees(tags, more).orderBy("code").collect()] == [["flu:flu", "grippe:flu"], []]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    assert rows(files.text_corpus(spark, str(tmp_path))) == [("a", "hello\nworld")]
    paths = spark.createDataFrame([("/d/merged_2024-01-02.csv",), ("/d/merged_2024-03-01.csv",), ("/d/x_7.csv",)], "path string")
    assert files.latest_file(paths, "merged_", ".csv").first()[0] == "/d/merged_2024-03-01.csv" and files.resume_page(paths).first()[0] == 7
    df = spark.createDataFrame([(1, 'a "q"\nb')], "i int, t string")
    files.export(df, str(tmp_path / "csv"))
    with pytest.raises(LookupError):
        files.export(df.where("i > 1"), str(tmp_path / "none"))
    page = spark.createDataFrame([("<h2>One</h2><p>a</p><h3>Two</h3>b<table><tr><th>x</th><td>1</td></tr></table>",)], "html string")
    row = page.select(html.headings(F.col("html")).alias("h"), html.tables(F.col("html")).alias("t")).first()
    assert [(h["title"], h["body"]) for h in row["h"]][0] == ("One", "a") and row["t"] == ["x\t1"]


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    df.write.parquet(f"{source}")
    for _ in range(2):  # a second run finds nothing new
        q = batches.process_new_files(spark, source, df.schema, out, str(tmp_path / "cp"), lambda d: d.withColumn("w", F.upper("v")))
        q.awaitTermination(60)
    assert rows(spark.read.parquet(out).select("id", "w")) == [(1, "A"), (2, "B")] and batches.status(q) == "SUCCESS"
    tracker = spark.createDataFrame([("s", [1], [2, 3])], "source_name string, processed_ids array<bigint>, failed_ids array<bigint>")
    done = spark.createDataFrame([("s", [2], [4])], "source_name string, processed array<bigint>, failed array<bigint>")
    assert rows(batches.update_tracker(tracker, done)) == [("s", [1, 2], [3, 4], 2)]
