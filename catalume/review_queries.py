"""Queries of the review miners, phrase tables and streams, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from .functions import dates, text
from .operators import facts, included, ingest, phrases, record, tagging
from .queries import query
from .sources import files
from .streaming import attempts, pages
from .text_queries import one, part


def scratch(t, label: str) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or a temporary one where that is unset (tests on one machine)."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='catalume-')}"
    return f"{shared.rstrip('/')}/catalume/{label}-{uuid.uuid4().hex}"


# Two totals that differ stand in each text. Every third text says `overall` of one and `in this review` of none; every third has its larger total among what was screened.
INCLUDED = """CASE p_partkey % 3
WHEN 0 THEN 'We screened ' || (p_size + 400) || ' articles. The final number of articles included in this review was ' || (p_size + 10) || ' representing ' || (p_size + 5) || ' unique studies. Then ' || (p_size + 90) || ' articles were included in this review, excluded later.'
WHEN 1 THEN (p_size + 70) || ' met inclusion criteria after some were removed. Of all, ' || (p_size + 20) || ' met inclusion criteria. We analysed ' || p_size || ' RCTs and thirty cohort studies from twelve countries.'
ELSE 'In total ' || (p_size + 1) || ' trials were synthesised. Excluded trials: ' || (p_size + 2) || ' trials were analysed.' END"""


@query("included_counts", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size + 10 WHEN 1 THEN p_size + 20 ELSE p_size + 1 END::BIGINT AS articles, CASE WHEN p_partkey % 3 = 0 THEN p_size + 5 ELSE 0 END::BIGINT AS studies,
CASE p_partkey % 3 WHEN 0 THEN p_size + 5 WHEN 1 THEN p_size + 20 ELSE p_size + 1 END::BIGINT AS total,
CASE WHEN p_partkey % 3 = 1 THEN round_even(p_size * ((p_size + 20)::DOUBLE / (p_size + 30)), 0) ELSE 0 END::BIGINT AS rct, CASE WHEN p_partkey % 3 = 1 THEN round_even(30 * ((p_size + 20)::DOUBLE / (p_size + 30)), 0) ELSE 0 END::BIGINT AS cohort,
CASE WHEN p_partkey % 3 = 1 THEN 12::BIGINT END AS countries, CASE p_partkey % 3 WHEN 0 THEN 'studies.final' WHEN 1 THEN 'studies.inclusion_criteria' ELSE 'studies.generic' END AS told FROM part""")
def _(t):
    v = one(t, included.included_counts, INCLUDED.replace("\n", " "), "v")
    return v.select("p_partkey", F.col("v.articles_included").alias("articles"), F.col("v.unique_studies").alias("studies"), "v.total", "v.rct", "v.cohort", F.col("v.num_countries_included").alias("countries"), F.get("v.evidence", F.lit(0))["field"].alias("told"))


@query("phrase_table", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS words FROM documents),
p AS (SELECT doc_id AS code, array_to_string(words[2:2 + doc_id % 3], ' ') AS phrase FROM w WHERE len(words) > 4), t AS (SELECT doc_id, ' ' || array_to_string(words, ' ') || ' ' AS text FROM w)
SELECT doc_id, code FROM t JOIN p ON contains(t.text, ' ' || phrase || ' ')""")
def _(t):
    docs = t.table("documents").select("doc_id", "text")
    ws = phrases.words(F.col("text"))
    table = docs.where(F.size(ws) > 4).select(F.array_join(F.slice(ws, F.lit(2), (F.col("doc_id") % 3 + 1).cast("int")), " ").alias("phrase"), F.col("doc_id").alias("code"))
    return phrases.tag_phrases(docs, table).select("doc_id", "code")


# names at a distance of p_size * 8 characters from a phrase of searching, which reaches 200; `large databases` is none
@query("databases_in_windows", """SELECT p_partkey, concat_ws('|', CASE WHEN 8 * p_size + 2 + 6 <= 200 THEN 'Embase' END, 'MEDLINE') AS value FROM part""")
def _(t):
    vocabulary = {"MEDLINE": ["MEDLINE via Ovid"], "PubMed": [], "Embase": ["EMBASE"]}
    found = one(t, lambda c: tagging.databases_searched(c, vocabulary), "'PubMed has large databases. ' || repeat('x', 400) || ' MEDLINE via Ovid was a data source used; we searched ' || repeat('y', 8 * p_size) || ' EMBASE.'".replace("a data source used", "among data sources used"))
    return found.select("p_partkey", F.array_join("value", "|").alias("value"))


@query("search_intervals", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN make_date(1951 + p_size, 1, 1) WHEN 2 THEN make_date(1950 + p_size, 5, 1) ELSE make_date(1950 + p_size, 3, 4) END AS first,
CASE p_partkey % 4 WHEN 0 THEN last_day(make_date(1950 + p_size, 2, 1)) WHEN 1 THEN make_date(1953 + p_size, 12, 31) WHEN 2 THEN make_date(1950 + p_size, 9, 30) ELSE make_date(1950 + p_size, 3, 4) END AS last FROM part""")
def _(t):
    year = "(1950 + p_size)"
    told = f"'Trials ran until May 2031. We searched ' || CASE p_partkey % 4 WHEN 0 THEN 'from inception to Feb. ' || {year} WHEN 1 THEN '(1951-' || (1953 + p_size) || '), ' || (1951 + p_size) || ' to ' || (1953 + p_size) WHEN 2 THEN 'between May and September ' || {year} ELSE 'on 4th March, ' || {year} || ' and on 31 June ' || {year} END || '. Later came 3 May 2040.'"
    return one(t, dates.last_search, told, "v").select("p_partkey", "v.first", "v.last")


@query("literal_names", "SELECT p_partkey, 'O''' || p_brand || ', say \"None\" or ' || p_size || ', it''s \"True\"' AS value FROM part")
def _(t):
    return one(t, lambda c: text.literal_field(c, "name"), r"""'[{\'name\': "O\'' || p_brand || '", \'n\': None}, {\'name\': \'say "None" or ' || p_size || '\', \'ok\': True}, {\'name\': \'it\\\'s "True"\'}]'""")


@query("nation_codes", "SELECT n_nationkey, CASE n_name WHEN 'NATION_3' THEN 404 ELSE 604 END AS id FROM nation WHERE n_name IN ('NATION_3', 'NATION_7')")
def _(t):
    return facts.with_codes(t.table("nation").select("n_nationkey", "n_name"), "n_name", {"NATION_3": 404, "NATION_7": 604, "NATION_404": 1}).select("n_nationkey", "id")


# one record a text; each third of the texts tells other facts
RECORD = """'We searched Embase until May 2021. The final number of articles included in this review was ' || (p_size + 10) || '.' || CASE p_partkey % 3
WHEN 0 THEN ' In total, ' || p_size || ' RCTs and 4 cohort studies were pooled.'
WHEN 1 THEN ' Awareness of HPV grew. Kenya (' || p_size || '), Mali (2) and Kenya (3) took part, as did China (n = 1,200).'
ELSE ' Adolescents aged 10 to ' || (p_size % 40 + 12) || ' years in Europe and nurses had 5 mg versus placebo.' END"""
WORDS = record.Vocabulary(
    topics={"kaa": ["knowledge", "awareness"]}, outcomes={"death": ["death", "mortality"]}, diseases={"hpv": ["HPV"]}, vaccine_options={"quad": ["quadrivalent"]}, age_groups={"ado_10__17": ["adolescents"]},
    specific_groups={"hcw": ["nurses"]}, immune_status={"low": ["immunocompromised"]}, regions=["Europe", "Asia"], databases={"MEDLINE": [], "Embase": []}, countries={"USA": "United States"}, short={"ado_10__17": "ado"},
)


@query("review_records", """WITH p AS (SELECT p_partkey, p_size AS s, p_partkey % 3 AS k, p_size % 40 + 12 AS old FROM part)
SELECT p_partkey, '{"lit_search_date":"until May 2021","articles":{"articles_included":' || (s + 10) || ',"unique_studies":0},"studies":{"total":' || (s + 10)
|| CASE k WHEN 0 THEN ',"rct":' || s || ',"cohort":4' ELSE ',"rct":0,"cohort":0' END || ',"case_control":0,"cross_sectional":0,"nrsi":0},'
|| CASE k WHEN 0 THEN '"design_counts":{"rct":' || s || ',"cohort":4},'
WHEN 1 THEN '"topics":{"kaa":1},"topics_terms":{"Awareness":"kaa"},"interventions":{"diseases":{"hpv":1}},"intervention_terms":{"HPV":"hpv"},"countries":{"study_counts":{"Kenya":' || (s + 3) || ',"Mali":2},"sample_sizes":{"China":1200}},'
ELSE '"age_groups":{"ado_10__17":1,"range_10_' || old || '":1},"age_group_terms":{"Adolescents":"ado","10–' || old || ' years":"' || CASE WHEN (10 + old) // 2 <= 17 THEN 'ado' ELSE 'adu' END || '"},"specific_groups":{"hcw":1},"specific_group_terms":{"nurses":"hcw"},"regions":["Europe"],' END
|| '"databases":{"num_databases":1,"database_list":["Embase"]}' || CASE WHEN k = 2 THEN ',"treatment":{"dosage":{"amounts":["5 mg"]},"comparator":["placebo"]}' ELSE '' END || '}' AS record,
CASE k WHEN 0 THEN 'lit_search_date,studies,studies,studies,designs,designs,databases' WHEN 1 THEN 'lit_search_date,studies,countries,countries,countries,countries,topics,interventions,databases' ELSE 'lit_search_date,studies,ages,ages,ages,databases,treatment' END AS told,
CASE k WHEN 0 THEN 0.28 WHEN 1 THEN 0.5 ELSE 0.56 END::DOUBLE AS confidence FROM p""")
def _(t):
    found = record.assemble(part(t, t=RECORD.replace("\n", " ")), WORDS, "p_partkey", "t")
    return found.select("p_partkey", F.to_json("record").alias("record"), F.array_join(F.transform("evidence", lambda e: e["field"]), ",").alias("told"), "confidence")


# files: rows are written and read again, names are made from the tables
@query("csv_round_trip", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_md5, length(text)::VARCHAR AS size, lang, source FROM documents")
def _(t):
    """Texts with quotes, commas, line breaks and spaces at their ends come back as they were."""
    place = scratch(t, "csv")
    files.export(t.table("documents").select("doc_id", "text", "lang", "source"), place)
    return ingest.read_csv(t.spark, place).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("string").alias("size"), "lang", "source")


@query("jsonl_resume", "SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0")
def _(t):
    place = scratch(t, "jsonl")
    docs = t.table("documents").select("doc_id", "lang")
    files.export(docs.where("doc_id % 3 = 0"), place, "json")
    return files.not_done(docs, files.read_jsonl(t.spark, place, "doc_id long, lang string"))


@query("newest_named_file", "SELECT '/in/unified_' || strftime(max(o_orderdate) FILTER (o_orderkey % 5 <> 0), '%Y-%m-%d') || '.csv' AS path FROM orders")
def _(t):
    """Names with another beginning, or with a day that is none, don't count."""
    name = "CASE o_orderkey % 5 WHEN 0 THEN '/in/other_' ELSE '/in/unified_' END || CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN '2099-13-40' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END || '.csv'"
    return files.latest_file(t.table("orders").selectExpr(f"{name} AS path"), "unified_", ".csv")


@query("resume_page", "SELECT max(page_id)::INTEGER AS page FROM pages WHERE page_id % 7 <> 0")
def _(t):
    return files.resume_page(t.table("pages").selectExpr("'/in/love_' || page_id || CASE WHEN page_id % 7 = 0 THEN '.json' ELSE '.csv' END AS path"))


@query("retrieval_rows", "SELECT trim(p_brand) AS query, p_name AS positive, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS negatives FROM part WHERE p_partkey % 4 <> 0")
def _(t):
    rows = part(t, query="' ' || p_brand || ' '", positive="CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE p_name || ' ' END", negatives="CASE WHEN p_size % 2 = 0 THEN array('  ', ' ' || p_type) END")
    return files.retrieval_rows(rows).select("query", "positive", F.array_join("negatives", "|").alias("negatives"))


# streams
@query("pages_fetched", "SELECT event_id // 500 + 1 AS page, count(*) AS n, min(event_id) AS first, max(event_id) AS last, count(DISTINCT event_id) AS different FROM events GROUP BY 1")
def _(t):
    """Half of the pages are there when the stream first runs; it is stopped, and started again when all are."""
    place = scratch(t, "pages")
    rows = t.table("events").select((F.floor(F.col("event_id") / 500) + 1).cast("long").alias("page"), "event_id", "event_type", "value")
    half = (rows.agg(F.max("page")).first()[0] or 0) // 2
    for some in (rows.where(F.col("page") <= half), rows.where(F.col("page") > half)):
        some.repartition("page").write.mode("append").partitionBy("page").json(f"{place}/in")
        pages.fetch_pages(t.spark, f"{place}/in", "event_id long, event_type string, value double", f"{place}/out", f"{place}/checkpoint", pattern="page={page}").awaitTermination()
    found = t.spark.read.schema("event_id long, event_type string, value double").parquet(f"{place}/out")
    return found.groupBy((F.floor(F.col("event_id") / 500) + 1).cast("long").alias("page")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count_distinct("event_id").alias("different"))


@query("attempts_tracked", """WITH r AS (SELECT event_type AS source, user_id AS id, value < 15 AS ok, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT source, id, min(n) FILTER (ok) AS good, max(n) AS tries FROM r WHERE n <= 3 GROUP BY ALL)
SELECT source, id, coalesce(good, tries)::INTEGER AS tries, CASE WHEN good IS NOT NULL THEN 'done' WHEN tries >= 3 THEN 'given_up' ELSE 'retry' END AS status FROM f""")
def _(t):
    """Each event is an attempt on its user; the events come as two halves, the second after a restart."""
    place = scratch(t, "attempts")
    rows = t.table("events").select(F.col("event_type").alias("source"), F.col("user_id").alias("id"), F.col("event_id").alias("at"), (F.col("value") < 15).alias("ok"))
    half = (rows.agg(F.max("at")).first()[0] or 0) // 2
    for some in (rows.where(F.col("at") <= half), rows.where(F.col("at") > half)):
        some.write.mode("append").parquet(f"{place}/in")
        attempts.run(t.spark.readStream.schema(rows.schema).parquet(f"{place}/in"), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return attempts.latest(t.spark.read.parquet(f"{place}/out"))


def _date_sql() -> str:
    month = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    pattern = rf"(?i)\b(?:\d{{1,2}}(?:st|nd|rd|th)?\s+{month},?\s+\d{{4}}|{month}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|{month},?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})\b"
    plain = r"regexp_replace(regexp_replace(x, '(\d)(st|nd|rd|th)\b', '\1', 'g'), ',\s*', ' ', 'g')"
    return f"""SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(text, '{pattern}'),
lambda x: {{'d': try_strptime({plain}, ['%d %B %Y', '%B %d %Y', '%B %Y', '%Y-%m-%d'])::DATE, 'x': x}}), lambda s: s.d IS NOT NULL)).x AS latest
FROM (SELECT doc_id, text || ' by 3 May ' || (1990 + doc_id % 30) || ', 2019-13-01 or June 1st, ' || (1995 + doc_id % 7) AS text FROM documents)"""


@query("document_dates", _date_sql())
def _(t):
    dated = F.concat("text", F.lit(" by 3 May "), 1990 + F.col("doc_id") % 30, F.lit(", 2019-13-01 or June 1st, "), 1995 + F.col("doc_id") % 7)
    return t.table("documents").select("doc_id", dates.latest_of(dates.date_mentions(dated)).alias("latest"))
