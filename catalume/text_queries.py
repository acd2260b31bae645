"""Queries over texts that are written from the test tables' columns, so that SQL can state each operator's result from the columns alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import dates, identifiers, numbers, tags, text
from .operators import appraisal, facts, filters, ingest, mining, qa, retrieval, spans, stats, tagging, writes
from .plans import payload
from .plans import predicates as P
from .plans.query import Query
from .queries import ORACLE_SQL, RECORDS, query
from .sources import files, html
from .streaming import batches

PART = "__hash__"


def part(t, /, **columns: str) -> DataFrame:
    """p_partkey and columns by Spark SQL over `part`."""
    return t.table("part").selectExpr("p_partkey", *(f"{e} AS {c}" for c, e in columns.items()))


def one(t, column, sql: str, name: str = "value") -> DataFrame:
    """p_partkey and ``column`` of a text written by Spark SQL."""
    return part(t, t=sql).select("p_partkey", column(F.col("t")).alias(name))


# identifiers
DOI = "CASE WHEN p_partkey % 3 = 0 THEN 'no number' ELSE 'see DOI:10.' || (1000 + p_partkey % 9000) || '/X.' || p_size || '; p. 3' END"


@query("extract_doi", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN '10.' || (1000 + p_partkey % 9000) || '/X.' || p_size || ';' END AS value FROM part")
def _(t):
    return one(t, identifiers.extract_doi, DOI)


@query("doi_in_path", "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN '10.1002/14651858.CD' || p_partkey END AS value FROM part")
def _(t):
    return one(t, identifiers.doi_in_path, "'/cdsr/doi/10.1002/14651858.CD' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '/abstract' WHEN 1 THEN '/full' ELSE '.pub2/full/de' END")


@query("doi_list", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '10.1/' || p_size WHEN 1 THEN '10.2/' || p_size || '|10.3/b' ELSE '' END AS value FROM part")
def _(t):
    return one(t, lambda c: F.array_join(identifiers.doi_list(c), "|"), "CASE p_partkey % 3 WHEN 0 THEN ' 10.1/' || p_size WHEN 1 THEN '[\\'10.2/' || p_size || ' [doi]\\', \\'10.3/b [doi]\\', \\'S1 [pii]\\']' ELSE ' ' END")


@query("doi_url", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'http://a.org/' || p_size WHEN 1 THEN 'https://doi.org/10.1/' || p_size END AS value FROM part")
def _(t):
    return one(t, identifiers.doi_url, "CASE p_partkey % 3 WHEN 0 THEN 'http://a.org/' || p_size WHEN 1 THEN ' 10.1/' || p_size ELSE ' ' END")


# cells and names
@query("literal_list", "SELECT p_partkey, replace(p_name, ' ', '|') AS value FROM part")
def _(t):
    return one(t, lambda c: F.array_join(text.literal_list(c), "|"), "'[\\'' || replace(p_name, ' ', '\\', \\'') || '\\']'")


FLAGS = "'{\\'red\\': ' || CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END || ', \"blue\": ' || CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'False' END || '}'"


@query("set_flags", "SELECT p_partkey, concat_ws('|', CASE WHEN p_size % 2 = 0 THEN 'red' END, CASE WHEN p_size % 3 = 0 THEN 'blue' END) AS value FROM part")
def _(t):
    return one(t, lambda c: F.array_join(text.set_flags(c), "|"), FLAGS)


@query("flag_filter", "SELECT p_partkey FROM part WHERE p_size % 2 = 0")
def _(t):
    return P.apply_tree(part(t, cell=FLAGS), {"field": "cell", "operator": "has_flag", "value": "red"}).select("p_partkey")


@query("display_name", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS value FROM part")
def _(t):
    return one(t, text.display_name, "replace(p_name, ' ', '_')")


@query("column_name", "SELECT p_partkey, CASE WHEN length(n) > 63 THEN left(n, 54) || '_' || left(md5(n), 8) ELSE n END AS value FROM (SELECT p_partkey, regexp_replace(lower(repeat(p_name || ' / ', p_size)), '[^a-z0-9]+', '_', 'g') AS n FROM part)")
def _(t):
    return one(t, text.column_name, "repeat(p_name || ' / ', p_size)")


@query("squeeze", "SELECT p_partkey, p_name AS value FROM part")
def _(t):
    return one(t, text.squeeze, "'  ' || replace(p_name, ' ', '\\n \\t') || ' '")


@query("clean_characters", "SELECT p_partkey, p_name || '-' || p_size || ' \"x\" end' AS value FROM part")
def _(t):
    return one(t, text.clean_characters, "p_name || '–' || p_size || ' “x” ~ https://a.org/' || p_size || ' @end'")


@query("strip_heading_number", "SELECT p_partkey, p_name || chr(10) || p_size || ' 2' AS value FROM part")
def _(t):
    return one(t, text.strip_heading_number, "p_size || '.2. ' || p_name || '\\n' || p_size || ' 2'")


@query("normal_lines", "SELECT p_partkey, 'a' || chr(10) || chr(10) || p_name || chr(10) || 'b' AS value FROM part")
def _(t):
    return one(t, text.normal_lines, "'a\\r\\n\\n\\r\\n\\n' || p_name || '\\rb'")


@query("context_window_of_match", "SELECT p_partkey, right(repeat('x', p_size), 5) || 'KEY' || left(repeat('y', p_size), 5) AS value FROM part")
def _(t):
    return one(t, lambda c: text.context(c, F.instr(c, "KEY"), F.lit(3), 5), "repeat('x', p_size) || 'KEY' || repeat('y', p_size)")


@query("replace_items", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'red' THEN 'R' WHEN 'blue' THEN 'B' ELSE w END), ', ') AS value FROM part")
def _(t):
    return one(t, lambda c: text.replace_items(c, {"red": "R", "blue": "B"}), "replace(p_name, ' ', ' , ')")


@query("repair_json", "SELECT p_partkey, p_size AS size, p_size % 2 = 0 AS even, p_name AS name FROM part")
def _(t):
    row = F.from_json(text.repair_json(F.col("t")), "size int, even boolean, name string, gone string")
    return part(t, t="'{\\'size\\': ' || p_size || ', \\'even\\': ' || CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END || ', \\'name\\': \\'' || p_name || '\\', \\'gone\\': None}'").select("p_partkey", row.alias("r")).select("p_partkey", "r.size", "r.even", "r.name")


@query("literal_field", "SELECT p_partkey, p_brand || ', ' || p_size AS value FROM part")
def _(t):
    return one(t, lambda c: text.literal_field(c, "name"), "'[{\\'name\\': \\'' || p_brand || '\\'}, {\\'name\\': \\'' || p_size || '\\'}, {\\'other\\': None}]'")


@query("split_camel", "SELECT p_partkey, 'Date Of' || p_size || ' Entry' AS value FROM part")
def _(t):
    return one(t, text.split_camel, "'DateOf' || p_size || 'Entry'")


@query("plain_hyphens", "SELECT p_partkey, 'type ' || p_size || '-a -' || p_size AS value FROM part")
def _(t):
    return one(t, text.plain_hyphens, "'type-' || p_size || '-a -' || p_size")


@query("answer_normal", "SELECT p_partkey, lower(p_name) || ' ' || p_size || '% 1.5' AS value FROM part")
def _(t):
    return one(t, text.answer_normal, "'The ' || upper(p_name) || ', an ' || p_size || '%! (1.5)'")


@query("prune_map", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a=1,b=' ELSE 'b=' END AS value FROM part")
def _(t):
    m = F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.when(F.col("p_size") % 2 == 0, "1"), F.lit(""), F.lit(None).cast("string")))
    return t.table("part").select("p_partkey", F.array_join(F.transform(F.map_entries(text.prune(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("value"))


@query("notes_as_arrays", "SELECT p_partkey, replace(p_name, ' ', '|') AS value FROM part")
def _(t):
    rows = tags.notes_as_arrays(part(t, notes="replace(p_name, ' ', ', ') || ', '"))
    return rows.select("p_partkey", F.array_join("notes", "|").alias("value"))


# numbers and dates
@query("comma_int", "SELECT p_partkey, CAST(p_partkey * 1000 + 7 AS BIGINT) AS value FROM part")
def _(t):
    return one(t, numbers.comma_int, "'about ' || format_number(p_partkey * 1000 + 7, 0) || ' of 9'")


@query("year_of", "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE 1990 + p_size END AS value FROM part")
def _(t):
    return one(t, numbers.year_of, "CASE p_partkey % 4 WHEN 0 THEN ' ' || (1990 + p_size) WHEN 1 THEN (1990 + p_size) || '.0' WHEN 2 THEN (1990 + p_size) || ' Mar' ELSE 'n/a' END")


@query("quotient", "SELECT p_partkey, CAST(p_partkey // 7 AS BIGINT) AS quotient, p_partkey % 7 AS remainder FROM part")
def _(t):
    return t.table("part").select("p_partkey", numbers.quotient(F.col("p_partkey"), 7).alias("q")).select("p_partkey", "q.*")


BELOW_100 = "CASE WHEN {n} < 20 THEN {units}[{n} + 1] ELSE {tens}[{n} // 10 - 1] || CASE WHEN {n} % 10 > 0 THEN '-' || {units}[{n} % 10 + 1] ELSE '' END END"
WORDS_SQL = f"""SELECT p_partkey, CASE WHEN p_partkey = 0 THEN 'zero' ELSE words END AS words, p_partkey AS back FROM (SELECT p_partkey, trim(
  CASE WHEN p_partkey >= 1000 THEN {{thousands}} || ' thousand ' ELSE '' END
  || CASE WHEN p_partkey % 1000 >= 100 THEN {{units}}[p_partkey % 1000 // 100 + 1] || ' hundred ' ELSE '' END
  || CASE WHEN p_partkey % 100 > 0 THEN {BELOW_100} ELSE '' END) AS words FROM part)"""
_LISTS = {"units": str(numbers.UNITS), "tens": str(numbers.TENS)}
WORDS_SQL = WORDS_SQL.replace("{thousands}", BELOW_100.format(n="(p_partkey // 1000)", **_LISTS)).replace("{n}", "(p_partkey % 100)").replace("{units}", _LISTS["units"]).replace("{tens}", _LISTS["tens"])
#: For keys below 100,000.
ORACLE_SQL["number_words"] = WORDS_SQL


@query("month_number", "SELECT o_orderkey, month(o_orderdate)::INT AS month FROM orders")
def _(t):
    return t.table("orders").select("o_orderkey", dates.month_number(F.date_format("o_orderdate", "MMMM")).alias("month"))


@query("reformat_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders")
def _(t):
    return t.table("orders").select("o_orderkey", dates.reformat_date(F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))).alias("value"))


@query("latest_date", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 40 DAY, '%B %-d, %Y') AS latest FROM orders")
def _(t):
    shown = F.concat(F.lit("Searched on "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(", again "), F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS"), "MMMM d, yyyy"), F.lit(" and 1990-01-02."))
    return t.table("orders").select("o_orderkey", dates.latest_of(dates.date_mentions(shown)).alias("latest"))


# sections and facts in texts
@query("combined_sections", "SELECT p_partkey, p_name || ' ' || p_type AS value FROM part")
def _(t):
    rows = part(t, t="'===== Abstract =====\\n' || p_name || '\\n===== Other =====\\nx\\n===== Results =====\\n' || p_type")
    return rows.select("p_partkey", tagging.combined(F.col("t"), tagging.sections(F.col("t")), ["abstract", "results"]).alias("value"))


@query("headed_sections", "SELECT p_partkey, 'methods' AS section, p_name || chr(10) || 'more' AS body FROM part UNION ALL SELECT p_partkey, 'results', p_type FROM part")
def _(t):
    rows = part(t, t="'before\\nMETHODS AND DATA\\n' || p_name || '\\nmore\\nRESULTS\\n' || lower(p_type)")
    found = tagging.headed_sections(rows, "p_partkey", "t", {"method": "methods", "result": "results"})
    return found.select("p_partkey", "section", "body")


ORACLE_SQL["headed_sections"] = ORACLE_SQL["headed_sections"].replace("'results', p_type", "'results', lower(p_type)")


@query("age_ranges", "SELECT p_partkey, p_size AS low, p_size + 5 AS high, '=' AS operator FROM part UNION ALL SELECT p_partkey, 0, 3, '<' FROM part UNION ALL SELECT p_partkey, p_size + 1, 1000000, '>' FROM part")
def _(t):
    rows = part(t, t="'aged ' || p_size || '-' || (p_size + 5) || ' years, less than 3 years or more than ' || p_size || ' years'")
    return rows.select("p_partkey", F.explode(tagging.age_ranges(F.col("t"))).alias("r")).select("p_partkey", "r.*")


@query("participants", "SELECT p_partkey, 'children' AS indicator, CAST(p_partkey AS BIGINT) AS n, CAST(p_size AS BIGINT) AS boys, CAST(p_size + 1 AS BIGINT) AS girls FROM part")
def _(t):
    rows = part(t, t="'with ' || format_number(p_partkey, 0) || ' children (boys=' || p_size || ', girls = ' || (p_size + 1) || ') in all'")
    rows = rows.select("p_partkey", F.explode(tagging.participants(F.col("t"), ["children", "adults"])).alias("p"))
    kinds = tagging.participant_types(F.col("p.types"))
    return rows.select("p_partkey", "p.indicator", "p.n", kinds["boys"].alias("boys"), kinds["girls"].alias("girls"))


DESIGNS = {"randomized trials": "RCT", "RCTs": "RCT", "cohort studies": "cohort"}


@query("study_counts", "SELECT p_partkey, 'RCT' AS design, CAST(p_size + 12 AS BIGINT) AS n FROM part UNION ALL SELECT p_partkey, 'cohort', CAST(21 AS BIGINT) FROM part")
def _(t):
    rows = part(t, t="'We found ' || p_size || ' randomized trials, twelve RCTs and twenty-one cohort studies.'")
    return tagging.study_counts(rows, "p_partkey", "t", DESIGNS)


@query("study_total", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::BIGINT WHEN 1 THEN p_size::BIGINT + 1000 END AS value FROM part")
def _(t):
    return one(t, tagging.study_total, "CASE p_partkey % 3 WHEN 0 THEN 'of 900 records, ' || p_size || ' eligible trials were included' WHEN 1 THEN 'we included a total of 1,' || lpad(p_size, 3, '0') || ' small studies' ELSE 'no number' END")


@query("databases_named", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Cochrane|MEDLINE' ELSE 'MEDLINE' END AS value FROM part")
def _(t):
    vocabulary = {"MEDLINE": ["PubMed"], "Cochrane": ["CENTRAL"], "Embase": []}
    return one(t, lambda c: F.array_join(tagging.databases(c, vocabulary), "|"), "CASE WHEN p_size % 2 = 0 THEN 'in pubmed and (CENTRAL)' ELSE 'in Medline, not Embaseball' END")


@query("country_counts_in_text", "SELECT p_partkey, 'Brazil' AS country, CAST(p_size + 3 AS BIGINT) AS n FROM part UNION ALL SELECT p_partkey, 'Kenya', CAST(p_size AS BIGINT) FROM part")
def _(t):
    rows = part(t, t="'Brazil (n = ' || p_size || '), ' || p_size || ' studies from Kenya and Brazil (3)'")
    return tagging.country_counts(rows, "p_partkey", "t", ["Brazil", "Kenya", "Chile"])


@query("effect_spans", "SELECT p_partkey, 'effectiveness was ' || p_size || '%' AS value FROM part")
def _(t):
    return one(t, lambda c: F.array_join(tagging.effect_spans(c, ["effectiveness", "efficacy"]), "|"), "'Vaccine effectiveness was ' || p_size || '% overall; efficacy: none'")


@query("first_label", "SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), 'red') OR contains(p_name, 'red') THEN 'red: colour' WHEN contains(p_name, 'blue') THEN 'blue: sky' ELSE '' END AS value FROM part")
def _(t):
    return one(t, lambda c: tagging.first_label(c, [("Red", "colour"), ("blue", "sky")]), "upper(p_name)").withColumn("value", F.replace("value", F.lit("Red"), F.lit("red")))


GROUPS = [("Population", "AgeGroup", "Newborn_0-1", "newborns?"), ("Population", "AgeGroup", "Adults_18-64", "adults?"), ("Population", "AgeGroup", "OlderAdults_65-10000", "older adults"), ("Topic", "Effect", "Efficacy", "efficacy"), ("Topic", "Effect", "Safety", "safety")]


@query("parent_tags", """SELECT p_partkey, 'Population#AgeGroup' AS parent, concat_ws(', ', CASE WHEN p_size + 5 >= 18 THEN 'Adults_18-64' END, 'Newborn_0-1') AS terms FROM part
  UNION ALL SELECT p_partkey, 'Topic#Effect', CASE WHEN p_size % 2 = 0 THEN 'Efficacy, Safety' ELSE 'Efficacy' END FROM part""")
def _(t):
    rows = part(t, text="'Efficacy in newborns and ages ' || p_size || ' to ' || (p_size + 5) || CASE WHEN p_size % 2 = 0 THEN ', Safety' ELSE '' END")
    return tagging.parent_tags(rows, GROUPS, "p_partkey")


@query("confidence", "SELECT p_partkey, round(((p_size % 2 = 0)::INT + 1) / 3.0::DOUBLE, 2) AS value FROM part")
def _(t):
    rows = part(t, a="CASE WHEN p_size % 2 = 0 THEN 'x' END", b="p_name", c="''")
    return rows.select("p_partkey", tagging.confidence(["a", "b", "c"]).alias("value"))


# catalogue rows
def papers(t) -> DataFrame:
    """The parts as papers: title, abstract, publication_type, language, open_access and doi by their keys."""
    return part(t, title="CASE WHEN p_partkey % 2 = 0 THEN 'A Systematic look' ELSE p_name END", abstract="CASE WHEN p_partkey % 4 = 0 THEN 'a review' ELSE 'a trial' END", publication_type="CASE WHEN p_partkey % 7 = 0 THEN 'Meta-Analysis' END", language="CASE p_partkey % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'English, German' ELSE 'bengali' END", open_access="CASE WHEN p_partkey % 2 = 0 THEN ' ' WHEN p_partkey % 3 = 0 THEN 'yes' END", doi="CASE WHEN p_partkey % 5 > 0 THEN '10.1/' || p_partkey END", journal="p_brand")


@query("systematic_reviews", "SELECT p_partkey FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 4 = 0")
def _(t):
    return papers(t).where(ingest.is_systematic_review(F.col("publication_type"), F.col("title"), F.col("abstract"))).select("p_partkey")


@query("english_rows", "SELECT p_partkey FROM part WHERE p_partkey % 3 < 2")
def _(t):
    return papers(t).where(ingest.is_english(F.col("language"))).select("p_partkey")


@query("unprocessed_rows", "SELECT p_partkey FROM part WHERE p_partkey % 5 > 0 AND (p_partkey % 2 = 0 OR p_partkey % 3 > 0)")
def _(t):
    return ingest.unprocessed(papers(t)).select("p_partkey")


@query("with_topics", "SELECT p_partkey FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 5 > 0")
def _(t):
    return payload.with_topics(papers(t), ["publication_type", "doi", "missing"]).select("p_partkey")


@query("hierarchical_selection", "SELECT p_partkey FROM part WHERE p_partkey % 4 = 0 AND p_brand IN ('Brand#11', 'Brand#13', 'Brand#22')")
def _(t):
    tree = payload.selection_tree({"topic.kind": ["a "], "topic.other": ["review"], "journal": ["Brand#11", "Brand#13", "Brand#22"]})
    rows = papers(t).withColumn("title", F.concat_ws(" ", "title", "abstract"))
    return P.apply_tree(rows, tree).select("p_partkey")


@query("first_filled", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Meta-Analysis' ELSE p_brand END AS kind, CAST(NULL AS VARCHAR) AS none FROM part")
def _(t):
    rows = papers(t)
    return ingest.first_of(rows, {"p_partkey": ["p_partkey"], "kind": ["publication_type", "missing", "journal"], "none": ["gone"]}).select(F.col("p_partkey").cast("long").alias("p_partkey"), "kind", "none")


@query("enrich_missing", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'old' WHEN p_partkey % 3 = 0 THEN 'found' END AS language FROM part")
def _(t):
    rows = part(t, doi="'10.1/' || p_partkey", language="CASE WHEN p_partkey % 2 = 0 THEN 'old' END")
    known = part(t, doi="'10.1/' || p_partkey", language="'found'").where("p_partkey % 3 = 0").select("doi", "language")
    return ingest.enrich_missing(rows, known)[0].select("p_partkey", "language")


@query("upsert_papers", """WITH old AS (SELECT s_suppkey AS i, 'v' || s_suppkey AS v, '10.1/' || s_suppkey AS doi FROM supplier),
  new AS (SELECT s_suppkey AS i, CASE WHEN s_suppkey % 2 = 0 THEN 'v' || s_suppkey END AS v, CASE WHEN s_suppkey % 3 = 0 THEN '10.9/' || s_suppkey ELSE '10.1/' || s_suppkey END AS doi, 2000 + s_suppkey % 30 AS year FROM supplier WHERE s_suppkey % 5 > 0 AND 2000 + s_suppkey % 30 >= 2011),
  added AS (SELECT * FROM new WHERE i % 2 > 0 AND i % 3 = 0)
  SELECT i AS primary_id, coalesce(n.v, CASE WHEN n.i IS NULL THEN o.v END) AS verification_id, coalesce(n.doi, o.doi) AS doi, n.year AS year FROM old o LEFT JOIN (SELECT * FROM new WHERE i % 2 = 0 OR i % 3 > 0) n USING (i)
  UNION ALL SELECT (SELECT max(i) FROM old) + row_number() OVER (ORDER BY i), v, doi, year FROM added""")
def _(t):
    s = t.table("supplier")
    old = s.selectExpr("s_suppkey AS primary_id", "'v' || s_suppkey AS verification_id", "'10.1/' || s_suppkey AS doi", "'10.1/' || s_suppkey AS cleaned_doi", "CAST(NULL AS INT) AS year")
    new = s.selectExpr("s_suppkey AS at", "CASE WHEN s_suppkey % 2 = 0 THEN 'v' || s_suppkey END AS verification_id", "CASE WHEN s_suppkey % 5 = 0 THEN ' ' WHEN s_suppkey % 3 = 0 THEN '10.9/' || s_suppkey ELSE '10.1/' || s_suppkey END AS doi", "CAST(2000 + s_suppkey % 30 AS INT) AS year")
    return writes.upsert_papers(old, new, "at").select("primary_id", "verification_id", "doi", "year")


@query("insert_rows", "SELECT n_nationkey, n_name, NULL::INT AS extra FROM nation UNION ALL SELECT NULL, 'NEW', 7")
def _(t):
    return writes.insert(t.table("nation").select("n_nationkey", "n_name"), t.spark.createDataFrame([("NEW", 7)], "n_name string, extra int"))


@query("update_by_key", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'CHANGED' ELSE n_name END AS n_name FROM nation")
def _(t):
    return writes.update_by_key(t.table("nation").select("n_nationkey", "n_name"), "n_nationkey", 3, {"n_name": "CHANGED"})


@query("update_by_mapping", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END AS n_name FROM nation")
def _(t):
    rows = t.table("nation").select("n_nationkey", "n_name")
    return writes.update_from(rows, rows.where("n_nationkey % 2 = 0").select("n_nationkey", F.lit("even").alias("n_name")), "n_nationkey")


@query("delete_keys", "SELECT n_nationkey FROM nation WHERE n_nationkey % 4 > 0")
def _(t):
    rows = t.table("nation").select("n_nationkey")
    return writes.delete_keys(rows, rows.where("n_nationkey % 4 = 0"), "n_nationkey")


@query("update_or_create", "SELECT r_regionkey, CASE WHEN r_name = 'ASIA' THEN 'x' END AS note, r_name FROM region UNION ALL SELECT NULL, 'y', 'ATLANTIS'")
def _(t):
    rows = t.table("region").select("r_regionkey", "r_name", F.lit(None).cast("string").alias("note"))
    return writes.update_or_create(writes.update_or_create(rows, {"r_name": "ASIA"}, {"note": "x"}), {"r_name": "ATLANTIS"}, {"note": "y"})


@query("add_columns", "SELECT r_regionkey, NULL::VARCHAR AS note FROM region")
def _(t):
    return writes.add_columns(t.table("region").select("r_regionkey"), {"note": "string", "r_regionkey": "int"})


# facets, tags and statistics
@query("summary_sources", "SELECT source, count(*) AS n FROM {records} WHERE source <> '' GROUP BY 1 ORDER BY n DESC, source LIMIT 4")
def _(t):
    from .catalog import records

    return stats.summary(records(t))["source"]


TREE = {"topic": {"vpd": {"flu": {"display": "Influenza", "synonyms": ["grippe:flu", "influenza:flu"]}, "hpv": {"synonyms": ["papilloma:hpv"]}}, "ops": {"cost": {"display": "Costs"}}}}


@query("search_tags", "SELECT * FROM (VALUES ('topic', 'vpd', 'flu')) v(category, subgroup, code)")
def _(t):
    return filters.search_tags(filters.tree_frame(t.spark, TREE), "GRIP").select("category", "subgroup", "code")


@query("expand_synonym", "SELECT * FROM (VALUES ('topic', 'vpd', 'hpv', 'topic__hash__vpd__hash__hpv')) v(category, subgroup, code, \"column\")")
def _(t):
    return filters.expand_synonym(filters.tree_frame(t.spark, TREE), "Papilloma")


@query("merge_trees", "SELECT * FROM (VALUES ('flu', 'Influenza', 'grippe:flu|influenza:flu|virus:flu'), ('hpv', 'hpv', 'papilloma:hpv'), ('cost', 'Costs', '')) v(code, display, synonyms)")
def _(t):
    given = {"topic": {"vpd": {"flu": {"display": "Influenza", "synonyms": ["virus:flu"]}}}}
    return filters.merge_trees(filters.tree_frame(t.spark, given), filters.tree_frame(t.spark, TREE)).select("code", "display", F.array_join("synonyms", "|").alias("synonyms"))


@query("valid_values", "SELECT * FROM (VALUES ('p_size', TRUE), ('p_name', FALSE)) v(field, good)")
def _(t):
    rows = t.table("part")
    return t.spark.createDataFrame([("p_size", payload.valid_value(rows, "p_size", "12.5")), ("p_name", payload.valid_value(rows, "missing", "x") or payload.valid_value(rows, "p_size", "many"))], "field string, good boolean")


@query("flattened", "SELECT n_nationkey, n_name AS a_name, n_regionkey AS a_b_region FROM nation")
def _(t):
    nested = t.table("nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("b")).alias("a"))
    return files.flatten(nested)


@query("tracker_update", "SELECT * FROM (VALUES ('a', '1|2|3', '5', 3::BIGINT), ('b', '9', '', 9::BIGINT)) v(source_name, processed, failed, last)")
def _(t):
    tracker = t.spark.createDataFrame([("a", [1, 2], [3, 5])], "source_name string, processed_ids array<bigint>, failed_ids array<bigint>")
    results = t.spark.createDataFrame([("a", [3], [5]), ("b", [9], None)], "source_name string, processed array<bigint>, failed array<bigint>")
    return batches.update_tracker(tracker, results).select("source_name", F.array_join("processed_ids", "|").alias("processed"), F.array_join("failed_ids", "|").alias("failed"), F.col("last_processed_id").alias("last"))


@query("plucked", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def _(t):
    return Query(t.table("nation")).where("n_regionkey", 1).pluck("n_name")


# spans, examples and metrics
def many_spans(t) -> DataFrame:
    """Spans of each part: two that overlap, the longer one later, a copy of the first, and one apart."""
    span = lambda a, b, name: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(name).alias("label"))
    return t.table("part").select("p_partkey", F.array(span(0, 5, "A"), span(3, 10, "B"), span(0, 5, "A"), span(10, 12, "A")).alias("spans"))


def span_rows(column):
    return lambda t: many_spans(t).select("p_partkey", F.explode(column(F.col("spans"))).alias("s")).select("p_partkey", "s.*")


query("spans_first", "SELECT p_partkey, * EXCLUDE (p_partkey) FROM part, (VALUES (0, 5, 'A'), (10, 12, 'A')) v(start, \"end\", label)".replace("* EXCLUDE (p_partkey)", "start, \"end\", label"))(span_rows(spans.keep_first))
query("spans_longest", "SELECT p_partkey, start, \"end\", label FROM part, (VALUES (3, 10, 'B'), (10, 12, 'A')) v(start, \"end\", label)")(span_rows(spans.keep_longest))
query("spans_once", "SELECT p_partkey, start, \"end\", label FROM part, (VALUES (0, 5, 'A'), (3, 10, 'B'), (10, 12, 'A')) v(start, \"end\", label)")(span_rows(spans.dedupe))


ORACLE_SQL["text_chunks"] = "SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(least(s + 4000, length(text)) AS INTEGER) AS \"end\" FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 400, 1), 3600)) AS s FROM documents)"
ORACLE_SQL["appraisal_items"] = f"SELECT doc_id, {appraisal.items_sql('t')} FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)"
ORACLE_SQL["sentences"] = "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS i, sentence FROM (SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 1) AS p FROM documents))"
ORACLE_SQL["json_rows"] = "SELECT '{\"n_nationkey\":\"' || n_nationkey || '\",\"n_name\":\"' || n_name || '\",\"n_regionkey\":\"' || n_regionkey || '\"}' AS json FROM nation"
ORACLE_SQL["selection_columns"] = "SELECT * FROM (VALUES ('Flu', 'topic__hash__vpd__flu'), ('papilloma', 'topic__hash__vpd__hpv')) v(selection, \"column\")"
_TERMS = "(VALUES ('license', 'kind', 'apache', 'apache license', 'apa'), ('license', 'kind', 'mit', 'mit license', 'mit'), ('word', 'en', 'the', 'the', 'the'), ('word', 'de', 'der', 'der', 'der')) AS v(category, subgroup, term, phrase, code)"
ORACLE_SQL["tag_columns"] = "SELECT doc_id, " + ", ".join(f"max(CASE WHEN code = '{c}' THEN phrase || ':' || code END) AS {n}" for c, n in (("apa", "license__hash__kind__hash__apache"), ("mit", "license__hash__kind__hash__mit"), ("the", "word__hash__en__hash__the"), ("der", "word__hash__de__hash__der"))) + f" FROM documents, {_TERMS} WHERE regexp_matches(text, '(?i)\\b' || phrase || '\\b') GROUP BY doc_id"
_NEAR = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
ORACLE_SQL["hard_negatives"] = f"SELECT query, list(vec_id ORDER BY r) AS negatives FROM (SELECT a.vec_id AS query, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_NEAR} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.label <> b.label AND a.vec_id % 20 = 0) WHERE r <= 5 GROUP BY query"


@query("verbalise_first", "SELECT p_partkey, 'found twelve of ' || p_size AS value FROM part")
def _(t):
    return one(t, mining.verbalise_first, "'found 12 of ' || p_size")


@query("term_templates", "SELECT n_name AS label, 'about ' || lower(n_name) || ' only' AS text, 6 AS start, 6 + length(n_name)::INT AS \"end\" FROM nation")
def _(t):
    return mining.templates(t.table("nation").select(F.col("n_name").alias("label"), F.lower("n_name").alias("term")), ["about {} only"])


@query("slot_counts", "SELECT o_orderstatus AS slot, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return mining.slot_counts(t.table("orders").select(F.col("o_orderstatus").alias("slot")))


@query("bio_labels", "SELECT p_partkey, 'B-X|I-X|O' AS value FROM part")
def _(t):
    at = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    span = F.array(F.struct(F.lit(2).alias("start"), F.lit(9).alias("end"), F.lit("X").alias("label")))
    return t.table("part").select("p_partkey", F.array_join(spans.bio_tags(F.array(at(2, 4), at(5, 9), at(10, 12)), span), "|").alias("value"))


@query("span_decisions", "SELECT p_partkey AS doc_id, 0 AS start, 5 AS \"end\", CASE WHEN p_partkey % 3 = 1 THEN 'NEW' ELSE 'A' END AS label FROM part WHERE p_partkey % 3 > 0")
def _(t):
    rows = part(t, doc_id="p_partkey", start="0", end="5", label="'A'").drop("p_partkey")
    made = rows.select("*", F.when(F.col("doc_id") % 3 == 0, "drop").when(F.col("doc_id") % 3 == 1, "relabel").otherwise("keep").alias("decision"), F.lit("NEW").alias("new_label"))
    return spans.apply_decisions(rows, made)


@query("entity_scores", "SELECT 0.5::DOUBLE AS precision, 1.0::DOUBLE AS recall, round(2 / 3.0::DOUBLE, 6) AS f1 FROM (SELECT count(*) AS n FROM nation) WHERE n > 0")
def _(t):
    found = t.table("nation").select(F.explode(F.array(F.col("n_nationkey"), F.col("n_nationkey") + 1000)).alias("k"))
    return spans.entity_metrics(t.table("nation").select(F.col("n_nationkey").alias("k")), found, ["k"]).withColumn("f1", F.round("f1", 6))


@query("grouped_entities", "SELECT n_regionkey AS k, 'LOC_bert' AS label, string_agg(n_name || ' (confidence: ' || printf('%.4f', 1.0 / (1 + n_nationkey)) || ')', ', ' ORDER BY n_nationkey) AS entities FROM nation GROUP BY 1")
def _(t):
    rows = t.table("nation").select(F.col("n_regionkey").alias("k"), F.lit("LOC").alias("label"), F.col("n_name").alias("text"), (1.0 / (1 + F.col("n_nationkey"))).alias("score"))
    return spans.group_entities(rows, "k")


@query("best_number", "SELECT o_custkey, arg_min(o_orderkey, [o_totalprice, o_orderkey::DOUBLE]) AS value FROM orders GROUP BY 1")
def _(t):
    return retrieval.best_number(t.table("orders").select("o_custkey", F.col("o_orderkey").alias("value"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("length")), "o_custkey")


@query("sorted_map", "SELECT p_partkey, CASE WHEN p_size > 20 THEN 'size=' || p_size || '|a=20|b=20' WHEN p_size = 20 THEN 'a=20|b=20|size=20' ELSE 'a=20|b=20|size=' || p_size END AS value FROM part")
def _(t):
    m = F.map_from_arrays(F.array(F.lit("size"), F.lit("b"), F.lit("a")), F.array(F.col("p_size"), F.lit(20), F.lit(20)))
    return t.table("part").select("p_partkey", F.array_join(F.transform(retrieval.sorted_map(m), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("value"))


@query("array_windows", "SELECT p_partkey, CASE WHEN p_size <= 8 THEN 1 ELSE 1 + CAST(ceil((p_size - 8) / 4.0) AS INTEGER) END AS n, least(p_size, 8) AS first FROM part")
def _(t):
    made = spans.windows(F.sequence(F.lit(1), F.col("p_size")), 8, 4)
    return t.table("part").select("p_partkey", F.size(made).alias("n"), F.size(F.get(made, F.lit(0))).alias("first"))


@query("best_occurrence", "SELECT p_partkey, 9 + p_size AS value FROM part")
def _(t):
    return one(t, lambda c: spans.best_occurrence(c, F.lit("flu"), ["vaccine"], 12), "'the flu. ' || repeat('x', p_size) || 'Flu vaccine'")


@query("html_tables", "SELECT p_partkey, 'name' || chr(9) || 'size' || chr(10) || p_name || chr(9) || p_size AS value FROM part")
def _(t):
    return one(t, lambda c: F.get(html.tables(c), F.lit(0)), "'<p>x</p><table class=\"a\"><tr><th>name</th><th>size</th></tr><tr><td><b>' || p_name || '</b></td><td>' || p_size || '</td></tr></table>'")


#: A page with a table in a table's cell, a tag in an attribute and tags in a comment and a script.
NESTED = "'<!-- <table><tr> --><table title=\"a > b\"><tr><th>name</th><th>more</th></tr><tr><td>' || p_name || '</td><td>in <TABLE><tr><td>' || p_size || '</td><td>' || p_brand || '</td></tr></TABLE> end</td></tr></table><script>\"</table>\"</script><p>between</p></table><table><tr><td>' || p_type || '</td></tr></table>'"


@query("html_nested_tables", """
SELECT p_partkey, no, value FROM part, LATERAL (VALUES
  (0, 'name' || chr(9) || 'more' || chr(10) || p_name || chr(9) || 'in ' || p_size || ' ' || p_brand || ' end' || chr(9) || p_size || chr(9) || p_brand || chr(10) || p_size || chr(9) || p_brand),
  (1, p_size || chr(9) || p_brand), (2, p_type)) v(no, value)""")
def _(t):
    return part(t, t=NESTED).select("p_partkey", F.posexplode(html.tables(F.col("t"))).alias("no", "value"))


@query("html_numbered_tables", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '===== Table 1 =====' || chr(10) || p_size || chr(10) || chr(10) ELSE '' END || '===== Table 2 =====' || chr(10) || p_brand AS value FROM part")
def _(t):
    return one(t, html.numbered_tables, "'<table>' || CASE WHEN p_size % 2 = 0 THEN '<tr><td>' || p_size || '</td></tr>' ELSE '' END || '</table><table><tr><td>' || p_brand || '</td></tr></table>'")


@query("html_select", "SELECT p_partkey, i AS item_no, p_name AS title, '/p/' || i AS link, 'a ' || p_size || ' b ' || i AS body, CASE WHEN i = 1 THEN p_brand END AS brand FROM part, (VALUES (0), (1)) v(i)")
def _(t):
    item = lambda i, more: f"'<div id=i{i} class=\"r item\"><h3 class=t><span>no</span><a href=\"/p/{i}\">' || p_name || '</a></h3><div class=body>a <div><div>' || p_size || '</div></div> b {i}</div>{more}</div>'"
    rows = part(t, html=f"'<div class=items>' || {item(0, '')} || {item(1, '<b class=brand>\' || p_brand || \'</b>')} || '</div></div>'")
    return html.select_records(rows, "div.item", {"title": "h3.t a", "link": "h3.t a@href", "body": "div.body", "brand": "b.brand"})


@query("html_records", "SELECT p_partkey, i AS item_no, p_name || ' ' || i AS title FROM part, (VALUES (0), (1)) v(i)")
def _(t):
    rows = part(t, html="'<div class=r><h3>' || p_name || ' 0</h3></div><div class=r><h3>' || p_name || ' 1</h3></div>'")
    return html.records(rows, r"(?s)<div class=r>.*?</div>", {"title": r"<h3>(.*?)</h3>"})


@query("squad_examples", "SELECT p_partkey || '-COLOUR-1' AS id, p_partkey AS doc_id, p_name AS answer, 12 AS at FROM part")
def _(t):
    rows = part(t, doc_id="p_partkey", text="'The part is ' || p_name || '. More text.'", start="12", end="12 + length(p_name)", label="'COLOUR'").drop("p_partkey")
    out = qa.squad_examples(rows, {"COLOUR": "Which colour?"})
    return out.select("id", "doc_id", F.get("answers.text", F.lit(0)).alias("answer"), F.get("answers.answer_start", F.lit(0)).alias("at"))


@query("unanswerable", "SELECT n_nationkey AS doc_id, 'B?' AS question FROM nation")
def _(t):
    docs = t.table("nation").select(F.col("n_nationkey").alias("doc_id"))
    return qa.unanswerable(docs, docs.withColumn("label", F.lit("A")), {"A": "A?", "B": "B?"})


def _json_rows(name: str, fields: dict[str, str], group: str, order: str, limit: int | None = None) -> str:
    """SQL for a JSON list of objects of ``fields`` (name: SQL text) and n, by a grouping of the records."""
    made = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items())
    cut = f"LIMIT {limit}" if limit else ""
    return f"(SELECT '[' || string_agg('{{' || {made} || ',\"n\":' || n || '}}', ',' ORDER BY {order}) || ']' FROM (SELECT {group}, count(*) AS n FROM {{records}} GROUP BY ALL ORDER BY {order} {cut})) AS {name}"


_quoted = "'\"' || {} || '\"'".format
ORACLE_SQL["dashboard_json"] = ("SELECT " + ", ".join((
    _json_rows("year_source", {"year": "year", "source": _quoted("source")}, "year, source", "year, source"),
    _json_rows("country", {"country": _quoted("country")}, "country", "n DESC, country"),
    _json_rows("journal", {"journal": _quoted("journal")}, "journal", "n DESC, journal", 3),
    _json_rows("source", {"source": _quoted("source")}, "source", "n DESC, source", 4),
    _json_rows("database", {"database": _quoted("database")}, "database", "n DESC, database", 4),
))).replace("{records}", RECORDS)


# facts
TREATED = "'Patients got ' || p_size || ' mg daily for ' || p_size || ' weeks versus Placebo, in a 3-dose series at 0, 1, 6 months; the placebo group and the control arm had ' || p_size || ' weeks follow-up.'"


@query("treatment", "SELECT p_partkey, p_size || ' weeks' AS durations, p_size || ' mg' AS doses, '3-dose series|at 0, 1, 6 months' AS schedules, 'placebo|control' AS comparators FROM part")
def _(t):
    made = part(t, t=TREATED).select("p_partkey", facts.treatment(F.col("t")).alias("v"))
    return made.select("p_partkey", *(F.array_join(f"v.{c}", "|").alias(c) for c in ("durations", "doses", "schedules", "comparators")))


_PLACE = "CASE p_size % 3 WHEN 0 THEN 'Kenya' WHEN 1 THEN 'Peru' ELSE 'nowhere' END"


@query("title_metadata", f"SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN {_PLACE} ELSE '' END AS location, 'Asian|Black' AS races, 'pregnant women|pregnant women in ' || {_PLACE} AS populations, 'vaccines' AS topics, p_size AS num_databases, p_size || ' weeks' AS duration, '5 mg' AS dosage, 'usual care' AS comparator FROM part")
def _(t):
    rows = part(t, title=f"'Uptake of vaccines among pregnant women in ' || {_PLACE} || ': Asian and Black groups'", body="'We searched ' || p_size || ' databases. Duration of ' || p_size || ' weeks, 5 mg dose, compared to usual care.'")
    v = rows.select("p_partkey", facts.title_metadata(F.col("title"), F.col("body"), ["Peru", "Kenya"], ["vaccines", "hiv"]).alias("v"))
    arrays = (F.array_join(f"v.{c}", "|").alias(a) for c, a in (("race_ethnicity", "races"), ("target_population", "populations"), ("topic", "topics")))
    return v.select("p_partkey", "v.location", *arrays, "v.num_databases", F.col("v.duration_of_intervention").alias("duration"), "v.dosage", "v.comparator")


@query("pruned_facts", "SELECT p_partkey, concat_ws(' ', CASE WHEN p_size % 2 > 0 THEN 'odd=' || p_size % 2 END, 'doses=[\"' || p_size || ' mg\"]') AS value FROM part")
def _(t):
    v = part(t, t=TREATED, odd="p_size % 2").withColumn("v", facts.treatment(F.col("t")))
    pruned = facts.prune({"odd": F.col("odd"), "doses": F.col("v.doses"), "none": F.array().cast("array<string>"), "blank": F.lit("")})
    return v.select("p_partkey", F.array_join(F.transform(F.map_entries(pruned), lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("value"))


@query("evidence_caps", "SELECT p_partkey, least(p_size, 8) + least(p_size, 20) AS n, 'a' AS first, 'b' AS last FROM part")
def _(t):
    texts = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: i.cast("string"))
    rows = t.table("part").select("p_partkey", facts.evidence({"a": texts, "b": texts}, {"a": 8, "b": 20}).alias("e"))
    return rows.select("p_partkey", F.size("e").alias("n"), F.get("e", F.lit(0))["field"].alias("first"), F.element_at("e", -1)["field"].alias("last"))


@query("name_codes", "SELECT n_nationkey, CASE n_name WHEN 'KENYA' THEN 404 ELSE 604 END AS id FROM nation WHERE n_name IN ('KENYA', 'PERU')")
def _(t):
    return facts.with_codes(t.table("nation").select("n_nationkey", "n_name"), "n_name", {"KENYA": 404, "PERU": 604}).select("n_nationkey", "id")


# texts of x with a line feed after each n of them, in rows of n: a piece ends before the last line feed of its first 100 characters, but not 40 or more before their end
@query("line_chunks", """WITH RECURSIVE texts AS (SELECT p_partkey, repeat(repeat('x', p_size) || chr(10), 12) AS t FROM part),
cut AS (SELECT p_partkey, t, 0 AS s, CASE WHEN length(t) <= 100 THEN length(t) WHEN strpos(reverse(t[62:100]), chr(10)) > 0 THEN 100 - strpos(reverse(t[62:100]), chr(10)) ELSE 100 END AS e FROM texts
UNION ALL SELECT p_partkey, t, e - 10, CASE WHEN e + 90 >= length(t) THEN length(t) WHEN strpos(reverse(t[e + 52 : e + 90]), chr(10)) > 0 THEN e + 90 - strpos(reverse(t[e + 52 : e + 90]), chr(10)) ELSE e + 90 END FROM cut WHERE e < length(t))
SELECT p_partkey, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", t[s + 1 : e] AS text FROM cut""")
def _(t):
    rows = part(t, t="repeat(repeat('x', p_size) || '\\n', 12)")
    return rows.select("p_partkey", F.explode(spans.line_chunks(F.col("t"), 100, 10, 40)).alias("c")).select("p_partkey", "c.*")


@query("mined_slots", "SELECT slot, count(*) AS n FROM part, (VALUES ('studies'), ('date'), ('country'), ('design_cohort'), ('design_any'), ('outcome_death'), ('age_numeric'), ('age_groups'), ('topic'), ('intervention_any'), ('intervention_flu')) v(slot) GROUP BY slot")
def _(t):
    told = ("In total 12 cohort studies were included in paper ' || p_partkey || '. We screened many cohort studies on mortality in adults. We searched until May 2021 for paper ' || p_partkey || '. Kenya (n = 1,200) came in paper ' || p_partkey || '. "
            "Mortality was low in paper ' || p_partkey || '. Adults of 18 to 60 years came in paper ' || p_partkey || '. The flu vaccine has awareness in paper ' || p_partkey || '.")  # fmt: skip
    slots = ["studies", "date", "country", "design_cohort", "design_any", "outcome_death", "age_numeric", "age_groups", "topic", "intervention_any", "intervention_flu", "design_rct", "outcome_icu"]
    rules = mining.slot_rules({s: [f"{s}?"] for s in slots}, {"topic": ["awareness"]}, {"country": ["Kenya", "Peru"]}, {"flu": ["flu", "influenza"], "hpv": ["hpv"]})
    return mining.slot_counts(mining.mine(part(t, t="'" + told.replace(". ", ".\\n") + "'"), rules, "p_partkey", "t"))


# bags of matches
BAGGED = "repeat('x', p_size) || ' adults ' || repeat('y', p_size) || ' children and adults end'"


@query("pattern_bags", """SELECT p_partkey, 'adults, children' AS age_tags, 'AD, children' AS age_acronyms, '' AS none_tags, '[]' AS none_bag,
'[{"Matched Content":"adults","Text Before":"' || right(repeat('x', p_size) || ' ', 5) || '","Text After":"' || left(' ' || repeat('y', p_size) || ' chi', 5) || '"},'
|| '{"Matched Content":"children","Text Before":"' || right(' adults ' || repeat('y', p_size) || ' ', 5) || '","Text After":" and "},'
|| '{"Matched Content":"adults","Text Before":" and ","Text After":" end"}]' AS age_bag FROM part""")
def _(t):
    return spans.with_bags(part(t, t=BAGGED), "t", {"age": "adults|children", "none": "zebra"}, {"age": {"adults": "AD"}}, 5).drop("t")


@query("medline_records", """SELECT p_partkey::VARCHAR AS pmid, 'A systematic review of ' || p_name AS title, '' AS abstract, 'Li A; ' || p_brand AS authors, 'eng; fre' AS language,
'10.1/' || p_partkey || '; 10.2/x' AS doi, FALSE AS is_oa FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 2 = 0""")
def _(t):
    def rows(title: str, n: int) -> DataFrame:
        texts = {"PMID": "cast(p_partkey AS string)", "TI": title, "AB": "cast(NULL AS string)", "DP": "'2020'", "JT": "'J'", "PL": "'X'"}
        arrays = {"AU": "array('Li A', p_brand)", "LA": "if(p_partkey % 2 = 0, array('eng', 'fre'), array('ger'))", "MH": "cast(NULL AS array<string>)", "PT": "array('Journal Article')", "AID": "array('10.1/' || p_partkey || ' [doi]', 'S12 [pii]', '10.2/x')"}
        return part(t, **texts, **arrays, is_oa="cast(NULL AS boolean)", best_oa_url="cast(NULL AS string)", n=str(n))

    found = ingest.assemble_medline(rows("'later copy: systematic review'", 2).unionByName(rows("if(p_partkey % 3 = 0, 'A trial', 'A systematic review of ' || p_name)", 1)), "n")
    return found.select("pmid", "title", "abstract", "authors", "language", "doi", "is_oa")


@query("duplicates_by_source", "SELECT o_orderstatus AS source, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) GROUP BY 1")
def _(t):
    return stats.duplicates_by(t.table("orders").select(F.col("o_orderstatus").alias("source"), "o_custkey"), "source", "o_custkey")


@query("retry_flags", "SELECT p_partkey, p_partkey % 3 = 0 AS retry FROM part")
def _(t):
    failed = t.table("part").where("p_partkey % 3 = 0").select("p_partkey")
    return batches.with_retry(t.table("part").select("p_partkey"), failed.unionByName(failed), "p_partkey")


@query("xml_as_json", """SELECT p_partkey, '{"a":"' || p_name || '","b":{"c":' || p_size || '}}' AS value FROM part""")
def _(t):
    return one(t, lambda c: files.xml_json(c, "a string, b struct<c: int>"), "'<r><a>' || p_name || '</a><b><c>' || p_size || '</c></b></r>'")
