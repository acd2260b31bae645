"""The catalogue's operators as queries over the test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Catalog, column_info, records
from .functions import dates, identifiers, numbers, tags, text
from .operators import appraisal, facets, filters, ingest, mining, qa, retrieval, spans, stats, tagging, writes
from .plans import payload
from .plans import predicates as P
from .plans.query import Query
from .sources import files, html
from .streaming import batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The catalogue's records in SQL.
RECORDS = """(SELECT o_orderkey AS primary_id, year(o_orderdate) AS year, o_orderpriority AS source, o_orderstatus AS database, c_mktsegment AS journal,
  n_name AS country, r_name AS region, o_orderdate AS created_at, o_totalprice AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
#: A tag cell from a part's name.
CELL = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: w || ':' || left(w, 3)), ', ')"


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Catalog], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(Catalog(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql.replace("{records}", RECORDS).replace("{cell}", CELL)
        return f

    return keep


def money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def tagged_parts(t: Catalog) -> DataFrame:
    cell = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.lit(":"), F.left(w, F.lit(3)))), ", ")
    return t.table("part").select("p_partkey", "p_brand", "p_name", cell.alias("topic__hash__vpd__hash__name"), F.concat(F.lower("p_type"), F.lit(":"), F.left(F.lower("p_type"), F.lit(4))).alias("outcome__hash__kind__hash__type"))


# scans and catalog
@query("scan_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return t.table("nation").select("n_nationkey", "n_name", "n_regionkey")


@query("column_info", "SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(column_type) END AS type, TRUE AS nullable, (row_number() OVER () - 1)::INTEGER AS position FROM (DESCRIBE lineitem)")
def _(t):
    return column_info(t.table("lineitem"))


@query("raw_sql", "SELECT o_orderpriority AS source, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def _(t):
    t.table("orders")
    return t.sql("SELECT o_orderpriority AS source, count(*) AS n FROM orders WHERE o_orderstatus = :status GROUP BY 1", status="F")


# builder
@query("where_ops", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'O'")
def _(t):
    return Query(t.table("lineitem")).where("l_quantity", ">=", 10).where_between("l_discount", 0.02, 0.06).where_in("l_returnflag", ["A", "R"]).where("l_linestatus", "!=", "O").select("l_orderkey", "l_linenumber", "l_quantity").rows()


@query("where_or_split", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 200000 OR o_orderpriority = '1-URGENT')")
def _(t):
    return Query(t.table("orders")).where("o_orderstatus", "F").or_where("o_totalprice", ">", 200000).or_where("o_orderpriority", "1-URGENT").select("o_orderkey").rows()


@query("where_or_either", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_totalprice > 200000 OR o_orderpriority = '1-URGENT')")
def _(t):
    return Query(t.table("orders"), mode="either").where("o_orderstatus", "F").or_where("o_totalprice", ">", 200000).or_where("o_orderpriority", "1-URGENT").select("o_orderkey").rows()


@query("where_nested", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice < 50000 AND o_orderpriority = '5-LOW' OR o_custkey < 100) OR FALSE")
def _(t):
    inner = lambda q: q.where_nested(lambda a: a.where("o_totalprice", "<", 50000).where("o_orderpriority", "5-LOW"))
    return Query(t.table("orders")).where("o_orderstatus", "O").or_where_nested(inner).or_where("o_custkey", "<", 100).select("o_orderkey").rows()


@query("where_callable", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND length(c_name) > 5")
def _(t):
    return Query(t.table("customer")).where(lambda df: F.length("c_name") > 5).where("c_acctbal", ">", 0).select("c_custkey").rows()


@query("null_predicates", "SELECT d.doc_id, quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE (quality IS NULL AND lang IS NOT NULL) OR (quality IS NOT NULL AND toxic = 1)")
def _(t):
    joined = t.table("documents").join(t.table("labels"), "doc_id", "left")
    none = Query(joined).or_where_nested(lambda q: q.where_null("quality").where_not_null("lang")).or_where_nested(lambda q: q.where("quality", "!=", None).where("toxic", 1))
    return none.rows().select("doc_id", F.col("quality").isNull().alias("unlabelled"))


@query("like_family", "SELECT p_partkey FROM part WHERE p_name LIKE '%e%' AND p_type ILIKE '%a%' AND p_brand LIKE 'B%' AND p_name NOT LIKE 'z%' AND p_name LIKE '%t'")
def _(t):
    return Query(t.table("part")).where_contains("p_name", "e").where_like("p_type", "%A%").where_starts_with("p_brand", "B").where(~F.col("p_name").like("z%")).where_ends_with("p_name", "t").select("p_partkey").rows()


@query("any_like", "SELECT p_partkey FROM part WHERE (p_name ILIKE '%red%' OR p_name ILIKE '%blue%') AND (p_type ILIKE '%o%' OR p_brand ILIKE '%o%')")
def _(t):
    return Query(t.table("part")).where_any_like("p_name", ["RED", "blue"]).where_columns_like(["p_type", "p_brand"], "o").select("p_partkey").rows()


@query("date_year_month", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) >= 6 AND CAST(o_orderdate AS DATE) < DATE '1997-11-15'")
def _(t):
    return Query(t.table("orders")).where_year("o_orderdate", "=", 1997).where_month("o_orderdate", ">=", 6).where_date("o_orderdate", "<", "1997-11-15").select("o_orderkey").rows()


@query("select_valid", "SELECT p_partkey, p_brand FROM part")
def _(t):
    return Query(t.table("part")).select_valid("P_PARTKEY", "missing", "p_brand", any_case=True).rows()


@query("distinct_sorted", "SELECT DISTINCT p_brand, p_size FROM part ORDER BY p_brand, p_size")
def _(t):
    return Query(t.table("part")).distinct("p_brand", "p_size").order_by("p_brand").order_by("p_size").rows()


@query("distinct_limit", "SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 5")
def _(t):
    return Query(t.table("part")).distinct("p_type").order_by("p_type").limit(5).rows()


@query("group_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) > 10")
def _(t):
    return Query(t.table("orders")).group_by("o_custkey").aggregate("count", "*", "n").aggregate("max", "o_totalprice", "top").having("n > 10").rows()


@query("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def _(t):
    return Query(t.table("orders")).order_by_desc("o_totalprice").order_by("o_orderkey").select("o_orderkey", "o_totalprice").offset(10).limit(25).rows()


@query("latest", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 3")
def _(t):
    return Query(t.table("orders")).latest("o_orderdate").order_by_desc("o_orderkey").select("o_orderkey", "o_orderdate").limit(3).rows()


@query("page_records", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return Query(t.table("orders")).where("o_orderstatus", "F").order_by("o_orderkey").select("o_orderkey").paginate(3, 20)[0]


@query("count_exists", "SELECT count(*) AS n, count(*) > 0 AS found FROM customer WHERE c_acctbal < 0")
def _(t):
    return Query(t.table("customer")).where("c_acctbal", "<", 0).counted().select("n", (F.col("n") > 0).alias("found"))


@query("agg_basic", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, min(l_quantity) AS min_q, max(l_quantity) AS max_q, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    return Query(t.table("lineitem")).where("l_returnflag", "R").rows().agg(money("l_extendedprice").alias("sum_price"), F.min("l_quantity").alias("min_q"), F.max("l_quantity").alias("max_q"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("empty_sum", "SELECT coalesce(sum(c_custkey), 0) AS sum FROM customer WHERE c_custkey < 0")
def _(t):
    return Query(t.table("customer")).where("c_custkey", "<", 0).total("c_custkey")


# JSON languages
@query("grouped_payload", "SELECT source, count(*) AS n FROM {records} WHERE (year = 1996 OR year IN (1998, 1999)) AND (country ILIKE '%1%') AND amount BETWEEN 1000 AND 150000 GROUP BY source ORDER BY source")
def _(t):
    request = {
        "filters": [{"type": "where", "column": "year", "value": 1996}, {"type": "inwhere", "column": "year", "value": [1998, 1999]}, {"type": "likewhere", "column": "country", "value": "1"}, {"type": "betweenwhere", "column": "amount", "value": [1000, 150000]}],
        "group_by": ["source"], "aggregations": [{"func": "COUNT", "column": "*", "alias": "n"}], "order_by": {"column": "source", "direction": "asc"},
    }
    return payload.run_payload(records(t), request)[0]


@query("payload_negations", "SELECT primary_id FROM {records} WHERE source <> '5-LOW' AND database NOT IN ('P') AND amount > 100000 AND region IS NOT NULL")
def _(t):
    request = [{"column": "source", "op": "!=", "value": "5-LOW"}, {"column": "database", "op": "not in", "value": ["P"]}, {"column": "amount", "op": ">", "value": 100000}, {"column": "region", "op": "is not null"}]
    return payload.run_payload(records(t), request)[0].select("primary_id")


@query("payload_short", "SELECT primary_id FROM {records} WHERE region = 'ASIA' AND year IN (1995, 1997)")
def _(t):
    return payload.run_payload(records(t), {"region": ["ASIA"], "year": [1995, 1997]})[0].select("primary_id")


@query("title_expansion", "SELECT c_custkey FROM (SELECT c_custkey, c_name AS title, c_mktsegment AS journal FROM customer) WHERE title ILIKE '%auto%' OR journal ILIKE '%auto%'")
def _(t):
    rows = t.table("customer").select("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("journal"))
    return rows.where(P.compile_tree(rows, payload.grouped_tree(payload.expand_title([{"type": "where", "column": "Title", "value": "auto"}])))).select("c_custkey")


@query("dynamic_search_query", "SELECT p_partkey FROM part WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%an%' OR p_type ILIKE '%an%'")
def _(t):
    return payload.dynamic_search(t.table("part"), {"query": "an"}).select("p_partkey")


@query("dynamic_search_or", "SELECT p_partkey FROM part WHERE p_size < 3 OR p_name ILIKE 'b%' OR p_brand IN ('Brand#11', 'Brand#22') OR p_retailprice BETWEEN 900 AND 905")
def _(t):
    search = {"logic": "OR", "conditions": [{"field": "p_size", "operator": "<", "value": 3}, {"field": "p_name", "operator": "starts_with", "value": "b"}, {"field": "p_brand", "operator": "in", "values": ["Brand#11", "Brand#22"]}, {"field": "p_retailprice", "operator": "between", "values": [900, 905]}]}
    return payload.dynamic_search(t.table("part"), search).select("p_partkey")


@query("dynamic_search_values", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3)")
def _(t):
    return payload.dynamic_search(t.table("part"), {"field": "p_size", "values": [1, 2, 3], "operator": "not_in"}).select("p_partkey")


@query("search_all_columns", "SELECT s_suppkey FROM supplier WHERE CAST(s_suppkey AS VARCHAR) ILIKE '%7%' OR s_name ILIKE '%7%' OR CAST(s_nationkey AS VARCHAR) ILIKE '%7%'")
def _(t):
    return payload.search_all_columns(t.table("supplier").select("s_suppkey", "s_name", "s_nationkey"), "7").select("s_suppkey")


@query("search_tree_deep", "SELECT primary_id FROM {records} WHERE (region = 'ASIA' AND (year = 1996 OR (source = '1-URGENT' AND amount > 250000))) OR (database = 'P' AND NOT journal IS NULL AND year >= 2000) ORDER BY primary_id LIMIT 50")
def _(t):
    tree = {"logic": "OR", "conditions": [
        {"logic": "AND", "conditions": [{"field": "region", "operator": "equals", "value": "ASIA"}, {"logic": "OR", "conditions": [{"field": "year", "operator": "=", "value": 1996}, {"logic": "AND", "conditions": [{"field": "source", "operator": "equals", "value": "1-URGENT"}, {"field": "amount", "operator": "gt", "value": 250000}, {"field": "unknown", "operator": "gt", "value": 1}]}]}]},
        {"logic": "AND", "conditions": [{"field": "database", "operator": "=", "value": "P"}, {"field": "journal", "operator": "is_not_null"}, {"field": "year", "operator": "gte", "value": 2000}]},
    ]}
    return payload.search_tree(records(t), {"search": tree, "sort_by": "primary_id", "pagination": {"page": 1, "page_size": 50}})[0].select("primary_id")


@query("regex_clause", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*t$') AND p_type LIKE '%E%'")
def _(t):
    return P.apply_tree(t.table("part"), [{"field": "p_name", "operator": "regex", "value": "^[a-m].*t$"}, {"field": "p_type", "operator": "contains_exact", "value": "E"}]).select("p_partkey")


@query("contains_any_tags", "SELECT p_partkey FROM (SELECT p_partkey, {cell} AS cell FROM part) WHERE cell ILIKE '%:red%' OR cell ILIKE '%:wid%'")
def _(t):
    return P.apply_tree(tagged_parts(t), {"field": "topic__hash__vpd__hash__name", "operator": "contains_any", "values": ["red", "wid"]}).select("p_partkey")


@query("comma_membership", "SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['red', 'blue'])")
def _(t):
    rows = t.table("part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(", ")).alias("names"))
    return payload.by_members(rows, {"names": ["Red", "BLUE"]}).select("p_partkey")


@query("advanced_search", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name ILIKE '%1%' ORDER BY c_acctbal DESC, c_custkey")
def _(t):
    return payload.advanced_search(t.table("customer"), {"c_mktsegment": ["BUILDING", "MACHINERY"]}, "1", ["c_name"], "c_acctbal", "desc").select("c_custkey", "c_acctbal")


@query("field_search", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%2%' AND c_mktsegment ILIKE '%b%'")
def _(t):
    return payload.field_search(t.table("customer"), {"c_name": "2", "c_mktsegment": "b"}).select("c_custkey")


@query("year_range", "SELECT primary_id FROM {records} WHERE year BETWEEN 1996 AND 1998")
def _(t):
    return payload.year_range(records(t), 1996, 1998).select("primary_id")


@query("selection_columns")
def _(t):
    rows = [("topic__hash__vpd__flu", "Influenza", ["flu", "influenza"]), ("topic__hash__vpd__hpv", "HPV", ["papilloma"])]
    return payload.selection_columns(["Flu", "papilloma", "none"], t.spark.createDataFrame(rows, "column string, display string, synonyms array<string>"))


# joins
@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    return t.table("customer").join(t.table("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t):
    return t.table("customer").join(t.table("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("region_lookup", "SELECT s_suppkey, coalesce(r_name, 'Unknown') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey")
def _(t):
    regions = t.table("nation").join(t.table("region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.initcap("n_name").alias("country"), F.col("r_name").alias("region"))
    rows = t.table("supplier").join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.col("n_name").alias("country"))
    return ingest.with_region(rows, regions, aliases={}).select("s_suppkey", "region")


@query("relation_load", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")


@query("age_overlap", "SELECT p_partkey, name FROM part JOIN (VALUES ('small', 0, 9), ('middle', 8, 30), ('large', 31, 1000)) AS g(name, lo, hi) ON p_size <= hi AND p_size + 3 >= lo")
def _(t):
    groups = t.spark.createDataFrame([("small", 0, 9), ("middle", 8, 30), ("large", 31, 1000)], "name string, group_low int, group_high int")
    return tagging.overlapping(t.table("part").select("p_partkey", F.col("p_size").alias("low"), (F.col("p_size") + 3).alias("high")), groups).select("p_partkey", "name")


@query("best_source", "SELECT n_nationkey, coalesce(c, s) AS name FROM nation LEFT JOIN (SELECT c_nationkey, min(c_name) AS c FROM customer WHERE c_acctbal > 9900 GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, min(s_name) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def _(t):
    first = t.table("customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("name"))
    second = t.table("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("name"))
    return ingest.best_of(t.table("nation").select("n_nationkey"), "n_nationkey", [first, second], ["name"])


# aggregation
@query("year_source_counts", "SELECT year, source, count(*) AS n FROM {records} WHERE year IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2")
def _(t):
    return stats.year_source_counts(records(t))


@query("country_counts", "SELECT country, count(*) AS n FROM {records} WHERE country <> '' GROUP BY 1")
def _(t):
    return stats.country_counts(records(t))


@query("journal_top3", "SELECT journal, count(*) AS n FROM {records} WHERE journal <> '' GROUP BY 1 ORDER BY n DESC, journal LIMIT 3")
def _(t):
    return stats.top_values(records(t), "journal", 3)


@query("database_topk_in_source", "SELECT database, count(*) AS n FROM {records} WHERE source = '1-URGENT' AND database <> '' GROUP BY 1 ORDER BY n DESC, database LIMIT 4")
def _(t):
    return stats.top_values(records(t).where("source = '1-URGENT'"), "database", 4)


@query("dashboard_rollup", "SELECT 'year_source' AS section, year || '|' || source AS key, count(*) AS n FROM {records} GROUP BY 1, 2 UNION ALL SELECT 'country', country, count(*) FROM {records} GROUP BY 1, 2 UNION ALL SELECT 'journal', journal, count(*) FROM {records} GROUP BY 1, 2")
def _(t):
    return stats.roll_up(records(t), {"year_source": ("year", "source"), "country": ("country",), "journal": ("journal",)})


@query("dashboard_json")
def _(t):
    return stats.dashboard(records(t))


@query("facet_counts", "SELECT 'source' AS category, source AS value, count(*) AS n FROM {records} GROUP BY 1, 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM {records} GROUP BY 1, 2 UNION ALL SELECT 'region', region, count(*) FROM {records} GROUP BY 1, 2")
def _(t):
    return facets.value_counts(records(t), ["source", "year", "region"])


@query("facet_counts_filtered", "SELECT 'source' AS category, source AS value, count(*) AS n FROM {records} WHERE region IN ('ASIA', 'EUROPE') AND amount > 100000 GROUP BY 1, 2 UNION ALL SELECT 'country', country, count(*) FROM {records} WHERE region IN ('ASIA', 'EUROPE') AND amount > 100000 GROUP BY 1, 2")
def _(t):
    rows = P.apply_tree(records(t), payload.grouped_tree([{"type": "inwhere", "column": "region", "value": ["ASIA", "EUROPE"]}, {"type": "greater", "column": "amount", "value": 100000}]))
    return facets.value_counts(rows, ["source", "country"])


@query("tag_facets", "SELECT 'Topics' AS category, code AS value, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct(list_transform(string_split(p_name, ' '), lambda w: left(w, 3)))) AS code FROM part) WHERE length(code) <= 10 AND NOT regexp_matches(code, '^[0-9_]+$') GROUP BY 1, 2")
def _(t):
    return facets.tag_counts(tagged_parts(t), ["topic__hash__vpd__hash__name"])


@query("numeric_stats", "SELECT 'o_totalprice' AS \"column\", CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders UNION ALL SELECT 'o_custkey', CAST(sum(o_custkey) AS DOUBLE), CAST(min(o_custkey) AS DOUBLE), CAST(max(o_custkey) AS DOUBLE) FROM orders")
def _(t):
    rows = t.table("orders").select(F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_custkey")
    return stats.numeric_stats(rows).drop("avg")


@query("column_stats", "SELECT 'user_id' AS \"column\", count(user_id) AS non_null, count(*) - count(user_id) AS nulls, count(DISTINCT user_id) AS distinct_values, CAST(min(user_id) AS DOUBLE) AS min, CAST(max(user_id) AS DOUBLE) AS max FROM events UNION ALL SELECT 'event_type', count(event_type), count(*) - count(event_type), count(DISTINCT event_type), NULL, NULL FROM events")
def _(t):
    return stats.column_stats(t.table("events"), ["user_id", "event_type"])


@query("describe", "SELECT 'lang' AS \"column\", sum(n)::BIGINT AS count, count(*) AS \"unique\", first(v ORDER BY n DESC, v) AS top, max(n) AS freq FROM (SELECT lang AS v, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1) UNION ALL SELECT 'source', sum(n)::BIGINT, count(*), first(v ORDER BY n DESC, v), max(n) FROM (SELECT source AS v, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)")
def _(t):
    return stats.describe(t.table("documents").select("lang", "source"))


@query("duplicate_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return stats.duplicate_keys(t.table("orders"), "o_custkey")


@query("filled_by_source", "SELECT source, count(doc_id) AS doc_id, count(lang) AS lang FROM documents GROUP BY 1")
def _(t):
    return stats.filled_by(t.table("documents").select("source", "doc_id", "lang"), "source")


@query("year_span", "SELECT min(year) AS min_year, max(year) AS max_year FROM {records}")
def _(t):
    return stats.year_span(records(t).withColumn("year", F.col("year").cast("string")))


@query("busiest_year", "SELECT max(n) AS n FROM (SELECT year, count(*) AS n FROM {records} GROUP BY 1)")
def _(t):
    return stats.busiest_year(records(t))


# filters
@query("filter_options", "SELECT DISTINCT 'source' AS \"column\", source AS value FROM {records} UNION SELECT DISTINCT 'year', CAST(year AS VARCHAR) FROM {records} UNION SELECT 'year', '2099'")
def _(t):
    return filters.sorted_options(filters.options(records(t), ["source", "year"], {"year": ["2099"]}))


@query("discover_filters", r"""WITH r AS (SELECT * FROM {records}), f AS (SELECT 'year' AS name, 'numeric' AS family, min(year)::VARCHAR AS low, max(year)::VARCHAR AS high, count(DISTINCT year) AS distinct_values FROM r
UNION ALL SELECT 'amount', 'numeric', min(amount)::VARCHAR, max(amount)::VARCHAR, count(DISTINCT amount) FROM r
UNION ALL SELECT 'source', 'text', NULL, NULL, count(DISTINCT source) FROM r UNION ALL SELECT 'database', 'text', NULL, NULL, count(DISTINCT database) FROM r UNION ALL SELECT 'journal', 'text', NULL, NULL, count(DISTINCT journal) FROM r
UNION ALL SELECT 'country', 'text', NULL, NULL, count(DISTINCT country) FROM r UNION ALL SELECT 'region', 'text', NULL, NULL, count(DISTINCT region) FROM r)
SELECT name AS column, family, upper(name[1]) || name[2:] AS display, low, high, distinct_values FROM f""")
def _(t):
    return filters.discover(records(t))


@query("tag_filters", """
WITH cells AS (SELECT unnest(string_split(p_name, ' ')) AS w, lower(p_type) AS t FROM part)
SELECT 'topic' AS category, 'vpd' AS subgroup, 'name' AS term, 'topic__hash__vpd__hash__name' AS column, list_sort(list(DISTINCT w || ':' || left(w, 3))) AS synonyms FROM cells
UNION ALL SELECT 'outcome', 'kind', 'type', 'outcome__hash__kind__hash__type', list_sort(list(DISTINCT t || ':' || left(t, 4))) FROM cells""")
def _(t):
    return filters.tag_filters(tagged_parts(t))


@query("comma_items", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS value FROM part ORDER BY 1")
def _(t):
    rows = t.table("part").select(F.replace("p_name", F.lit(" "), F.lit(",")).alias("name"))
    return filters.options(rows, ["name"]).select("value").orderBy("value")


# tags
@query("wide_to_long", "SELECT p_partkey, 'topic__hash__vpd__hash__name' AS \"column\", w AS phrase, left(w, 3) AS code FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)")
def _(t):
    return tags.wide_to_long(tagged_parts(t), "p_partkey", ["topic__hash__vpd__hash__name"])


@query("long_to_wide", "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN x END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN x END) AS O FROM (SELECT o_custkey, o_orderstatus, string_agg(DISTINCT o_orderpriority || ':' || left(o_orderpriority, 1), ', ' ORDER BY o_orderpriority || ':' || left(o_orderpriority, 1)) AS x FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(t):
    rows = t.table("orders").select("o_custkey", F.col("o_orderstatus").alias("column"), F.col("o_orderpriority").alias("phrase"), F.left("o_orderpriority", F.lit(1)).alias("code"))
    return tags.long_to_wide(rows, "o_custkey", ["F", "O"])


@query("notes_rollup", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda w: left(w, 3)))), ', ') AS research_notes, left(lower(p_type), 4) AS notes FROM part")
def _(t):
    return tags.add_notes(tagged_parts(t)).select("p_partkey", "research_notes", "notes")


# ingest and writes
@query("first_seen_dedupe", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def _(t):
    return ingest.first_seen(t.table("documents").select("doc_id", F.md5("text").alias("k")), F.col("k"), ["doc_id"])[0].select("doc_id")


@query("later_copies", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1")
def _(t):
    return ingest.first_seen(t.table("documents").select("doc_id", F.md5("text").alias("k")), F.col("k"), ["doc_id"])[1].select("doc_id")


@query("duplicate_rows", "SELECT doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1")
def _(t):
    return ingest.duplicated(t.table("documents").select("doc_id", F.md5("text").alias("k")), "k").select("doc_id")


@query("source_sequence_id", "SELECT doc_id, source || '_' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS id FROM documents")
def _(t):
    return ingest.sequence_ids(t.table("documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "id")


@query("unify_sources", "WITH x AS (SELECT 0 AS s, 'Cochrane' AS source, c_custkey AS i, c_mktsegment || (c_custkey % 97) AS doi FROM customer UNION ALL SELECT 1, 'Medline', s_suppkey, 'BUILDING' || s_suppkey FROM supplier) SELECT source, lower(doi) AS cleaned_doi, source || '_' || row_number() OVER (PARTITION BY source ORDER BY i) AS id FROM x QUALIFY row_number() OVER (PARTITION BY lower(doi) ORDER BY s, i) = 1")
def _(t):
    first = t.table("customer").select(F.col("c_name").alias("cd_identifier"), F.concat(F.lit("https://doi.org/"), "c_mktsegment", F.col("c_custkey") % 97).alias("doi"), F.col("c_custkey").alias("row_idx"))
    second = t.table("supplier").select(F.col("s_name").alias("pmid"), F.concat(F.lit("BUILDING"), "s_suppkey").alias("doi"), F.col("s_suppkey").alias("row_idx"))
    return ingest.unify({"Cochrane": first, "Medline": second})[0].select("source", "cleaned_doi", "id")


@query("infer_types", r"""WITH u AS (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM orders) ON COLUMNS(*) INTO NAME name VALUE v)
SELECT name, CASE WHEN bool_and(regexp_full_match(v, '[+-]?\d+') AND TRY_CAST(v AS INTEGER) IS NOT NULL) THEN 'int' WHEN bool_and(regexp_full_match(v, '[+-]?\d+') AND TRY_CAST(v AS BIGINT) IS NOT NULL) THEN 'bigint'
WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END AS type, TRUE AS nullable,
(list_position(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'], name) - 1)::INTEGER AS position FROM u GROUP BY name""")
def _(t):
    texts = t.table("orders").select(*(F.col(c).cast("string").alias(c) for c in t.table("orders").columns))
    return column_info(ingest.clean_types(texts, ingest.infer_types(texts)))


@query("typed_clean", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(trunc(value) >= 50, FALSE) AS large FROM events")
def _(t):
    k = F.get_json_object("props", "$.k")
    return t.table("events").select("event_id", numbers.typed(k, T.IntegerType()).alias("k"), numbers.from_year(F.col("value").cast("string"), 50).alias("large"))


@query("upsert_merge", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS s_name, s_nationkey FROM supplier UNION ALL SELECT s_suppkey + 100000, 'new', s_nationkey FROM supplier WHERE s_suppkey % 5 = 0")
def _(t):
    old = t.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
    changed = old.where("s_suppkey % 3 = 0").withColumn("s_name", F.lit("new"))
    added = old.where("s_suppkey % 5 = 0").withColumns({"s_suppkey": F.col("s_suppkey") + 100000, "s_name": F.lit("new")})
    return writes.merge(old, changed.unionByName(added), "s_suppkey")


@query("update_where", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_nationkey = 3 THEN c_custkey + 5 ELSE c_custkey END AS k FROM customer")
def _(t):
    rows = t.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey", F.col("c_custkey").alias("k"))
    return writes.increment(writes.update_where(rows, F.col("c_acctbal") < 0, {"c_mktsegment": "DEBT"}), F.col("c_nationkey") == 3, "k", 5).select("c_custkey", "c_mktsegment", "k")


@query("delete_where", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, FALSE)")
def _(t):
    return writes.delete_where(t.table("customer"), F.col("c_acctbal") < 0).select("c_custkey")


@query("insert_absent", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'ATLANTIS'")
def _(t):
    rows = t.spark.createDataFrame([(100, "ATLANTIS"), (1, "AGAIN"), (None, "NONE")], "n_nationkey int, n_name string")
    return writes.insert_absent(t.table("nation").select("n_nationkey", "n_name"), rows, "n_nationkey")


@query("key_values", "SELECT event_type AS key, arg_max(event_id, event_id)::VARCHAR AS value FROM events GROUP BY 1")
def _(t):
    rows = t.table("events").select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), "event_id")
    return writes.put_values(t.spark.createDataFrame([], "key string, value string"), rows, "event_id")


@query("tracker_pending", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def _(t):
    return batches.pending(t.table("events").select("event_id"), t.table("events").where("event_type = 'click'"), "event_id")


@query("id_batches", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS batch FROM events")
def _(t):
    return batches.in_batches(t.table("events").select("event_id"), "event_id", 100)


# functions
@query("normalize_url", "SELECT page_id, regexp_replace(lower(trim(url)), '^(https?://)?(dx\\.)?doi\\.org/', '') AS plain, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host FROM pages")
def _(t):
    return t.table("pages").select("page_id", identifiers.normalise_doi(F.col("url")).alias("plain"), F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1).alias("host"))


@query("host_label", "SELECT page_id, string_split(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1), '.')[-2] AS label FROM pages")
def _(t):
    return t.table("pages").select("page_id", identifiers.host_label(F.col("url")).alias("label"))


@query("sentence_counts", "SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda x: trim(x)), lambda x: length(x) >= 20)) AS n FROM documents")
def _(t):
    parts = F.filter(F.transform(F.split("text", r"[.!?]+\s+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 20)
    return t.table("documents").select("doc_id", F.size(parts).alias("n"))


@query("sentences")
def _(t):
    return t.table("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))


@query("number_words")
def _(t):
    return t.table("part").select("p_partkey", numbers.int_to_words(F.col("p_partkey")).alias("words")).withColumn("back", numbers.words_to_int(F.col("words")))


@query("extract_year", "SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '(\\d{3,4})', 1), '') AS INTEGER) AS number FROM pages")
def _(t):
    return t.table("pages").select("page_id", F.nullif(F.regexp_extract("url", r"(\d{3,4})", 1), F.lit("")).try_cast("int").alias("number"))


@query("html_titles", """
SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title,
  len(regexp_extract_all(html, '(?i)<a\\s[^>]*href="[^"]*"')) AS links, len(regexp_extract_all(html, '(?i)<table[\\s/>]')) AS tables, len(regexp_extract_all(html, '(?i)<h[1-4][\\s>]')) AS headings,
  length(trim(regexp_replace(list_reduce(list_prepend(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<noscript\\b.*?</noscript\\s*>|<footer\\b.*?</footer\\s*>|<!--.*?-->|<[^>]*>', ' ', 'g'), ['&lt;', '&gt;', '&quot;', '&#39;', '&nbsp;', '&amp;']), lambda a, b: replace(a, b, CASE b WHEN '&nbsp;' THEN ' ' ELSE '*' END)), '\\s+', ' ', 'g'))) AS text_length
FROM pages""")
def _(t):
    return t.table("pages").select("page_id", html.title(F.col("html")).alias("title"), F.size(html.links(F.col("html"))).alias("links"), F.size(html.tables(F.col("html"))).alias("tables"), F.size(html.headings(F.col("html"))).alias("headings"), F.length(text.html_text(F.col("html"))).alias("text_length"))


@query("json_rows")
def _(t):
    return files.row_json(t.table("nation"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return batches.windowed_counts(t.table("events"))


# texts
TERMS = [("license", "kind", "apache", "apache license", "apa"), ("license", "kind", "mit", "mit license", "mit"), ("word", "en", "the", "the", "the"), ("word", "de", "der", "der", "der")]


@query("term_tagging", "SELECT doc_id, code FROM documents, (VALUES ('apache license', 'apa'), ('mit license', 'mit'), ('the', 'the'), ('der', 'der')) AS v(phrase, code) WHERE regexp_matches(text, '(?i)\\b' || phrase || '\\b')")
def _(t):
    return tagging.tag_terms(t.table("documents"), TERMS).select("doc_id", "code")


@query("tag_columns")
def _(t):
    return tagging.tag_columns(tagging.tag_terms(t.table("documents"), TERMS), TERMS)


@query("sentence_term_counts", """
WITH parts AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents),
words AS (SELECT doc_id, ' ' || regexp_replace(lower(sentence), '[^\\p{L}\\p{N}_]+', ' ', 'g') || ' ' AS sentence FROM parts)
SELECT doc_id, code, count(*) AS n FROM words, (VALUES ('the', 'the', 'the'), ('der', 'der', 'und')) v(code, a, b) WHERE contains(sentence, ' ' || a || ' ') OR contains(sentence, ' ' || b || ' ') GROUP BY ALL""")
def _(t):
    return tagging.sentence_counts(t.table("documents"), [("the", "the"), ("der", "der"), ("und", "der")])


@query("section_split", "SELECT conv_id, role AS section, first(regexp_replace(text, '^\\s+|\\s+$', '', 'g') ORDER BY turn) AS body FROM conversations GROUP BY 1, 2")
def _(t):
    rows = t.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(F.lit("===== "), x["role"], F.lit(" =====\n"), x["text"])), "\n")
    return rows.select("conv_id", F.explode(tagging.sections(whole)).alias("section", "body"))


@query("appraisal_items")
def _(t):
    return appraisal.appraise(t.table("documents").select("doc_id", "text")).drop("text", "amstar_label", "amstar_flaws", "amstar_met")


@query("appraisal_label", "SELECT doc_id, CASE WHEN c >= 2 THEN 'Critically Low' WHEN c = 1 THEN 'Low' WHEN s >= 2 THEN 'Moderate' ELSE 'High' END AS label FROM (SELECT doc_id, (quality = 0)::INT + (toxic = 1)::INT AS c, (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT AS s FROM labels)")
def _(t):
    said = lambda c: F.when(c, "No").otherwise("Yes")
    answers = {2: said(F.col("quality") == 0), 4: said(F.col("toxic") == 1), 1: said(F.col("doc_id") % 2 == 0), 3: said(F.col("doc_id") % 3 == 0)}
    return t.table("labels").select("doc_id", appraisal.label(answers)[0].alias("label"))


# retrieval, spans, QA
@query("cosine_topk", "SELECT a.vec_id AS query, b.vec_id, row_number() OVER w AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 WINDOW w AS (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) DESC, b.vec_id) QUALIFY rank <= 5")
def _(t):
    rows = t.table("embeddings")
    return retrieval.top_k(rows.where("vec_id % 20 = 0"), rows, 5).select("query", "vec_id", "rank")


@query("ir_map_at_k", """
WITH near AS (SELECT a.vec_id AS query, b.vec_id, (a.label = b.label)::INT AS hit, row_number() OVER w AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 WINDOW w AS (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) DESC, b.vec_id) QUALIFY rank <= 10),
hits AS (SELECT query, rank, coalesce(hit, 0) AS hit, sum(coalesce(hit, 0)) OVER (PARTITION BY query ORDER BY rank) AS found FROM near)
SELECT cutoff, round(avg(ap), 6) AS map_at_k FROM (SELECT cutoff, query, sum(hit * found / rank::DOUBLE) / greatest(sum(hit), 1) AS ap FROM hits, (VALUES (1), (3), (5), (10)) c(cutoff) WHERE rank <= cutoff GROUP BY ALL) GROUP BY cutoff""")
def _(t):
    rows = t.table("embeddings")
    near = retrieval.top_k(rows.where("vec_id % 20 = 0"), rows, 10).join(rows.select("vec_id", "label"), "vec_id")
    near = near.join(rows.select(F.col("vec_id").alias("query"), F.col("label").alias("own")), "query")
    return retrieval.average_precision(near, F.col("label") == F.col("own"))


@query("hard_negatives")
def _(t):
    rows = t.table("embeddings")
    return mining.hard_negatives(rows.where("vec_id % 20 = 0"), rows, 5)


@query("best_answer", "SELECT user_id, event_type AS answer, value AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type DESC) = 1 AND value > 0.1")
def _(t):
    return retrieval.best_answer(t.table("events").select("user_id", F.col("event_type").alias("answer"), F.col("value").alias("score")), "user_id")


@query("exact_split", "SELECT doc_id, CASE WHEN (row_number() OVER w) - 1 < floor(0.7 * count(*) OVER ()) THEN 'train' WHEN (row_number() OVER w) - 1 < floor(0.85 * count(*) OVER ()) THEN 'dev' ELSE 'test' END AS split FROM documents WINDOW w AS (ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id)")
def _(t):
    return qa.exact_split(t.table("documents").select("doc_id"), "doc_id", {"train": 0.7, "dev": 0.15, "test": 0.15}, "7")


@query("token_f1", """
WITH said AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '(^|[^\\p{L}\\p{N}_])(a|an|the)([^\\p{L}\\p{N}_]|$)', '\\1 \\3', 'g'), '(^|[^\\p{L}\\p{N}_])(a|an|the)([^\\p{L}\\p{N}_]|$)', '\\1 \\3', 'g'), '[^\\p{L}\\p{N}_\\s%./=-]', ' ', 'g'), '\\s+', ' ', 'g')) AS said FROM conversations WHERE turn < 2),
pairs AS (SELECT conv_id, g.said AS gold, f.said AS found FROM said g JOIN said f USING (conv_id) WHERE g.turn = 0 AND f.turn = 1),
bags AS (SELECT conv_id, gold, found, list_filter(string_split(gold, ' '), lambda x: x <> '') AS g, list_filter(string_split(found, ' '), lambda x: x <> '') AS p FROM pairs),
shared AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) AS n FROM bags)
SELECT conv_id, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 WHEN n = 0 THEN 0 ELSE 2 * (n / len(p)) * (n / len(g)) / (n / len(p) + n / len(g)) END, 6) AS f1, (gold = found)::INT::DOUBLE AS em FROM shared""")
def _(t):
    a, b = t.table("conversations").where("turn = 0"), t.table("conversations").where("turn = 1")
    rows = a.select("conv_id", F.col("text").alias("gold")).join(b.select("conv_id", F.col("text").alias("found")), "conv_id")
    return rows.select("conv_id", F.round(qa.token_f1(F.col("found"), F.col("gold")), 6).alias("f1"), qa.exact_match(F.col("found"), F.col("gold")).alias("em"))


@query("cap_repeats", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 3")
def _(t):
    return spans.cap_repeats(t.table("events"), ["user_id", "event_type"], "event_id", 3).select("event_id")


@query("limit_per_label", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('1:' || event_id), event_id) <= 7")
def _(t):
    return spans.limit_shuffled(t.table("events"), ["event_type"], "event_id", 7, seed=1).select("event_id")


@query("regex_spans", r"""WITH parts AS (SELECT doc_id, 'EMAIL' AS label, regexp_extract_all(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+') AS ms, regexp_split_to_array(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+') AS gaps FROM documents
UNION ALL SELECT doc_id, 'YEAR', regexp_extract_all(text, '\b(?:19|20)\d\d\b'), regexp_split_to_array(text, '\b(?:19|20)\d\d\b') FROM documents),
x AS (SELECT doc_id, label, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM parts),
s AS (SELECT doc_id, label, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, label ORDER BY i) AS stop FROM x)
SELECT doc_id, (stop - length(m))::INTEGER AS start, stop::INTEGER AS "end", label FROM s
WHERE label = 'EMAIL' OR NOT EXISTS (SELECT 1 FROM s AS o WHERE o.label = 'EMAIL' AND o.doc_id = s.doc_id AND s.stop - length(s.m) < o.stop AND o.stop - length(o.m) < s.stop)""")
def _(t):
    found = spans.regex_spans(F.col("text"), {"EMAIL": r"[\w.+-]++@[\w-]+(?:\.[\w-]+)+", "YEAR": r"\b(?:19|20)\d\d\b"})
    return t.table("documents").select("doc_id", F.explode(spans.keep_longest(found)).alias("s")).select("doc_id", "s.*")


@query("text_chunks")
def _(t):
    return t.table("documents").select("doc_id", F.explode(spans.chunks(F.col("text"))).alias("c")).select("doc_id", "c.start", "c.end")


@query("mined_examples", r"""WITH cut AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)) || list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS parts FROM documents),
rows AS (SELECT doc_id, parts, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS i FROM cut),
u AS (SELECT doc_id, sentence, min(i) AS i, regexp_matches(sentence, '(?i)licen[cs]e') AS told FROM rows WHERE sentence <> '' GROUP BY doc_id, sentence),
plain AS (SELECT doc_id, list(sentence ORDER BY i)[1:4] AS negatives FROM u WHERE NOT told GROUP BY doc_id),
hits AS (SELECT sentence AS positive, coalesce(negatives, []) AS negatives FROM u LEFT JOIN plain USING (doc_id) WHERE told)
SELECT 'license' AS slot, query, positive, min(negatives) AS negatives FROM hits, (VALUES ('which license applies'), ('license')) AS q(query) GROUP BY query, positive""")
def _(t):
    return mining.mine(t.table("documents"), {"license": (r"(?i)licen[cs]e", ["which license applies", "license"])})


@query("date_mentions", r"""SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(text, '(?i)\b(?:\d{1,2}(?:st|nd|rd|th)?\s+(?:January|February|March|April|May|June|July|August|September|October|November|December),?\s+\d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December),?\s+\d{4}|\d{4}-\d{2}-\d{2})\b'),
lambda x: {'d': try_strptime(regexp_replace(regexp_replace(x, '(\d)(st|nd|rd|th)\b', '\1', 'g'), ',\s*', ' ', 'g'), ['%d %B %Y', '%B %d %Y', '%B %Y', '%Y-%m-%d'])::DATE, 'x': x}), lambda s: s.d IS NOT NULL)).x AS latest FROM documents""")
def _(t):
    return t.table("documents").select("doc_id", dates.latest_of(dates.date_mentions(F.col("text"))).alias("latest"))
