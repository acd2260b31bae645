import pytest
from pyspark.sql import functions as F

from catalume.plans import payload
from catalume.plans import predicates as P
from catalume.plans.query import NotFound, Query


@pytest.fixture(scope="module")
def truth(spark):
    rows = [(i, bool(i & 4), bool(i & 2), bool(i & 1)) for i in range(8)]
    return spark.createDataFrame(rows, "id int, a boolean, b boolean, c boolean")


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_or_filters_split_and_either(truth):
    q = lambda mode: Query(truth, mode=mode).where("a", True).or_where("b", True).or_where("c", True).rows()
    assert ids(q("split")) == [5, 6, 7]
    assert ids(q("either")) == [1, 2, 3, 4, 5, 6, 7]


def test_builder_is_immutable(truth):
    q = Query(truth)
    q.where("a", True).limit(1)
    assert q.count() == 8


def test_limit_zero_is_empty(truth):
    assert Query(truth).limit(0).count() == 0


def test_deep_tree_and_unknown_clauses(truth):
    tree = {"logic": "OR", "conditions": [{"logic": "AND", "conditions": [{"field": "a", "operator": "=", "value": True}, {"logic": "OR", "conditions": [{"field": "b", "operator": "=", "value": True}, {"field": "nope", "operator": "=", "value": 1}]}]}, {"field": "id", "operator": "what", "value": 3}, {"field": "ID", "operator": "in", "values": [0]}]}
    assert ids(P.apply_tree(truth, tree)) == [0, 6, 7]
    assert ids(P.apply_tree(truth, {})) == list(range(8))


def test_null_values(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    assert ids(Query(df).where("v", None).rows()) == [1]
    assert ids(Query(df).where("v", "!=", None).rows()) == [2]
    assert ids(Query(df).where_null("v").rows()) == [1]
    assert ids(Query(df).where_in("v", []).rows()) == []
    assert ids(Query(df).where_not_in("v", ["y"]).rows()) == [2]


def test_wildcards_and_escape(spark):
    df = spark.createDataFrame([(1, "50%"), (2, "500"), (3, "a_b"), (4, "axb")], "id int, v string")
    at = lambda v, e: ids(P.apply_tree(df, {"field": "v", "operator": "contains", "value": v}, escape=e))
    assert at("50%", False) == [1, 2] and at("50%", True) == [1]
    assert at("a_b", False) == [3, 4] and at("a_b", True) == [3]


def test_pages(truth):
    rows, info = Query(truth).order_by("id").paginate(3, 3)
    assert ids(rows) == [6, 7] and info["pages"] == 3 and not info["has_next"]
    rows, info = Query(truth).order_by("id").paginate(9, 4)
    assert ids(rows) == [] and info["total"] == 8 and info["pages"] == 2
    groups, info = Query(truth).group_by("a").aggregate("count", "*", "n").order_by("a").paginate(1, 1)
    assert groups.count() == 1 and info["total"] == 2


def test_terminals(truth):
    q = Query(truth).order_by("id")
    assert q.first()["id"] == 0 and q.value("id") == 0 and q.find(3, "id")["id"] == 3
    assert q.exists() and Query(truth).where("id", 99).doesnt_exist()
    with pytest.raises(NotFound):
        q.find_or_fail(99, "id")
    seen = []
    assert q.chunk(3, lambda rows: seen.append(len(rows))) == 8 and seen == [3, 3, 2]
    with pytest.raises(AttributeError):
        q.select("nope")
    with pytest.raises(ValueError):
        q.select_valid("nope")
    with pytest.raises(ValueError):
        q.aggregate("drop_table", "id", "x")


def test_null_order(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 4)], "id int, v int")
    order = lambda d: [r["id"] for r in Query(df).order_by("v", d).rows().collect()]
    assert order("asc") == [3, 2, 1] and order("desc") == [1, 2, 3]


def test_payload_types_and_groups(spark):
    df = spark.createDataFrame([(1, "x:eff", None), (2, "y", "e:q"), (3, None, None)], "id int, topic__hash__a string, topic__hash__b string")
    filters = [{"type": "likewhere", "column": "topic__hash__a", "value": ":eff"}, {"type": "isnotnull", "column": "topic__hash__b"}, {"type": "unknown", "column": "id"}]
    assert ids(payload.run_payload(df, {"filters": filters})[0]) == [1, 2]
    assert ids(payload.run_payload(df, {"filters": [{"type": "notinwhere", "column": "id", "value": [1]}, {"type": "isnull", "column": "topic__hash__b"}], "filter_operator": "AND"})[0]) == [3]
    rows, page = payload.run_payload(df, {"filters": [], "columns": ["ID", "zzz"], "order_by": {"column": "id"}, "pagination": {"page": 2, "page_size": 2}})
    assert rows.columns == ["id"] and ids(rows) == [3] and page["total"] == 3


def test_dynamic_search(spark):
    df = spark.createDataFrame([(1, "Alpha", 5), (2, "beta", 6)], "id int, name string, n int")
    assert ids(payload.dynamic_search(df, {"query": "ALP"})) == [1]
    assert ids(payload.dynamic_search(df, {})) == [1, 2]
    assert ids(payload.search_all_columns(df, "6")) == [2]
    assert ids(payload.field_search(df, {"name": "a", "n": "5"})) == [1]
    assert payload.valid_value(df, "n", "5") and not payload.valid_value(df, "n", "x") and not payload.valid_value(df, "q", 1)


def test_flags_and_members(spark):
    df = spark.createDataFrame([(1, "{'Africa': True, 'Asia': False}"), (2, "flu, HPV"), (3, None)], "id int, v string")
    assert ids(P.apply_tree(df, {"field": "v", "operator": "has_flag", "value": "Africa"})) == [1]
    assert ids(payload.by_members(df, {"v": ["hpv"]})) == [2]
    with pytest.raises(KeyError):
        payload.by_members(df, {"w": ["x"]})
    assert df.where(F.col("id") > 1).count() == 2
