"""The CSV round trip on texts that CSV writes in a way of its own, held against the query's SQL."""

import duckdb

from catalume import review_queries  # noqa: F401  it adds its queries
from catalume.queries import ORACLE_SQL, QUERIES


def test_empty_is_not_null(spark, tmp_path):
    """An empty text, language or source comes back as it was, as do a missing one and texts that look like either."""
    texts = ["", None, '"', '""', "null", " ", "\n", "\r\n", "a", ",", "\\N"]
    rows = [(i, t, ("en", "", None)[i % 3], ("web", "", None)[i % 2]) for i, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.sql(ORACLE_SQL["csv_round_trip"])
    found = QUERIES["csv_round_trip"](spark, str(tmp_path)).select(*wanted.columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted.fetchall()))
