"""Searches by packs of rows and queries, held against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from catalume.operators import retrieval


def by_hand(queries, rows, k, unlike):
    def similarity(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        dot, aa, bb = (sum(x * y for x, y in zip(u, v)) for u, v in ((a, b), (a, a), (b, b)))
        return None if not aa or not bb else math.nan if math.isnan(dot + aa + bb) else round(dot / (math.sqrt(aa) * math.sqrt(bb)), 6)

    out = []
    for q, v, own in queries:
        scored = [(similarity(v, w), key) for key, w, label in rows if None not in (key, q) and key != q and (not unlike or (own is not None and label is not None and label != own))]
        scored.sort(key=lambda x: (x[0] is None, not (x[0] is not None and math.isnan(x[0])), 0 if x[0] is None or math.isnan(x[0]) else -x[0], x[1]))
        out += [(q, key, s, i + 1) for i, (s, key) in enumerate(scored[:k])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("unlike", [None, "label"])
@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("pack", [1 << 20, 200])
def test_packs(spark, monkeypatch, pack, odd, unlike):
    """Copies, near copies, opposites and tables of several packs; odd ones: missing vectors and components, without direction, of other lengths, not numbers, missing keys and labels."""
    monkeypatch.setattr(retrieval, "PACK", pack, raising=False)
    monkeypatch.setattr(retrieval, "QUERIES", 7 if pack == 200 else 4096, raising=False)
    monkeypatch.setattr(retrieval, "BLOCK", 14 if pack == 200 else 32_768)
    dice = random.Random(3)
    base = [[float(dice.randint(-3, 3)) + 0.5 for _ in range(5)] for _ in range(60)]
    rows = [(f"k{i:03d}", [x * dice.choice((1.0, 1.0, 2.0, -1.0)) + 0 * i for x in base[i % 60]], dice.choice("abc")) for i in range(200)]
    if odd:
        rows[3:12] = [(f"k{i:03d}", v, label) for i, v, label in ((3, None, "a"), (4, [], "a"), (5, [0.0] * 5, "b"), (6, [1.0, None, 2.0, 0.0, 1.0], "c"), (7, [1.0, 2.0], "a"), (8, [2.0, 4.5], "b"), (9, [math.nan] * 5, "a"), (10, base[0], None), (11, base[1], "d"))]
        rows[150] = (None, base[0], "a")
    table = spark.createDataFrame(rows, "id string, v array<double>, label string")
    asked = [r for i, r in enumerate(rows) if i % 3 == 0 or 3 <= i < 12]
    found = retrieval.top_k(spark.createDataFrame(asked, table.schema), table, 4, "id", "v", unlike)
    assert found.columns == ["query", "id", "similarity", "rank"]
    assert sorted(repr((r["query"], r["id"], None if r["similarity"] is None else r["similarity"] + 0.0, r["rank"])) for r in found.collect()) == by_hand(asked, rows, 4, unlike)


def test_rows_are_read_once(spark):
    """Thousands of queries meet the rows in one pass."""
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("embedding"))
    found = retrieval.top_k(rows.where("vec_id % 2 = 0"), rows, 2)
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastNestedLoopJoin") == 1
    assert found.count() == 3000 and found.agg(F.max("rank")).first()[0] == 2


def test_nothing_to_find(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    assert retrieval.top_k(rows, rows, 3).isEmpty() and retrieval.top_k(rows.where("vec_id = 2"), rows, 3).isEmpty() and retrieval.top_k(rows, rows.where("vec_id = 2"), 3).isEmpty()
