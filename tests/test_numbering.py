"""Places in the order of a column, and the dashboard's one row."""

import json
import random

import pytest
from catalume.operators import numbering, stats


@pytest.mark.parametrize("values", [[*range(3000)], [0] * 50 + [10**9 + i for i in range(2000)], [f"k{i % 700:04}" for i in range(2000)], [None, None, 5, 1], []])
def test_places(spark, values):
    """Skewed, repeated, text and null values, in two groups of very different size and a null one."""
    values = random.Random(1).sample(values, len(values))
    rows = [(v, [None, "b", "a", "a", "a", "a"][i % 6]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"v {'string' if values and isinstance(values[0], str) else 'long'}, g string")
    for group in ((), ("g",)):
        found = numbering.with_places(df, "v", group).collect()
        assert len(found) == len(rows)
        for g in {r["g"] if group else 0 for r in found}:
            mine = sorted((r["place"], r["v"]) for r in found if not group or r["g"] == g) if None not in values else sorted(((r["place"], r["v"]) for r in found if not group or r["g"] == g), key=lambda x: x[0])
            assert [p for p, _ in mine] == [*range(len(mine))]
            ordered = [(v is not None, v or 0) if not isinstance(v, str) else (True, v) for _, v in mine]
            assert ordered == sorted(ordered)


def test_dashboard(spark):
    df = spark.createDataFrame([(2000, "a", "X"), (2000, "a", "X"), (None, "b", None), (1999, None, "Y")], "year int, source string, country string")
    row = stats.dashboard(df).first()
    assert json.loads(row["year_source"]) == [{"source": "b", "n": 1}, {"year": 1999, "n": 1}, {"year": 2000, "source": "a", "n": 2}]
    assert json.loads(row["country"]) == [{"country": "X", "n": 2}, {"country": "Y", "n": 1}] and row["journal"] == "[]"
    assert json.loads(row["source"]) == [{"source": "a", "n": 2}, {"source": "b", "n": 1}]
    assert [*stats.dashboard(df.where("false")).first()] == ["[]"] * 5


def test_few_values_fill_all_ranges(spark):
    """50 values, one of them a third of all rows: most ranges have rows, the largest has a few hundredths of them."""
    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS v")
    cuts = numbering.bounds(df, "v")
    assert len(cuts) == 63 and len(set(cuts)) > 30 and cuts.count(7) > 15
    plan = numbering.with_places(df, "v")
    found = plan.collect()
    assert sorted(r["place"] for r in found) == [*range(20_000)]
    assert [r["v"] for r in sorted(found, key=lambda r: r["place"])] == sorted(r["v"] for r in found)
    below = lambda v: sum(c < v for c in cuts)
    upto = lambda v: sum(c <= v for c in cuts)
    assert len({x for v in range(50) for x in range(below(v), upto(v) + 1)}) >= 40
