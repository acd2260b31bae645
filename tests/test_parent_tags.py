"""Terms rolled up to their parents, by phrases and by age ranges."""

import pytest
from catalume.operators import tagging
from catalume.text_queries import GROUPS


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("ages 0 - 1 years,", {"Population#AgeGroup": "Newborn_0-1"}),
        ("older than 20 years, and 0 to 3 years", {"Population#AgeGroup": "Adults_18-64, Newborn_0-1"}),
        ("greater than 20 years, newborn", {"Population#AgeGroup": "Adults_18-64, Newborn_0-1, OlderAdults_65-10000"}),
        ("trials with older adults", {"Population#AgeGroup": "Adults_18-64, OlderAdults_65-10000"}),
        ("Safety and efficacy", {"Topic#Effect": "Efficacy, Safety"}),
        ("nothing of the kind", {}),
        (None, {}),
    ],
)
def test_parents(spark, text, wanted):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r["parent"]: r["terms"] for r in tagging.parent_tags(df, GROUPS).collect()} == wanted
