"""Features of long runs of letters."""

import numpy as np
import pytest
from catalume.llm import common, langid
from pyspark.sql import functions as F


def test_features_of_a_whole_run():
    found = set(langid.word_features("a" * 60 + "xyz"))
    assert {"sxyz>", "xyz", "yz", "axy", "p<aa"} <= found and "saaa>" not in found


def test_passages(spark):
    """Passages cover a text from end to end, whatever its lines; those that are too long are cut, those without letters are none."""
    words = [f"w{i}" for i in range(150)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "x" * 5000), (3, " 12 34 "), (4, ""), (5, None)], "doc_id long, text string")
    found = {r[0]: r[1] for r in df.select("doc_id", langid.passages(F.col("text"))).collect()}
    assert found == {1: [" ".join(words[i : i + 60]) for i in (0, 60, 120)], 2: ["x" * 2000, "x" * 2000, "x" * 1000], 3: [], 4: None, 5: None}


def test_sample_is_bounded_and_stable(spark):
    rows = [(i, f"{'lorem ipsum dolor' if i % 2 else 'quick brown foxes'} number {chr(97 + i % 26) * 3} " * 100, ("la", "en")[i % 2 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (langid.train(df.repartition(n), 20, 2) for n in (3, 7))
    assert one["labels"] == ["en", "la"] and np.array_equal(one["weights"], two["weights"])


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([(i, "some words", f"l{i}") for i in range(30)], "doc_id long, text string, lang string"))


def test_discarded_tables(spark):
    df = common.materialize(spark.range(10), "gone")
    assert df.count() == 10
    common.discard(df)
    with pytest.raises(Exception, match="(?i)path|file"):
        df.sparkSession.read.parquet(df.inputFiles()[0]).count()


def test_join_spread(spark):
    """Every row is joined once, whether its key has one row or many, also those without anything to tell them apart."""
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, 7).otherwise(F.col("id")).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    told = rows.select("k").distinct().where("k <> 2950").withColumn("twice", F.col("k") * 2)
    found = common.join_spread(rows, told, "k", F.xxhash64("v"))
    assert found.columns == ["k", "v", "twice"] and found.count() == 2999 and found.where("twice <> 2 * k").isEmpty()
    assert found.where("k = 7").count() == 2900
