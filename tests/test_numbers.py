"""Number words beyond those that the query's SQL has words for."""

from pyspark.sql import functions as F

from catalume.functions import numbers


def test_words_of_large_numbers(spark):
    """Every number below 10^9 has words that read as the number itself; others have none."""
    told = {99_999: "ninety-nine thousand nine hundred ninety-nine", 100_000: "one hundred thousand", 119_084: "one hundred nineteen thousand eighty-four", 1_000_000: "one million", 1_199_007: "one million one hundred ninety-nine thousand seven"}
    some = [0, 999_999, 1_000_001, 1_001_000, 20_000_000, 305_017_240, 999_999_999]
    rows = spark.createDataFrame([(n,) for n in (*told, *some, -1, 1_000_000_000, None)], "n long").withColumn("words", numbers.int_to_words(F.col("n"))).withColumn("back", numbers.words_to_int(F.col("words"))).collect()
    assert {r["n"]: r["words"] for r in rows if r["n"] in told} == told
    assert [r["back"] for r in rows] == [*told, *some, None, None, None]
