"""Question-answering examples, splits and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_normal


def exact_split(df: DataFrame, key: str, shares: dict[str, float], seed: str = "0") -> DataFrame:
    """``df`` with `split`, of exact sizes: rows in the order of the MD5 of key and seed, cut at the shares.

    Places in that order come from the counts of 4096 hash buckets and the rows' ranks in their own bucket.
    """
    rows = df.withColumn("__md5", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))).withColumn("__b", F.substring("__md5", 1, 3))
    counts = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # 4096 rows at most
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__total"))
    starts = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    starts = starts.crossJoin(total)
    place = F.col("__start") + F.row_number().over(Window.partitionBy("__b").orderBy("__md5", key)) - 1
    rows = rows.join(F.broadcast(starts), "__b").withColumn("__place", place)
    name, edge = F.lit(list(shares)[-1]), sum(shares.values())
    for split, share in reversed(list(shares.items())[:-1]):
        edge -= shares[list(shares)[list(shares).index(split) + 1]]
        name = F.when(F.col("__place") < F.floor(F.lit(round(edge, 9)) * F.col("__total")), split).otherwise(name)
    return rows.withColumn("split", name).select(*df.columns, "split")


def context_window(text: Column, start: Column, end: Column, size: int = 1200) -> Column:
    """Struct begin, context: up to ``size`` characters around an answer, cut at sentence or line ends where the answer stays inside."""
    begin = F.greatest((start + end - size) / 2, F.lit(0)).cast("int")
    raw = F.substr(text, begin + 1, F.lit(size))
    lead = F.when(begin > 0, F.coalesce(F.length(F.regexp_extract(F.substr(raw, F.lit(1), F.greatest(start - begin, F.lit(0))), r"(?s)^.*?[\n.!?]\s*", 0)), F.lit(0))).otherwise(0)
    inside = F.substr(raw, lead + 1)
    rest = end - begin - lead
    tail = F.regexp_extract(F.substr(inside, rest + 1), r"(?s)^.*[\n.!?]", 0)
    cut = F.when((F.length(tail) > 0) & (begin + size < F.length(text)), F.substr(inside, F.lit(1), rest + F.length(tail))).otherwise(inside)
    return F.struct((begin + lead).alias("begin"), cut.alias("context"))


def squad_examples(spans: DataFrame, questions: dict[str, str], per_label: int = 3, seed: int = 0) -> DataFrame:
    """id, doc_id, question, context, answers from spans (doc_id, text, start, end, label): at most ``per_label`` of a label and document, chosen by hash; only answers that stand where they should."""
    table = F.create_map(*(F.lit(x) for kv in questions.items() for x in kv))
    rows = spans.withColumn("question", table[F.col("label")]).where("question IS NOT NULL").withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), "doc_id", "label", "start", "end")))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("__h"))).where(F.col("__n") <= per_label)
    rows = rows.withColumn("__c", context_window(F.col("text"), F.col("start"), F.col("end")))
    answer = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    at = F.col("start") - F.col("__c.begin")
    rows = rows.where(F.substr(F.col("__c.context"), at + 1, F.length(answer)) == answer)
    return rows.select(F.concat_ws("-", "doc_id", "label", "__n").alias("id"), "doc_id", "question", F.col("__c.context").alias("context"), F.struct(F.array(answer).alias("text"), F.array(at).alias("answer_start")).alias("answers"))


def unanswerable(docs: DataFrame, spans: DataFrame, questions: dict[str, str], most: int = 3) -> DataFrame:
    """doc_id, question for up to ``most`` labels that a document has no span of, in the labels' order."""
    asked = docs.select("doc_id", F.posexplode(F.array(*(F.struct(F.lit(k).alias("label"), F.lit(v).alias("question")) for k, v in questions.items()))).alias("i", "q")).select("doc_id", "i", "q.*")
    free = asked.join(spans.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_anti")
    return free.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))).where(F.col("__n") <= most).select("doc_id", "question")


def exact_match(found: Column, gold: Column) -> Column:
    return F.when(answer_normal(found) == answer_normal(gold), 1.0).otherwise(0.0)


def token_f1(found: Column, gold: Column) -> Column:
    """F1 over the bag of words of two normalised answers."""
    tokens = lambda c: F.filter(F.split(answer_normal(c), " "), lambda w: w != "")
    p, g = tokens(found), tokens(gold)
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    common = F.aggregate(F.transform(F.array_intersect(p, g), lambda w: F.least(times(p, w), times(g, w))), F.lit(0), lambda a, n: a + n)
    precision, recall = common / F.greatest(F.size(p), F.lit(1)), common / F.greatest(F.size(g), F.lit(1))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(common == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
