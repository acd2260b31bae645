"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over the training time 0 to 1. Its integral is the source's cumulative token demand;
a document's place in its source's (shuffled) token stream, put through the inverse of that demand, is its training
position. Documents are then sorted by position. A source whose target exceeds its size is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, discard, materialize, pack

#: Weights and slopes that the sources have in turn, in order of their names: a slope of 0.5 lets a source's demand rise from 0.5 to 1.5 times its mean.
WEIGHTS = (3, 1, 2)
SLOPES = (0.5, 0.0, -0.5)
#: Share of all sizes that the mix takes, and how often a document may be taken.
SHARE, REPEATS = 1.5, 2
#: Hexadecimal digits that name a bucket of a source's documents: 4096 buckets a source, each summed up and ordered by one task.
DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACES.replace("[", "[^"))), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """source, source_size, target, __slope for each source of ``sized`` (source, size), null being one.

    Targets share ``share`` of all sizes by weight; none exceeds ``repeats`` times its source's size, and what is cut off
    goes to the others by weight. With the sources in order of (limit / weight), those up to the last one whose limit is
    below its share of what is left stop at their limits; the others share the rest. One row a source meets in one task.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (turn % len(values)).cast("int") + 1)
    per = per.select("*", of(weights).alias("__weight"), of(slopes).alias("__slope")).withColumn("__limit", repeats * F.col("source_size"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("__limit") / F.col("__weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        (F.sum("source_size").over(every) * share - F.coalesce(F.sum("__limit").over(before), F.lit(0))).alias("__left"),
        (F.sum("__weight").over(every) - F.coalesce(F.sum("__weight").over(before), F.lit(0))).alias("__weights"),
    ).withColumn("__level", F.col("__left") / F.col("__weights"))
    # the level rises until the first source that can have its whole share, and falls from there
    level = F.max(F.when(F.col("__level") * F.col("__weight") <= F.col("__limit"), F.col("__level"))).over(every)
    return per.select("source", "source_size", F.coalesce(F.least(level * F.col("__weight"), F.col("__limit").cast("double")), F.col("__limit").cast("double")).alias("target"), "__slope")


def training_time(share: Column, slope: Column) -> Column:
    """The time at which a source has had the ``share`` (0 to 1) of its demand: the inverse of t + slope * (t * t - t), the integral of 1 + slope * (2 * t - 1)."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope))


def curriculum(sized: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``sized`` (doc_id, source, size and others) with source_size, target, taken and positions.

    ``positions`` is the array of training positions, one for each time that the document is taken; ``taken`` is its size
    times their number. A source's documents are ordered by the MD5 of doc_id, then doc_id and size; rows that repeat all
    three are interchangeable. A document is taken in a pass if its middle word lies within the target. Prefix sums go
    over 4096 buckets a source first and then within each bucket, so that a source of any size spreads over many tasks.
    A document without words is taken in as many passes as its place says, with no words.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sized.withColumn("__md5", digest).withColumn("__bucket", F.substring("__md5", 1, DIGITS))
    buckets = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__size"))
    ahead = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(buckets.select("source", F.col("__size").alias("size")), share, repeats)
    starts = buckets.select("source", "__bucket", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__start"))
    starts = starts.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    starts = starts.select(F.col("source").alias("__source"), F.col("__bucket").alias("__in"), "__start", "source_size", "target", "__slope")
    within = Window.partitionBy("source", "__bucket").orderBy("__md5", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__in")))
    middle = lambda n: n * F.col("source_size") + F.col("__start") + F.col("__within") + F.col("size") / 2
    passes = F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda n: (middle(n) <= F.col("target")) & (F.col("target") > 0))
    positions = F.transform(passes, lambda n: training_time(middle(n) / F.col("target"), F.col("__slope")))
    return rows.withColumn("positions", positions).withColumn("taken", F.col("size") * F.size("positions")).select(*sized.columns, "source_size", "target", "taken", "positions")


def mix(docs: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The training sequence of ``docs`` (doc_id, text, source and others): its rows with ``position`` (which replaces a column of that name), one for each time that a document is taken, range-sorted by it.

    Rows that repeat doc_id, source and text are told apart by number, so that each has its own places.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    key = F.md5(F.concat_ws("\n", text("doc_id"), text("source"), text("text")))
    number = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(1)))
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("__key")), "sizes")
    placed = curriculum(sized, share, repeats).where(F.size("positions") > 0).select("__key", "positions")
    placed = materialize(placed.withColumn("__number", number), "positions")
    discard(sized)
    rows = pack(docs, __key=key).withColumn("__row", number)
    # the difference, and no equality, keeps the number out of the join's keys: both sides are already dealt by __key
    rows = rows.join(placed, "__key").where(F.col("__row") - F.col("__number") == 0)
    rows = rows.select(*(F.col(f"row.`{c}`") for c in docs.columns if c != "position"), F.explode("positions").alias("position"))
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op4_mixing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and the first training position of those taken (else null); the rows are sorted by it."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    placed = materialize(curriculum(sized), "curriculum")
    discard(sized)
    out = placed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("first_position"))
    return out.repartitionByRange(F.asc_nulls_last("first_position"), "doc_id").sortWithinPartitions(F.asc_nulls_last("first_position"), "doc_id")


#: DuckDB SQL for `op4_mixing`.
OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         [0.5, 0.0, -0.5][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS slope FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM named WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, slope,
         coalesce(least((max(level) FILTER (level * weight <= 2 * source_size) OVER ()) * weight, (2 * source_size)::DOUBLE), (2 * source_size)::DOUBLE) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, slope,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * ((middle <= target AND target > 0)::BIGINT + (middle + source_size <= target AND target > 0)::BIGINT))::BIGINT AS taken,
       CASE WHEN middle <= target AND target > 0 THEN round(
         CASE WHEN slope = 0 THEN middle / target ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * middle / target) - (1 - slope)) / (2 * slope) END, 9) END AS first_position
FROM placed
"""
