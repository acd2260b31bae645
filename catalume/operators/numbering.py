"""Row numbers in the order of a column, without a task that holds all rows of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order, each numbered by itself, and sampled rows a range that set their bounds.
RANGES, SAMPLED = 64, 20


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row (but maps, which Spark doesn't hash)."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind))


def bounds(df: DataFrame, order: str, ranges: int = RANGES) -> list:
    """``ranges`` - 1 values that cut a column into about equal rows, from those rows with the smallest hashes (a bounded sample, equal in each run). A value of many rows stands as often as it fills ranges."""
    rows = df.where(F.col(order).isNotNull()).select(order, row_hash(df).alias("__hash"))
    values = sorted(r[0] for r in rows.orderBy("__hash", order).limit(ranges * SAMPLED).collect())
    return [values[len(values) * i // ranges] for i in range(1, ranges)] if values else []


def with_places(df: DataFrame, order: str, group: tuple[str, ...] = (), name: str = "place", ranges: int = RANGES) -> DataFrame:
    """``df`` with each row's place (from 0) in the order of a column, of its group if there is one; null values come first.

    Rows are counted by group and range; sums of the counts say where each range starts, and each range is numbered by
    itself. Bounds come from a sample, places are exact. Rows with equal values are numbered in any order, and those of a
    value that fills several ranges are dealt to these by a hash of the row.
    """
    cuts = F.array(*map(F.lit, bounds(df, order, ranges)))
    below, upto = F.size(F.filter(cuts, lambda b: b < F.col(order))), F.size(F.filter(cuts, lambda b: b <= F.col(order)))
    dealt = below + F.pmod(row_hash(df), F.greatest(upto - below + 1, F.lit(1))).cast("int")
    rows = df.withColumn("__range", F.when(F.col(order).isNull(), 0).otherwise(F.coalesce(dealt, F.lit(0))) if ranges > 1 else F.lit(0))
    counts = rows.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(g).alias(f"__{i}") for i, g in enumerate(group)), F.col("__range").alias("__in"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{i}")) for i, g in enumerate(group)], F.col("__range") == F.col("__in"))
    number = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(order)) - 1
    numbered = rows.withColumn("__number", number).join(starts, same)
    return numbered.select(*df.columns, (F.col("__start") + F.col("__number")).alias(name))
