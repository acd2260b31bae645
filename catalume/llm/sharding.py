"""Shards of near equal bytes by histogram sort.

Rows are ordered by a key; shard boundaries are keys. Each round counts the exact bytes below a set of candidate
boundaries (probes) in every partition, adds the counts up, and narrows the interval in which each boundary lies, until
the bytes below it are within the tolerance of its target or no row is left between the interval's ends. Then the rows
are exchanged once, by range. Equal texts have neighbouring keys; a group of any size is cut where the bytes demand it,
since the key goes on with the id and a row number.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pack

#: A key is three signed 64-bit integers, compared one after another.
KEY = ("__k1", "__k2", "__k3")
END = 1 << 192
SHIFT = 1 << 63


def packed(*columns: np.ndarray) -> np.ndarray:
    """The keys as strings of 24 bytes in the keys' order."""
    out = np.empty((len(columns[0]), 3), ">u8")
    for i, c in enumerate(columns):
        out[:, i] = c.astype(np.int64).view(np.uint64) ^ np.uint64(SHIFT)
    return out.view("S24").ravel()


def boundaries(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(24, "big") for k in keys], "S24")


@dataclass
class Interval:
    """Where a boundary lies: from key ``lo``, below which are ``lo_bytes`` and ``lo_rows``, to ``hi``."""

    target: float
    lo: int
    lo_bytes: int
    lo_rows: int
    hi: int
    hi_bytes: int
    hi_rows: int

    def nearest(self) -> tuple[int, int, int]:
        """Key, bytes and rows below it of the end that is nearer to the target."""
        if self.target - self.lo_bytes <= self.hi_bytes - self.target:
            return self.lo, self.lo_bytes, self.lo_rows
        return self.hi, self.hi_bytes, self.hi_rows

    def met(self, tolerance: float) -> bool:
        return abs(self.nearest()[1] - self.target) <= tolerance or self.hi_rows - self.lo_rows <= 1 or self.hi - self.lo <= 1


def histogram(keyed: DataFrame, keys: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Bytes, rows, smallest and largest key of each bucket between the sorted ``keys``; bucket i has the keys from keys[i - 1] to below keys[i]."""
    probes = boundaries(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            key = packed(*(b.column(c).to_numpy(zero_copy_only=False) for c in KEY))
            order = np.argsort(key, kind="stable")
            key, size = key[order], b.column("__size").to_numpy(zero_copy_only=False)[order]
            bucket = np.searchsorted(probes, key, side="right")
            names, first, rows = np.unique(bucket, return_index=True, return_counts=True)
            sums = np.add.reduceat(size, first)
            for name, at, n, total in zip(names.tolist(), first.tolist(), rows.tolist(), sums.tolist()):
                lo, hi = (bytes(key[i]).ljust(24, b"\0") for i in (at, at + n - 1))
                if old := found.get(name):
                    found[name] = [old[0] + total, old[1] + n, min(old[2], lo), max(old[3], hi)]
                else:
                    found[name] = [total, n, lo, hi]
        if found:
            columns = zip(*([k, *v] for k, v in found.items()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "bytes", "rows", "lo", "hi"])

    counted = keyed.select(*KEY, "__size").mapInArrow(count, "bucket int, bytes long, rows long, lo binary, hi binary")
    total = counted.groupBy("bucket").agg(F.sum("bytes"), F.sum("rows"), F.min("lo"), F.max("hi"))
    return {r[0]: (r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in total.collect()}  # one row a bucket at most


def find_splitters(keyed: DataFrame, parts: int, tolerance: float = 0.01, probes: int = 8) -> tuple[list[int], list[int]]:
    """Keys that split the rows into ``parts`` ranges of near equal bytes, and the rows below each.

    ``keyed`` has the columns KEY and __size. ``tolerance`` is a share of a range's bytes; where single rows are larger
    than that, the nearest boundary between two rows is taken. ``probes`` candidates stand in each open interval.
    """
    all_rows = histogram(keyed, [0])
    total_bytes, total_rows = (sum(v[i] for v in all_rows.values()) for i in (0, 1))
    if not total_rows:
        return [0] * (parts - 1), [0] * (parts - 1)
    least, most = min(v[2] for v in all_rows.values()), max(v[3] for v in all_rows.values())
    goal = total_bytes / parts
    found = [Interval(goal * i, least, 0, 0, most + 1, total_bytes, total_rows) for i in range(1, parts)]
    while todo := [x for x in found if not x.met(tolerance * goal)]:
        waiting: dict[tuple[int, int], int] = {}
        for x in todo:
            waiting[x.lo, x.hi] = waiting.get((x.lo, x.hi), 0) + 1
        keys = {END - 1}
        for (lo, hi), n in waiting.items():
            keys |= {lo, hi, *(lo + (hi - lo) * i // (n * probes + 1) for i in range(1, n * probes + 1)), lo + 1}
        ordered = sorted(keys)
        buckets = histogram(keyed, ordered)
        rows_of = [buckets.get(i, (0, 0, None, None)) for i in range(len(ordered) + 1)]
        # below a boundary are the buckets up to it; a bucket's ends move inwards to the keys that are there
        byte_sums, row_sums = ([*accumulate(r[j] for r in rows_of)] for j in (0, 1))
        for x in todo:
            i = max(bisect_right(byte_sums, x.target) - 1, 0)
            j = min(bisect_left(byte_sums, x.target), len(ordered) - 1)
            if ordered[i] >= x.lo:
                x.lo, x.lo_bytes, x.lo_rows = ordered[i], byte_sums[i], row_sums[i]
            if ordered[j] <= x.hi:
                x.hi, x.hi_bytes, x.hi_rows = ordered[j], byte_sums[j], row_sums[j]
            inside = [r for r in rows_of[bisect_right(ordered, x.lo) : bisect_right(ordered, x.hi - 1) + 1] if r[1]]
            if inside:
                x.lo, x.hi = max(x.lo, min(r[2] for r in inside)), min(x.hi, max(r[3] for r in inside) + 1)
    near = [x.nearest() for x in found]
    return [n[0] for n in near], [n[2] for n in near]


def shard_rows(df: DataFrame, key: tuple[Column, Column], size: Column, shards: int = 16, ranges: int = 16, tolerance: float = 0.02) -> DataFrame:
    """``df`` (columns of the same names are replaced) with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 in each shard, without gaps, in the key's order).

    ``key`` gives two long columns, nulls first; ``size`` a row's bytes (at least 0). Each shard consists of ``ranges``
    ranges of near equal bytes, each of which is sorted by one task. Rows with equal keys are told apart by a row number.
    All columns of ``df`` are written once to the shared folder and exchanged once. An empty table gives no rows.
    """
    low = F.lit(-SHIFT + 1).cast("long")
    rows = pack(df, **dict(zip(KEY, (F.coalesce(key[0], low), F.coalesce(key[1], low), F.monotonically_increasing_id()))), __size=size.cast("long"))
    rows = materialize(rows, "shards")
    parts = shards * ranges
    keys, below = find_splitters(rows, parts, tolerance)
    splitters = boundaries(keys)

    def place(parts_of_keys: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts_of_keys:
            yield pd.Series(np.searchsorted(splitters, packed(*(c.to_numpy() for c in columns)), side="right").astype(np.int32))

    starts = [0, *below]
    offsets = F.array(*(F.lit(starts[i] - starts[i - i % ranges]).cast("long") for i in range(parts)))
    placed = rows.withColumn("__range", F.pandas_udf(place, "int")(*KEY))
    order = Window.partitionBy("__range").orderBy(*KEY)
    slot = F.element_at(offsets, F.col("__range") + 1) + F.row_number().over(order) - 1
    return placed.select(*(F.col(f"row.`{c}`") for c in df.columns if c not in ("shard", "slot")), F.floor(F.col("__range") / ranges).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every document's shard and slot under the law `bytes`; a null text has size 1 and the checksum of the empty text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("__text"))
    out = shard_rows(rows, (F.col("__text"), F.col("doc_id")), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
