"""Vector retrieval and its evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries of a pack, and those that are sent to the rows at once. Components of a pack of rows. Queries that are multiplied with a pack of rows at once.
QUERIES, BLOCK, PACK, AT_ONCE = 4096, 32_768, 1 << 20, 128


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_k(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", unlike: str | None = None) -> DataFrame:
    """query, key, similarity, rank: the k rows most similar to each query (a stated, small set), of equals the smaller key; a query itself is left out, and with ``unlike`` so are rows that equal it in that column.

    Similarities are rounded to 6 places; they are null, and last, where a vector is missing, has no direction or another
    length than the other. Rows are dealt to packs, and queries are sent to all of them, BLOCK at a time: a task multiplies
    a pack of rows with a pack of queries, and the k best of each query go on, or fewer where packs before have better ones.
    """
    fields = lambda d: F.struct(F.col(key).alias("id"), F.col(vector).alias("v"), *([] if unlike is None else [F.col(unlike).alias("own")]))
    known = lambda d: d.where(F.col(key).isNotNull() if unlike is None else F.col(key).isNotNull() & F.col(unlike).isNotNull())
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("width")).first()
    n = max(1, math.ceil(told["n"] * max(told["width"] or 0, 1) / PACK))
    dealt = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    row_packs = known(rows).select(dealt.alias("pack"), fields(rows).alias("row")).repartition(2 * n, "pack").groupBy("pack").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    m = max(1, math.ceil(queries.count() / QUERIES))
    query_packs = known(queries).select(F.pmod(F.xxhash64(key), F.lit(m)).cast("int").alias("asked"), fields(queries).alias("row")).groupBy("asked").agg(F.collect_list("row").alias("queries"))
    step = max(1, BLOCK // QUERIES)
    blocks = [row_packs.crossJoin(F.broadcast(query_packs.where(F.col("asked").between(i, i + step - 1)))) for i in range(0, m, step)]
    kinds = T.StructType([T.StructField("query", queries.schema[key].dataType), T.StructField("key", rows.schema[key].dataType), T.StructField("similarity", T.DoubleType())])
    scored = reduce(DataFrame.unionByName, [b.mapInArrow(partial(_best_of_packs, k=k), kinds) for b in blocks])
    order = Window.partitionBy("query").orderBy(F.desc_nulls_last("similarity"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", F.col("key").alias(key), "similarity", "rank")


#: In place of similarities: where there is none, where it is no number, and where a row is not asked for. Columns that are looked through together.
MISSING, WILD, BARRED, TOGETHER = -3.0, 3.0, -4.0, 32


class _Pack:
    """Vectors of a pack, as given and as ones of length 1, by their number of components. With ``by_own`` those of one own value stand together; ``at`` tells which struct stands at a place."""

    def __init__(self, structs: pa.StructArray, by_own: bool):
        self.ids, vectors, *own = structs.flatten()
        n = len(self.ids)
        self.own = np.zeros(n, "int64")
        self.at = np.arange(n)
        if own and by_own:
            self.own_values = own[0].dictionary_encode()
            codes = self.own_values.indices.to_numpy(zero_copy_only=False)
            self.at = np.argsort(codes, kind="stable")
            self.own = codes[self.at]
        elif own:
            self.own_values = own[0]
        sizes = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
        starts = np.cumsum(sizes) - sizes
        values = vectors.flatten()
        flat = values.to_numpy(zero_copy_only=False).astype("float64")
        good = sizes > 0
        if values.null_count:
            good[np.repeat(np.arange(n), sizes)[values.is_null().to_numpy(zero_copy_only=False)]] = False
        sizes, starts, good = sizes[self.at], starts[self.at], good[self.at]
        self.norm, self.given, self.unit, self.places, self.inner = np.zeros(n), {}, {}, {}, np.zeros(n, "int64")
        for size in np.unique(sizes[good]):
            places = np.flatnonzero(good & (sizes == size))
            given = flat[starts[places][:, None] + np.arange(size)]
            with np.errstate(all="ignore"):
                norm = np.sqrt(np.cumsum(given * given, axis=1)[:, -1])
                unit = given / norm[:, None]
            self.norm[places], self.inner[places] = norm, np.arange(len(places))
            unit[~(np.isfinite(norm) & (norm > 0))] = 0
            self.given[size], self.unit[size], self.places[size] = given, unit, places
        self.sizes = sizes
        self.lost, self.wild = np.flatnonzero(self.norm == 0), np.flatnonzero(~np.isfinite(self.norm))


def _similarities(asked: _Pack, rows: _Pack, some: slice) -> np.ndarray:
    """Similarities of some queries with all rows, near to those of `_exact`, and BARRED up to a multiple of TOGETHER columns."""
    n, width = len(rows.at), -(-len(rows.at) // TOGETHER) * TOGETHER
    own = np.arange(len(asked.at))[some]
    out = np.empty((len(own), width))
    out[:, n:] = BARRED
    parts = []
    for size in asked.unit.keys() & rows.unit.keys():
        places = asked.places[size]
        a, z = np.searchsorted(places, own[0]), np.searchsorted(places, own[-1], "right")
        parts.append((places[a:z] - own[0], asked.unit[size][a:z], rows.places[size], rows.unit[size]))
    if len(parts) == 1 and len(parts[0][0]) == len(own) and len(parts[0][2]) == n:
        np.matmul(parts[0][1], parts[0][3].T, out=out[:, :n])
    else:
        out[:, :n] = MISSING
        for at, unit, places, others in parts:
            out[np.ix_(at, places)] = unit @ others.T
    for at, _, places, _ in parts if len(asked.wild) or len(rows.wild) else []:
        out[np.ix_(at[np.isin(at + own[0], asked.wild)], places)] = WILD
        out[np.ix_(at, places[np.isin(places, rows.wild)])] = WILD
    out[np.isin(own, asked.lost), :n] = MISSING
    out[:, rows.lost] = MISSING
    return out


def _exact(asked: _Pack, q: int, rows: _Pack, r: int) -> float:
    """The similarity as summed up from the first component to the last."""
    size = asked.sizes[q]
    dot = np.cumsum(asked.given[size][asked.inner[q]] * rows.given[size][rows.inner[r]])[-1]
    return dot / (asked.norm[q] * rows.norm[r])


def _millionths(x: np.ndarray) -> np.ndarray:
    return np.trunc(x * 1e6 + np.copysign(0.5, x))


def _best_of_packs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """query, key, similarity of what may be among the k best of each query, for pairs of a pack of rows, sorted by key, and a pack of queries."""
    seen, rows, least = None, None, {}
    for batch in batches:
        for i in range(batch.num_rows):
            pack, asked_of = batch.column("pack")[i].as_py(), batch.column("asked")[i].as_py()
            if pack != seen:
                seen, rows = pack, _Pack(batch.column("rows")[i].values, True)
            asked = _Pack(batch.column("queries")[i].values, False)
            if asked_of not in least:
                least[asked_of] = np.full(len(asked.at), BARRED)
            found = _best(asked, rows, k, least[asked_of])
            if len(found[0]):
                value = found[2] / 1e6
                value = np.where(value == WILD, np.nan, value)
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(found[0])), rows.ids.take(pa.array(rows.at[found[1]])), pa.array(value, mask=found[2] == MISSING * 1e6)], ["query", "key", "similarity"])


def _best(asked: _Pack, rows: _Pack, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows and their similarities in millionths: the k best rows of each query that are no worse than its ``least``, which rises with them."""
    same = pc.index_in(rows.ids.take(pa.array(rows.at)), value_set=asked.ids.unique())
    self_r = np.flatnonzero(same.is_valid().to_numpy(zero_copy_only=False))
    self_code = same.drop_null().to_numpy(zero_copy_only=False)
    asked_code = pc.index_in(asked.ids, value_set=asked.ids.unique()).to_numpy(zero_copy_only=False)
    order = np.argsort(asked_code, kind="stable")
    first, last = (np.searchsorted(asked_code[order], self_code, side) for side in ("left", "right"))
    self_r = np.repeat(self_r, last - first)
    self_q = order[np.concatenate([np.arange(a, z) for a, z in zip(first, last)])] if len(self_r) else self_r
    own_from = own_to = None
    if hasattr(asked, "own_values"):
        code = pc.index_in(asked.own_values, value_set=rows.own_values.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        own_from, own_to = np.searchsorted(rows.own, code, "left"), np.searchsorted(rows.own, code, "right")
    out = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
    for q in range(0, len(asked.at), AT_ONCE):
        some = slice(q, min(q + AT_ONCE, len(asked.at)))
        near = _similarities(asked, rows, some)
        here = (self_q >= q) & (self_q < some.stop)
        near[self_q[here] - q, self_r[here]] = BARRED
        if own_from is not None:
            for j in range(len(near)):
                near[j, own_from[q + j] : own_to[q + j]] = BARRED
        tops = near.reshape(len(near), -1, TOGETHER).max(axis=2)
        # the k-th of the best of some columns is no better than the k-th of all; what rounds to the same goes along
        bar = np.maximum(least[some], np.partition(tops, -k, axis=1)[:, -k] if tops.shape[1] >= k else BARRED)
        bar = np.where(bar > BARRED, bar - 1.1e-6, (MISSING + BARRED) / 2)
        gq, g = np.nonzero(tops >= bar[:, None])
        part = near.reshape(len(near), -1, TOGETHER)[gq, g]
        i, j = np.nonzero(part >= bar[gq][:, None])
        qs, rs, value = gq[i], g[i] * TOGETHER + j, part[i, j]
        score = _millionths(value)
        halfway = np.flatnonzero((np.abs(np.abs(value * 1e6) % 1 - 0.5) < 1e-5) & (np.abs(value) < 2))
        for h in halfway:
            score[h] = _millionths(np.float64(_exact(asked, qs[h] + q, rows, rs[h])))
        best = np.lexsort((rows.at[rs], -score, qs))
        qs, rs, score = qs[best], rs[best], score[best]
        starts = np.searchsorted(qs, np.arange(len(near)))
        kept = np.arange(len(qs)) - starts[qs] < k
        qs, rs, score = qs[kept], rs[kept], score[kept]
        full = np.flatnonzero(np.bincount(qs, minlength=len(near)) == k)
        last_of = np.searchsorted(qs, full, "right") - 1
        least[full + q] = np.maximum(least[full + q], score[last_of] / 1e6)
        out.append((qs + q, rs, score))
    return tuple(np.concatenate(x) for x in zip(*out))


def above(scores: DataFrame, score: str, least: float = 0.6) -> DataFrame:
    return scores.where(F.col(score) > least).orderBy(F.desc(score))


def best_answer(answers: DataFrame, key: str, least: float = 0.1) -> DataFrame:
    """key, answer, score: the best-scored answer of each key, if it reaches the threshold."""
    best = answers.groupBy(key).agg(F.max(F.struct("score", "answer")).alias("b")).select(key, "b.answer", "b.score")
    return best.where(F.col("score") > least)


def best_number(candidates: DataFrame, key: str) -> DataFrame:
    """key, value: the candidate with the smallest score, of equals the shortest span."""
    return candidates.groupBy(key).agg(F.min_by("value", F.struct("score", "length")).alias("value"))


def sorted_map(m: Column) -> Column:
    """A map's entries by falling value and then key."""
    return F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key")))), lambda s: F.struct(s["key"].alias("key"), (-s["n"]).alias("value")))


def average_precision(ranked: DataFrame, relevant: Column, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """cutoff, map_at_k over the queries of ``ranked`` (query, rank): precision at each relevant rank, averaged over at most as many as can be relevant."""
    hits = ranked.select("query", "rank", F.when(relevant, 1).otherwise(0).alias("hit"))
    hits = hits.withColumn("found", F.sum("hit").over(Window.partitionBy("query").orderBy("rank")))
    rows = hits.select("query", "rank", "hit", "found", F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")).where("rank <= cutoff")
    per = rows.groupBy("cutoff", "query").agg((F.sum(F.col("hit") * F.col("found") / F.col("rank")) / F.greatest(F.sum("hit"), F.lit(1))).alias("ap"))
    return per.groupBy("cutoff").agg(F.round(F.avg("ap"), 6).alias("map_at_k"))
