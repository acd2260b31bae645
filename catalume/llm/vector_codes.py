"""Vectors as short codes: each part of a vector is replaced by the number of its codebook's nearest entry.

Nearest entries are found by partial-distance search: the dimensions of a part are taken in descending variance of its
codebook, and a mask drops the entries whose distance so far strictly exceeds the smallest complete distance that is known.
Codebooks start from the vectors with the smallest ids and are moved to the means of their parts; only sums and counts of
each entry leave a task. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_told, materialize

#: Parts of a vector, entries of a codebook, rounds of moving them, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components must stay below this, so that squared distances of some 10,000 dimensions fit 64 bits.
LIMIT = 1 << 24
#: Entries that are tried before the best distance is brought up to date.
TRIED = 16
#: Rows of a batch.
ROWS = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest of ``book``'s entries to each row of ``x``, the lowest of equally near ones, and its squared distance."""
    n, spread = len(x), len(book) * (book * book).sum(axis=0) - book.sum(axis=0) ** 2
    order = np.argsort(-spread, kind="stable")
    x, book = x[:, order], book[:, order]
    ahead = np.zeros((n, len(book)), np.int64) if not len(order) else (x[:, :1] - book[None, :, 0]) ** 2
    # the entry that is nearest in the first dimension gives the first complete distance
    at = ahead.argmin(axis=1)
    best = ((x - book[at]) ** 2).sum(axis=1)
    for low in range(0, len(book), TRIED):
        partial = ahead[:, low : low + TRIED]
        row, entry = np.nonzero(partial <= best[:, None])
        so_far, entry = partial[row, entry], entry + low
        for j in range(1, len(order)):
            so_far = so_far + (x[row, j] - book[entry, j]) ** 2
            stays = so_far <= best[row]
            row, entry, so_far = row[stays], entry[stays], so_far[stays]
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            key = np.minimum.reduceat(so_far * len(book) + entry, first)
            row, (distance, number) = row[first], np.divmod(key, len(book))
            better = (distance < best[row]) | (number < at[row])
            at[row[better]], best[row[better]] = number[better], distance[better]
    return at, best


def parts_of(b: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The parts of a batch's vectors (column 0), one position after another."""
    values = b.column(0).flatten().to_numpy().astype(np.int64).reshape(b.num_rows, size)
    yield from np.split(values, PARTS, axis=1)


def moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """``books`` (parts x entries x dimensions) after one round: each entry is the floor of the mean of the parts that are nearest to it; unused ones stay."""
    size = PARTS * books.shape[2]
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # ENTRIES vectors

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        total, count = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
        for b in batches:
            for part, x in enumerate(parts_of(b, size)):
                at, _ = nearest(x, now[part])
                np.add.at(total[part], at, x)
                count[part] += np.bincount(at, minlength=now.shape[1])
        part, entry = np.nonzero(count)
        place = np.tile(np.arange(now.shape[2]), len(part))
        part, entry = (np.repeat(v, now.shape[2]) for v in (part, entry))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (part, entry, place, total[part, entry, place], count[part, entry])], ["part", "entry", "place", "total", "n"])

    sums = vectors.select("vector").mapInArrow(summed, "part long, entry long, place long, total long, n long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # ENTRIES vectors at most
        out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def scaled(vector: Column) -> Column:
    """The components times SCALE, rounded down; null for a null vector and one with a component that is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall(whole, lambda x: F.abs(x) < LIMIT)
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(good, F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a vector's component times {SCALE} is {LIMIT} or more"))))


def fit(vectors: DataFrame, size: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts x entries x dimensions) of ``vectors`` (id, vector): they start as the vectors with the ``entries`` smallest ids (of equal ids the smaller vectors, null ids last)."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), PARTS, size // PARTS).transpose(1, 0, 2)
    for _ in range(rounds):
        books = moved(vectors, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (two hexadecimal digits a part) and error (squared distances) of ``vectors`` (id, label, vector)."""
    size = PARTS * books.shape[2]
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [nearest(x, shared.value[part]) for part, x in enumerate(parts_of(b, size))]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("vector", "id", "label").mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(df: DataFrame, name: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """id, label, code and error of each good vector of ``df``, and the codebooks.

    Null vectors and those with a null or non-finite component are dropped, and so are those of another length than most
    vectors have (of equally frequent lengths the longer). That length must be a multiple of PARTS. With fewer than ENTRIES
    vectors there are as many entries. Rows that repeat are coded alike, null ids and labels are fine; a table without a
    good vector gives no rows and no codebooks. Other columns are not looked at, whatever their names.
    """
    rows = df.select(F.col(f"`{name}`").alias("id"), F.col(f"`{label}`").alias("label"), scaled(F.col(f"`{vector}`")).alias("vector")).where("vector IS NOT NULL")
    rows = materialize(rows, "vectors")
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    if size["size"] % PARTS:
        raise ValueError(f"vectors of {size['size']} components have no {PARTS} equal parts")
    rows = rows.where(F.size("vector") == size["size"])
    books = fit(rows, size["size"])
    out = materialize(encode(rows, books), "codes")
    discard(rows)
    return out, books


def op12_vectors(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """Code, errors and the codebooks' digest of every good vector."""
    coded, books = compress(embeddings)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    coded = coded.select("id", "code", "error", key)
    sums = materialize(coded.groupBy("key").agg(F.sum("error").alias("label_error")), "labels")
    out = join_told(coded, sums, "key", F.xxhash64("id", "code"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books) if books is not None else "").alias("codebooks_sha256"))


def _oracle() -> str:
    step = lambda i: f"""
a{i} AS (SELECT vec_id, part, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance FROM
         (SELECT x.vec_id, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM x JOIN b{i} b USING (part)) GROUP BY ALL),"""  # noqa: E731
    move = lambda i: f"""
s{i} AS (SELECT part, entry, place, floor(sum(v[place]) / count(*))::BIGINT AS c FROM (SELECT a.part, a.entry, x.v, unnest(range(1, len(x.v) + 1)) AS place FROM a{i} a JOIN x USING (vec_id, part)) GROUP BY ALL),
m{i} AS (SELECT part, entry, list(c ORDER BY place) AS v FROM s{i} GROUP BY ALL),
b{i + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (part, entry)),"""  # noqa: E731
    return rf"""
WITH good AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT vec_id, p AS part, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM good, range({PARTS}) AS t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM good QUALIFY entry < {ENTRIES}),
b0 AS (SELECT part, entry, v FROM x JOIN first USING (vec_id)),{"".join(step(i) + move(i) for i in range(ROUNDS))}{step(ROUNDS)}
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM b{ROUNDS}),
o AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o JOIN good USING (vec_id), digest
"""


#: DuckDB SQL for `op12_vectors`, for vectors with different ids.
OP12_SQL = _oracle()
