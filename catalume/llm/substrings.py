"""Passages that stand more than once, by seed and extend.

Of the GRAM-word grams of each window of WINDOW words the one with the smallest hash is its seed (the leftmost of equal
ones), so that equal windows have equal seeds at equal places. The seeds of all documents are joined; those that stand once
go. What is left is extended both ways as far as the seed's windows reach: seeds with the same surroundings repeat there in
all their windows. Only where surroundings differ, at the ends of a repeat, windows are compared one by one, once for
each different surrounding, however often it stands. No pairs of documents are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SENT_ROWS, discard, join_told, materialize, pack, small_batches, space_words

#: Words of a window and of a seed.
WINDOW, GRAM = 35, 10
#: Windows whose seeds are sought at once.
BLOCK = 1 << 14

ANCHORS = "array<struct<seed:bigint,lo:int,hi:int,c1:bigint,c2:bigint>>"


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text, unchanged, joined by one space."""

    def __init__(self, text: bytes):
        words = text.split()
        self.n, self.joined = len(words), b" ".join(words)
        self.view, self.stops = memoryview(self.joined), np.cumsum(np.fromiter(map(len, words), np.int64, self.n) + 1) - 1
        self.starts = np.append(0, self.stops[:-1] + 1) if self.n else self.stops

    def slices(self, first: np.ndarray, size: np.ndarray | int) -> Iterator[memoryview]:
        """The ``size`` words from each of ``first``."""
        view = self.view
        return (view[a:b] for a, b in zip(self.starts[first].tolist(), self.stops[first + size - 1].tolist()))


def seeds(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seeds' hashes, and the first and last of the windows that each is the seed of (windows by their first word)."""
    last, digest = words.n - WINDOW, xxhash.xxh64_intdigest
    found = []
    for low in range(0, last + 1, BLOCK):
        high = min(low + BLOCK, last + 1)
        grams = np.arange(low, high + WINDOW - GRAM)
        hashes = np.fromiter((digest(x) for x in words.slices(grams, GRAM)), np.uint64, len(grams))
        at = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW - GRAM + 1).argmin(axis=1) + np.arange(high - low)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        found.append((hashes[at[first]].view(np.int64), at[first] + low, first + low, np.append(first[1:], high - low) + low - 1))
    if not found:
        return (np.empty(0, np.int64),) * 3
    hashes, at, first, final = (np.concatenate(x) for x in zip(*found))
    # a seed whose windows go on in the next block
    new = np.append(True, at[1:] != at[:-1])
    return hashes[new], first[new], final[np.append(new[1:], True)]


def halves(digests: Iterator[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">i8").reshape(n, 2)
    return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key (of the text), n_words, words_sha256 and anchors of each of the documents (doc_id, text)."""
    for b in batches:
        keys, counts, shas, sizes, parts = [], [], [], [], []
        for text in b.column(1).cast(pa.binary()).to_pylist():
            words = Words(text)
            hashes, lo, hi = seeds(words)
            around = halves((xxhash.xxh3_128_digest(x) for x in words.slices(lo, hi - lo + WINDOW)), len(lo))
            keys.append(hashlib.md5(text).digest())
            counts.append(words.n)
            shas.append(hashlib.sha256(words.joined).hexdigest())
            sizes.append(len(lo))
            parts.append((hashes, lo.astype(np.int32), hi.astype(np.int32), *around))
        columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
        anchors = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.StructArray.from_arrays(columns, ["seed", "lo", "hi", "c1", "c2"]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), anchors], ["doc_id", "key", "n_words", "words_sha256", "anchors"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h1, h2, key, at, weight of each window of ``ranges`` (lo, hi, weight) of the texts (key, text, ranges)."""
    for b in batches:
        for key, text, ranges in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
            words = Words(text)
            at = np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges])
            weight = np.repeat([r["weight"] for r in ranges], [r["hi"] - r["lo"] + 1 for r in ranges])
            for i in range(0, len(at), BLOCK):
                some = at[i : i + BLOCK]
                h1, h2 = halves((xxhash.xxh3_128_digest(x) for x in words.slices(some, WINDOW)), len(some))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([key] * len(some), pa.binary()), pa.array(some.astype(np.int32)), pa.array(weight[i : i + BLOCK].astype(np.int64))], ["h1", "h2", "key", "at", "weight"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the words outside all ``ranges`` of windows (lo, hi) of the texts (key, text, ranges), joined by one space."""
    for b in batches:
        out = []
        for text, ranges in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, [r["lo"] for r in ranges], 1)
            np.add.at(edge, [r["hi"] + WINDOW for r in ranges], -1)
            out.append(b" ".join(w for w, covered in zip(words, np.cumsum(edge).tolist()) if not covered))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()).cast(pa.string())], ["key", "kept"])


def text_key(text: Column) -> Column:
    """A text's key where texts are read again: 128 bits."""
    return F.unhex(F.md5(text))


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, text, ranges for each key of ``wanted`` (key, ranges; written): texts that nobody wants are left out before the shuffle if the keys are few enough to be sent."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(text_key(F.col("text")).alias("key"), "text")
    if wanted.count() <= SENT_ROWS:
        texts = texts.join(F.broadcast(wanted.select("key")), "key", "left_semi")
    return texts.dropDuplicates(["key"]).join(wanted, "key").select("key", "text", "ranges")


def read_anchors(docs: DataFrame) -> DataFrame:
    """row, doc_id, key, n_words, words_sha256 (of the words joined by one space) and anchors of each of ``docs`` (doc_id, text), written."""
    small_batches(docs.sparkSession)
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(plain.dtypes)["doc_id"]
    read = plain.mapInArrow(_read, f"doc_id {kind}, key binary, n_words long, words_sha256 string, anchors {ANCHORS}")
    return materialize(read.withColumn("row", F.monotonically_increasing_id()), "anchors")


def repeated_windows(docs: DataFrame, read: DataFrame) -> DataFrame:
    """key, ranges (lo, hi: the first words of windows that also start elsewhere), written, of each text with such; ``read`` is `read_anchors` of ``docs``.

    Equal texts are one text of weight 2, whatever their number.
    """
    copies = materialize(read.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1").select("key", "first"), "copies")
    side = F.broadcast(copies) if copies.count() <= SENT_ROWS else copies
    once = read.join(side, "key", "left").where("first IS NULL OR row = first").select("key", F.when(F.col("first").isNull(), 1).otherwise(2).alias("weight"), F.explode("anchors").alias("a"))
    once = once.select("key", "weight", "a.*")
    again = materialize(once.groupBy("seed").agg(F.sum("weight").alias("n")).where("n > 1").select("seed"), "seeds")
    met = materialize(once.join(again, "seed"), "met")
    least = F.min(F.struct("key", "lo", "hi")).alias("x")
    around = materialize(met.groupBy("seed", "c1", "c2").agg(F.sum("weight").alias("n"), least).select("seed", "c1", "c2", "n", "x.*"), "around")
    settled = met.join(materialize(around.where("n > 1").select("seed", "c1", "c2"), "settled"), ["seed", "c1", "c2"]).select("key", "lo", "hi")
    # surroundings that stand once are held against all of their seed, window by window
    ends = materialize(around.where("n = 1").select("seed").distinct(), "ends")
    sought = around.join(ends, "seed").select("key", F.struct("lo", "hi", F.least("n", F.lit(2)).alias("weight")).alias("x"))
    sought = materialize(sought.groupBy("key").agg(F.collect_list("x").alias("ranges")), "sought")
    windows = materialize(with_texts(docs, sought).mapInArrow(_windows, "h1 long, h2 long, key binary, at int, weight long"), "windows")
    twice = materialize(windows.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).where("n > 1").select("h1", "h2"), "twice")
    single = windows.where("weight = 1").join(twice, ["h1", "h2"]).select("key", F.col("at").alias("lo"), F.col("at").alias("hi"))
    ranges = settled.unionByName(single).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    out = materialize(ranges, "ranges")
    discard(copies, again, met, around, ends, sought, windows, twice)
    return out


def covered(ranges: Column) -> Column:
    """The number of words in the windows of sorted ``ranges`` (lo, hi)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    more = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["hi"] + WINDOW - F.greatest(a["end"], r["lo"]))).alias("n"), F.greatest(a["end"], r["hi"] + WINDOW).alias("end"))
    return F.aggregate(ranges, zero, more, lambda a: a["n"])


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`read_anchors` of ``docs`` (doc_id, text) without the anchors, and of the texts that lose words: key, n_removed, kept (the words that stay, joined by one space), written.

    A word goes if a window of WINDOW words that covers it also starts anywhere else, in the same text or another; windows
    are judged on the input. Null, empty and short texts have no window and lose nothing; a text with a copy loses all its
    words if it has a window; texts that overlap themselves lose what repeats. Texts of any length are read whole; null and
    repeated doc_ids are fine; an empty table gives no rows; other columns are not looked at, whatever their names.
    """
    read = read_anchors(docs)
    ranges = repeated_windows(docs, read)
    narrow = read.select("doc_id", "key", "n_words", "words_sha256")
    long = narrow.where(F.col("n_words") >= WINDOW).groupBy("key").agg(F.first("n_words").alias("n_words"))
    lost = ranges.join(long, "key").select("key", "ranges", "n_words", covered(F.col("ranges")).alias("n_removed"))
    lost = materialize(lost, "lost")
    # texts that lose all words aren't read again
    part = materialize(lost.where("n_removed < n_words").select("key", "ranges"), "part")
    kept = with_texts(docs, part).mapInArrow(_kept, "key binary, kept string")
    whole = lost.where("n_removed = n_words").select("key", F.lit("").alias("kept"))
    told = materialize(lost.select("key", "n_removed").join(kept.unionByName(whole), "key"), "kept")
    discard(ranges, lost, part)
    return narrow, told


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with the words that stay, joined by one space, for text; n_chars, if there, follows. A null text stays null; all other columns stay."""
    _, told = repeats(docs.select("doc_id", "text"))
    key = text_key(F.coalesce("text", F.lit("")))
    rows = pack(docs, key=key).join(told.select("key", "kept"), "key", "left")
    clean = F.when(F.col("row.text").isNotNull(), F.coalesce("kept", F.array_join(space_words(F.col("row.text")), " ")))
    rows = rows.select("row", clean.alias("__clean"))
    made = {"text": F.col("__clean"), "n_chars": F.coalesce(F.length("__clean").cast("long"), F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("__clean")}
    return rows.select(*(made[c].alias(c) if c in made else F.col(f"row.`{c}`") for c in docs.columns))


def op13_substrings(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Words, removed words and the digest of what stays, of every document."""
    read, told = repeats(docs.select("doc_id", "text"))
    told = materialize(told.select("key", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "digests")
    out = join_told(read, told, "key", F.xxhash64("doc_id"), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"))


#: DuckDB SQL for `op13_substrings`.
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS words FROM documents),
w AS (SELECT r, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM again, range({WINDOW}) AS t(k)),
each AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM each ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(d.words)::BIGINT AS n_words, (len(d.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256 FROM d LEFT JOIN kept k USING (r)
"""
