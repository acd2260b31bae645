"""How far the sources of a language differ in their terms, by sort-based streaming.

Rows of term, source and document are dealt out by language and term and sorted within a partition by language, term, source
and document; one scan over the runs gives each term's documents and occurrences. A second scan over the kept terms' runs
gives partial sums of each pair of sources that share a term. A task first joins the documents that it reads itself, as far
as they fit in HELD entries: such a block is what is sorted as a document, with the number of documents that have the term.
So a term has no more rows than blocks, however many documents hold it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_told, materialize, small_batches

#: Documents that a kept term needs in its language, ranks of part `term`, and the scale of probabilities.
LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Terms of all groups that a task holds before it passes them on, rows of a batch it passes on, and pairs worked on at once.
HELD, ROWS, PAIRS = 600_000, 10_000, 1 << 20
#: Parts of a group in which terms are ranked, one level after another.
PARTS = (64, 1)
#: A-Z become a-z; other letters and bytes of characters outside ASCII stay; all else parts terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Between a language and a term in the key that is sorted: no term holds it, so that the last one in a key ends the language.
BETWEEN = b"\0"

BLOCKS = "key string, source string, block int, docs long, n long"
KEPT = "lang string, term string, n long, sources array<string>, counts array<long>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of a UTF-8 text, A-Z in lower case, in order."""
    return text.translate(LETTERS).split()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS of the documents (lang, source, text) of a task."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = block = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in found.items():
            terms, prefix = list(counts), lang.encode() + BETWEEN
            for i in range(0, len(terms), ROWS):
                some = terms[i : i + ROWS]
                same = lambda x, kind: pa.array([x] * len(some), kind)
                columns = [pa.array([prefix + t for t in some], pa.binary()).cast(pa.string()), same(source, pa.string()), same(block, pa.int32()), pa.array([docs[t] for t in some], pa.int64()), pa.array([counts[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "source", "block", "docs", "n"])
        found.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
            if terms := terms_of(text):
                counts, docs = found.setdefault((lang, source), (Counter(), Counter()))
                held -= len(counts)
                counts.update(terms)
                docs.update(set(terms))
                held += len(counts)
                if held > HELD:
                    yield from flush()
                    held, block = 0, block + 1
    yield from flush()


def run_starts(*columns: pa.Array) -> np.ndarray:
    """The rows at which sorted columns begin a new run."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns])
    return np.flatnonzero(new)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` joined to ones of ROWS rows or a little more."""
    some: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            some.append(b)
        if sum(x.num_rows for x in some) >= ROWS:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some = []
    if some:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def by_term(batches: Iterator[pa.RecordBatch], collapse) -> Iterator[pa.RecordBatch]:
    """The rows of sorted ``batches`` (key: language and term; and others) in batches that hold all rows of each of their terms; ``collapse`` joins rows of a run, so that what waits for the next batch stays small."""
    waiting = None
    for b in gathered(batches):
        if waiting is not None:
            both = pa.Table.from_batches([waiting, b.select(waiting.schema.names).cast(waiting.schema)]).combine_chunks()
            b = both.to_batches()[0]
        b = collapse(b)
        last = int(run_starts(b.column("key"))[-1])
        if last:
            yield b.slice(0, last)
        waiting = b.slice(last)
    if waiting is not None:
        yield waiting


def _sources(b: pa.RecordBatch) -> pa.RecordBatch:
    """Sums of docs and n of each run of (key, source)."""
    first = run_starts(b.column("key"), b.column("source"))
    one = b.take(pa.array(first))
    sums = [pa.array(np.add.reduceat(b.column(c).to_numpy(), first)) for c in ("docs", "n")]
    return pa.RecordBatch.from_arrays([one.column("key"), one.column("source"), *sums], ["key", "source", "docs", "n"])


def _scan_terms(least_docs: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_term(batches, _sources):
            first = run_starts(b.column("key"))
            sizes = np.diff(np.append(first, b.num_rows))
            kept = np.add.reduceat(b.column("docs").to_numpy(), first) >= least_docs
            if not kept.any():
                continue
            total = np.add.reduceat(b.column("n").to_numpy(), first)[kept]
            rows = b.take(pa.array(np.flatnonzero(np.repeat(kept, sizes))))
            offsets = pa.array(np.append(0, np.cumsum(sizes[kept])).astype(np.int32))
            langs, terms = zip(*(k.rpartition(BETWEEN.decode())[::2] for k in b.column("key").take(pa.array(first[kept])).to_pylist()))
            lists = [pa.ListArray.from_arrays(offsets, rows.column(c)) for c in ("source", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(terms), pa.array(total), *lists], ["lang", "term", "n", "sources", "counts"])

    return scan


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _scan_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, item, value: for each two sources that share terms what the terms that both have add to the sum that counts every term as if one had it alone."""
    names: dict[tuple[str, str], int] = {}
    sums: dict[tuple[int, int], int] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        of, pairs = list(names), list(sums)
        for i in range(0, len(pairs), ROWS):
            some = pairs[i : i + ROWS]
            columns = [[of[a][0] for a, _ in some], [of[a][1] for a, _ in some], [of[b][1] for _, b in some], [sums[p] for p in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "item", "value"])
        sums.clear()

    for b in by_term(batches, lambda b: b):
        first = run_starts(b.column("key"))
        sizes = np.diff(np.append(first, b.num_rows))
        begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        code = np.array([names.setdefault(x, len(names)) for x in zip(b.column("lang").to_pylist(), b.column("source").to_pylist())])
        p, alone = b.column("p").to_numpy(), b.column("p0").to_numpy()
        ends = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            # as many rows as have up to PAIRS partners, but one at least
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            left = np.repeat(np.arange(at, to), size[at:to])
            right = np.arange(len(left)) - np.repeat(ends[at:to] - size[at:to] - (ends[at - 1] if at else 0), size[at:to]) + begin[left]
            left, right = left[left != right], right[left != right]
            if len(left):
                value = divergence(p[left], p[right]) - divergence(p[left], alone[right]) - divergence(alone[left], p[right]) + divergence(alone[left], alone[right])
                key = code[left] * len(names) + code[right]
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
                runs = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                for k, v in zip(key[runs].tolist(), np.add.reduceat(value, runs).tolist()):
                    pair = divmod(k, len(names))
                    sums[pair] = sums.get(pair, 0) + v
            at = to
        if len(sums) > HELD:
            yield from flush()
    yield from flush()


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)) in whole numbers; null without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + 1), whole(total + terms)))


def score(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, n (occurrences in the language), sources and counts (of the sources that have it) of the terms that at least ``least_docs`` of a language's documents hold, from ``docs`` (lang, source, text, without nulls)."""
    small_batches(docs.sparkSession)
    blocks = docs.select("lang", "source", "text").mapInArrow(_blocks, BLOCKS)
    ordered = blocks.repartition("key").sortWithinPartitions("key", "source", "block")
    return ordered.mapInArrow(_scan_terms(least_docs), KEPT)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (lang, source, text; nulls count as empty).

    Part `pair` rates each other source of the language by its divergence from the source, summed over all kept terms; part
    `term` the ``top`` kept terms that the source has more of than the language. Sources without terms, without kept terms
    and languages that keep no term have their pairs, with value 0 where no term is kept; a language with a single source
    has none. Texts are read whole, at any length; repeated rows count as often as they stand; ties are ranked by item. An
    empty table gives no rows; other columns are not looked at, whatever their names. All sums are of whole numbers.
    """
    spark = docs.sparkSession
    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = materialize(kept_terms(plain, least_docs), "terms")
    key = F.struct("lang", "source").alias("key")
    flat = kept.select("lang", "term", "n", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "n", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    sums = flat.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *map(zero, ("total", "terms", "lang_total"))).withColumn("p0", probability(F.lit(0), F.col("total"), F.col("terms")))
    groups = materialize(groups, "groups")
    told = groups.select(key, "total", "terms", "lang_total", "p0")
    rated = join_told(flat.select(key, "lang", "term", "source", "n", "count"), told, "key", F.xxhash64("term"))
    q = probability(F.col("n"), F.col("lang_total"), F.col("terms"))
    rated = materialize(rated.select("lang", "term", "source", "count", probability(F.col("count"), F.col("total"), F.col("terms")).alias("p"), "p0", q.alias("q")), "rated")

    ordered = rated.select(F.concat("lang", F.lit(BETWEEN.decode()), "term").alias("key"), "lang", "source", "p", "p0").repartition("key").sortWithinPartitions("key", "source")
    shared = ordered.mapInArrow(_scan_pairs, "lang string, source string, item string, value long")
    # terms that one of two sources has, as if the other had none: by the few different counts of a source
    each = materialize(rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"), F.first("p0").alias("p0")), "counts")
    other = join_sources(each, groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("r0")))
    none = score(F.col("p0"), F.col("r0"))
    first = other.select("lang", "source", "item", (F.col("times") * (score(F.col("p"), F.col("r0")) - none)).alias("value"))
    back = score(F.col("r0"), F.col("p0"))
    second = other.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * (score(F.col("r0"), F.col("p")) - back)).alias("value"))
    all_pairs = join_sources(groups.select("lang", "source", "terms", "p0"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("r0")))
    base = all_pairs.select("lang", "source", "item", F.coalesce(F.col("terms") * none, F.lit(0)).alias("value"))
    pairs = base.unionByName(first).unionByName(second).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = [F.col("value").desc(), F.col("item").asc()]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    terms = rated.where("p > q").select("lang", "source", F.col("term").alias("item"), score(F.col("p"), F.col("q")).alias("value"))
    for parts in PARTS:
        along = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(parts))).orderBy(*order)
        terms = terms.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= top)
    discard(kept)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").unionByName(part(terms, "term"))


#: Parts to which the sources of a language are dealt where they are joined with each other.
SPREAD = 16


def join_sources(rows: DataFrame, others: DataFrame) -> DataFrame:
    """``rows`` (lang, source, ...) with each other source of their language, from ``others`` (lang, item, ...): as many rows as the result has pairs, times the rows of a source. The rows of a language are dealt to SPREAD tasks."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64("source", "p0"), F.lit(SPREAD)).cast("int"))
    told = others.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(told, ["lang", "__part"]).where("source <> item").drop("__part")


def op11_divergence(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Both parts for every group of language and source."""
    return audit(docs)


#: DuckDB SQL for `op11_divergence`.
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
groups AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE} * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p, 1 + {SCALE} * (k.n + 1) // (l.total + l.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
