"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bits are split by structured masks: bit i has a non-zero code of r + 1 binary digits, and the mask of a
non-zero vector v keeps the bits whose code has an odd inner product with v. For any r bits there is a v that is
orthogonal to their codes, so two fingerprints that differ in at most r bits agree in all that some mask keeps: they
collide in that table. Fingerprints that meet another one in a table go on to the exact step. It never lists the pairs of
a bucket: each names itself and those that differ from it in one bit which its buckets leave free, and two fingerprints
are within two bits of each other just if they name a common one. Such a name has at most 65 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_spread, join_told, let, materialize, pack, small_batches
from .graph import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Near copies of the pipeline: words of a shingle, and the least Jaccard similarity in hundredths.
COPY_SHINGLE, COPY_SIMILARITY = 5, 80
#: Their candidates: tables, minima that a table joins (a pair of 0.8 meets in one of 16 tables with a chance of 1 - 2e-5), shingles minimised at once.
TABLES, MINIMA, MIN_BLOCK = 16, 3, 1 << 10
#: Texts of a bucket of which all pairs are compared at once; in a larger one each is compared with the bucket's leader first.
SMALL = 9


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, BLOCK at a time; all words together are a shingle if there are fewer; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined, n = memoryview(b" ".join(words)), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: n - 1]).tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], stops[i : i + BLOCK])], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles as a signed integer; 0 for a text without words."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text, shingle):
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([fingerprint(t) for t in s], dtype="int64")


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprints of its texts (lower-cased A-Z, words `[^\\x20\\x09-\\x0D]+`) as long integers; null counts as empty. A column named as ``out`` is replaced."""
    small_batches(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(_fingerprints, "long").asNondeterministic()(F.col(f"`{text}`")))


MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, TABLES * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def minhash_buckets(text: str | None) -> list[int]:
    """The bucket of each of TABLES tables of a text's five-word shingles; none for a text without words."""
    least = None
    for hashes in shingle_hashes(text, COPY_SHINGLE):
        for i in range(0, len(hashes), MIN_BLOCK):
            now = (hashes[i : i + MIN_BLOCK, None] * MULTIPLIERS).min(axis=0)
            least = now if least is None else np.minimum(least, now)
    if least is None:
        return []
    return [signed(xxhash.xxh64_intdigest(row.tobytes(), t)) for t, row in enumerate(least.astype("<u8").reshape(TABLES, MINIMA))]


def _buckets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([minhash_buckets(t) for t in s], dtype="object")


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles as signed integers."""
    return np.unique(np.concatenate([*shingle_hashes(text, COPY_SHINGLE), np.empty(0, "<u8")]).view("<i8"))


def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([shingle_set(t) for t in s], dtype="object")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 masks; for any ``radius`` bits one of them keeps none of these."""
    codes = (1 << (radius + 1)) - 1
    odd = lambda x: x.bit_count() & 1
    return [sum(1 << i for i in range(bits) if odd((i % codes + 1) & v)) for v in range(1, codes + 1)]


def near_links(nodes: DataFrame) -> DataFrame:
    """Links u, v between the distinct fingerprints of ``nodes`` (fingerprint) that connect all pairs within RADIUS bits, though not each pair directly."""
    masks = F.array(*(F.struct(F.lit(i).alias("table"), F.lit(signed(m)).cast("long").alias("mask")) for i, m in enumerate(covering_masks())))
    tables = nodes.select("fingerprint", F.explode(masks).alias("t")).select("fingerprint", "t.*", F.col("fingerprint").bitwiseAND(F.col("t.mask")).alias("bucket"))
    crowded = tables.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = tables.join(crowded, ["table", "bucket"]).groupBy("fingerprint").agg(F.bit_or(F.bitwise_not("mask")).alias("free"))
    flips = F.array(*(F.lit(signed(1 << b)).cast("long") for b in range(BITS)))
    names = F.concat(F.array("fingerprint"), F.transform(F.filter(flips, lambda b: F.col("free").bitwiseAND(b) != 0), lambda b: F.col("fingerprint").bitwiseXOR(b)))
    named = met.select("fingerprint", F.explode_outer(names).alias("name")).groupBy("name").agg(F.min("fingerprint").alias("v"), F.collect_list("fingerprint").alias("us")).where(F.size("us") > 1)
    return named.select("v", F.explode("us").alias("u")).where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)).select("u", "v").distinct()


def near_roots(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fingerprint, each once, and others) with root: the smallest fingerprint that is reachable over fingerprints at most RADIUS bits apart."""
    roots = components(near_links(nodes)).select(F.col("node").alias("fingerprint"), "root")
    return nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def near_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (long), component_id of each row of ``docs`` (doc_id and ``text``).

    component_id is the smallest doc_id that is reachable over fingerprints at most RADIUS bits apart. Texts without words
    have fingerprint 0 and link like any other. Rows with equal doc_ids and null doc_ids are fine; a group whose doc_ids
    are all null has a null component_id. Equal fingerprints are one node, however many copies it has.
    """
    printed = with_fingerprint(docs.select("doc_id", F.col(f"`{text}`").alias("__text")), "__text").drop("__text")
    # rows are numbered before they are written, so that those of one fingerprint can be told apart even if their doc_ids are null
    printed = materialize(printed.withColumn("__row", F.monotonically_increasing_id()), "fingerprints")
    rooted = near_roots(materialize(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fingerprint", "component_id")
    return join_spread(printed, named, "fingerprint", F.col("__row")).select("doc_id", "fingerprint", "component_id")


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs u, v of ``nodes`` (text_key, fingerprint) that op6's links join."""
    prints = materialize(nodes.groupBy("fingerprint").agg(F.min("text_key").alias("first")), "prints")
    same = join_spread(nodes, prints, "fingerprint", F.xxhash64("text_key")).select(F.col("text_key").alias("u"), F.col("first").alias("v"))
    firsts = lambda name: prints.select(F.col("fingerprint").alias(name), F.col("first").alias(f"first_{name}"))
    near = near_links(prints.select("fingerprint")).join(firsts("u"), "u").join(firsts("v"), "v").select(F.col("first_u").alias("u"), F.col("first_v").alias("v"))
    return same.unionByName(near)


def bucket_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs u, v of the texts that meet in a bucket of up to SMALL of ``rows`` (text_key, bucket), and stars of larger ones: text_key, bucket and the bucket's leader, each of its texts once.

    The leader is the text whose buckets are the fullest over all tables: in a group of texts that were made from one by
    small changes that is the one that lies in their midst.
    """
    # what is joined is written first: an aggregation beside a join keeps Spark from splitting a full bucket
    sizes = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    met = materialize(rows.join(sizes, "bucket"), "met")
    keys = met.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_list("text_key")).alias("keys"))
    every = F.flatten(F.transform("keys", lambda v, i: F.transform(F.slice("keys", i + 2, SMALL), lambda u: F.struct(u.alias("u"), v.alias("v")))))
    small = materialize(keys.select(F.explode(every).alias("p")).select("p.u", "p.v"), "small")
    large = met.where(F.col("n") > SMALL)
    fullest = F.max(F.struct("score", "text_key"))["text_key"].alias("leader")
    midst = materialize(large.join(large.groupBy("text_key").agg(F.sum("n").alias("score")), "text_key").groupBy("bucket").agg(fullest), "leaders")
    stars = materialize(join_told(large, midst, "bucket", F.xxhash64("text_key")).select("text_key", "bucket", "leader"), "stars")
    discard(sizes, met, midst)
    return small, stars


def apart_texts(stars: DataFrame, found: DataFrame) -> DataFrame:
    """text_key, root of all texts of those buckets of ``stars`` (text_key, bucket, leader) whose texts are not all in one group of ``found`` (node, root)."""
    root = lambda name: found.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    told = join_told(stars.join(root("text_key"), "text_key", "left"), root("leader"), "leader", F.xxhash64("text_key"), "left")
    own = F.coalesce("root_text_key", "text_key")
    rooted = materialize(told.select("text_key", "bucket", own.alias("root"), (own != F.coalesce("root_leader", "leader")).alias("apart")), "rooted")
    mixed = materialize(rooted.where("apart").select("bucket").distinct(), "mixed")
    out = materialize(join_told(rooted, mixed, "bucket", F.xxhash64("text_key")).select("text_key", "root").distinct(), "apart")
    discard(rooted, mixed)
    return out


def prefix_pairs(rows: DataFrame) -> DataFrame:
    """Pairs u, v that hold all pairs of different roots with a Jaccard similarity of COPY_SIMILARITY hundredths or more, of ``rows`` (text_key, root, set).

    An exact join by prefixes and positions. Shingles are put into one order: first those that stand in one root's texts
    only, which join nothing, then the others, the rarest first. The first shingle that two such sets share has so few
    before it that the rest can still hold as many as the pair must share: only rows of such places meet.
    """
    n, hundredths = F.size("set").cast("long"), COPY_SIMILARITY
    each = rows.select("text_key", "root", n.alias("n"), F.explode("set").alias("shingle"))
    spans = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    spans = materialize(spans.select("shingle", "times"), "shingles")
    held = join_told(each, spans, "shingle", F.xxhash64("text_key"))
    ordered = held.groupBy("text_key", "root", "n").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("xs"))
    place = ordered.select("text_key", "root", "n", (F.col("n") - F.size("xs")).alias("alone"), F.posexplode("xs").alias("i", "x"))
    # left: how many shingles the set holds from this one on
    place = place.select("text_key", "root", "n", F.col("x.shingle").alias("shingle"), (F.col("n") - F.col("alone") - F.col("i")).alias("left"))
    place = materialize(place.where(100 * F.col("left") >= hundredths * F.col("n")), "places")
    # the rows of a shingle's commonest root meet those of its other roots only
    counts = place.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("times"))
    most = counts.groupBy("shingle").agg(F.max(F.struct("times", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    most = materialize(most.select("shingle", "most"), "commonest")
    place = materialize(join_told(place, most, "shingle", F.xxhash64("text_key")), "places")
    side = lambda name, df: df.select("shingle", *(F.col(c).alias(f"{c}_{name}") for c in ("text_key", "root", "n", "left")))
    enough = (100 + hundredths) * F.least("left_u", "left_v") >= hundredths * (F.col("n_u") + F.col("n_v"))
    met = side("u", place.where("root <> most")).join(side("v", place), "shingle").where((F.col("root_u") != F.col("root_v")) & enough)
    return met.select(F.greatest("text_key_u", "text_key_v").alias("u"), F.least("text_key_u", "text_key_v").alias("v")).distinct()


def shingle_sets(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """text_key and shingle set of the texts of ``pairs``. ``nodes`` (text_key, name) names one row of each text among ``texts`` (text_key, name, text), so that copies stay where they are."""
    used = pairs.select(F.explode(F.array("u", "v")).alias("text_key")).distinct()
    once = texts.join(nodes.join(used, "text_key", "left_semi").select("text_key", "name"), ["text_key", "name"], "left_semi").dropDuplicates(["text_key"])
    return materialize(once.select("text_key", F.pandas_udf(_sets, "array<long>")("text").alias("set")), "sets")


def copy_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose ``sets`` (text_key, set) have a Jaccard similarity of COPY_SIMILARITY hundredths or more."""
    side = lambda name: sets.select(F.col("text_key").alias(name), F.col("set").alias(f"set_{name}"))
    both = F.size(F.array_intersect("set_u", "set_v"))
    alike = let(both, lambda n: 100 * n >= COPY_SIMILARITY * (F.size("set_u") + F.size("set_v") - n))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(alike).select("u", "v")


def copy_roots(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """text_key, root for the texts of ``nodes`` (text_key, name, fingerprint, buckets) that have a near copy; equal roots mean that links of COPY_SIMILARITY hundredths or more connect them.

    Candidates are the pairs that op6's links join and those that meet in a MinHash table. In buckets of more than SMALL
    texts each is first compared with the leader. Where a bucket's texts then stand in several groups, an exact join finds
    all pairs of its texts that link two groups. All pairs are checked on whole shingle sets.
    """
    rows = nodes.select("text_key", F.posexplode("buckets").alias("table", "bucket")).select("text_key", F.xxhash64("table", "bucket").alias("bucket"))
    small, stars = bucket_pairs(rows)
    pairs = small.unionByName(stars.select(F.col("text_key").alias("u"), F.col("leader").alias("v")))
    pairs = pairs.unionByName(print_pairs(nodes.select("text_key", "fingerprint")))
    pairs = materialize(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    sets = shingle_sets(pairs, nodes, texts)
    found = components(copy_links(pairs, sets))
    apart = apart_texts(stars, found)
    discard(small, pairs, stars)
    found = found.select(F.col("node").alias("text_key"), "root")
    if not apart.isEmpty():
        more = materialize(copy_links(prefix_pairs(apart.join(sets, "text_key")), sets), "more")
        root = lambda name: apart.select(F.col("text_key").alias(name), F.col("root").alias(f"root_{name}"))
        links = more.join(root("u"), "u").join(root("v"), "v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
        joined = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
        led = join_told(found, joined, "root", F.xxhash64("text_key"), "left").select("text_key", F.coalesce("top", "root").alias("root"))
        found = led.unionByName(joined.select(F.col("root").alias("text_key"), F.col("top").alias("root")))
        discard(more)
    discard(apart, sets)
    return found


def text_names(docs: DataFrame) -> tuple[Column, Column]:
    """A text's key, and a row's name among those with equal texts. The key is 120 bits of the text's MD5 as a whole number, so that different texts don't share one at any size and keys are still compared and aggregated as numbers."""
    digest = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    half = lambda at: F.conv(F.substr(digest, F.lit(at), F.lit(15)), 16, 10).cast("decimal(20,0)")
    key = half(1) * F.lit(16**15).cast("decimal(20,0)") + half(16)
    return key.cast("decimal(38,0)").alias("text_key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("name")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of ``docs`` (doc_id, text and others) that five-word Jaccard similarities of COPY_SIMILARITY hundredths or more connect: the row that drop_near_copies would choose.

    Null and empty texts and those without words are near copies of each other; shorter ones than a shingle have all their
    words for one. An empty table stays empty; other columns stay as they are, whatever their names.
    """
    key, name = text_names(docs)
    texts = docs.select(key, name, "text")
    rows = with_fingerprint(docs.select("doc_id", "text", key, name))
    printed = rows.withColumn("buckets", F.pandas_udf(_buckets, "array<long>").asNondeterministic()("text")).drop("text")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")).alias("head")
    printed = materialize(printed, "fingerprints")
    nodes = materialize(printed.groupBy("text_key").agg(F.first("fingerprint").alias("fingerprint"), F.first("buckets").alias("buckets"), least), "nodes")
    discard(printed)
    roots = copy_roots(nodes.select("text_key", "head.name", "fingerprint", "buckets"), texts)
    rooted = nodes.select("text_key", "head.*").join(roots, "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    return one_row_each(docs, least_rows(rooted))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies of ``docs`` (doc_id, text and others), as op6 groups them: that with the smallest doc_id (a null one is the largest), of equal doc_ids one.

    Rows are told apart by doc_id and text, so that null doc_ids and one that stands by several texts are fine.
    """
    key, name = text_names(docs)
    printed = materialize(with_fingerprint(docs.select("doc_id", "text", key, name)).drop("text"), "fingerprints")
    roots = near_roots(materialize(printed.select("fingerprint").distinct(), "nodes"))
    rooted = join_spread(printed.withColumn("none", F.col("doc_id").isNull()), roots, "fingerprint", F.xxhash64("text_key", "name"))
    return one_row_each(docs, least_rows(rooted))


def least_rows(rooted: DataFrame) -> DataFrame:
    """text_key, name of the row with the smallest doc_id of each root of ``rooted`` (none, doc_id, name, text_key, root)."""
    return rooted.groupBy("root").agg(F.min(F.struct("none", "doc_id", "text_key", "name")).alias("head")).select("head.text_key", "head.name")


def one_row_each(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``heads`` (text_key, name)."""
    key, name = text_names(docs)
    rows = pack(docs, text_key=key, name=name).join(heads, ["text_key", "name"], "left_semi")
    number = F.row_number().over(Window.partitionBy("text_key", "name").orderBy(F.lit(0)))
    return rows.withColumn("number", number).where("number = 1").select("row.*")


def op6_simhash(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    out = near_groups(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
