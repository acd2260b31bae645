"""Tokens, fingerprints, media, archives, shards, mixes and languages against plain Python and the public libraries."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import xxhash
from catalume.llm import bpe, langid, media, mixing, pii, quality, sharding, simhash, warc
from catalume.llm.graph import components
from catalume.llm.queries import VOCABULARY
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .conftest import FOLDER, in_order, table

sha = lambda b: hashlib.sha256(b).hexdigest()


def test_bpe(spark, docs, rows, odd, odd_rows, none):
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    for df, plain in ((docs, rows), (odd, odd_rows)):
        wanted = []
        for r in plain:
            ids = t.encode(r[1] or "", add_special_tokens=False).ids
            wanted.append((r[0], len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False).encode())))
        assert table(bpe.op3_bpe(spark, df, VOCABULARY)) == in_order(wanted)
    assert bpe.op3_bpe(spark, none, VOCABULARY).count() == 0


def test_fragments_keep_the_encoding():
    """Cuts between bytes that no token joins never change what a word becomes."""
    with open(VOCABULARY, "rb") as f:
        codec = bpe.Codec(bpe.vocabulary_tables(f.read()))
    for word in ("internationalisation", "日本語テキスト", "zqxjzqxj", "a" * 300, "\x00\x01\xff"):
        raw = word.encode()
        assert b"".join(codec.fragments(raw)) == raw
        assert [x for f in codec.fragments(raw) for x in codec.merge(f)] == codec.merge(raw)


def test_bpe_in_one_process(spark, docs, odd):
    """Encoding and decoding take one Python process a task, and give what the two operators give in turn, beside columns of their names."""
    for coded in (bpe.op3_bpe(spark, docs, VOCABULARY), corpus_pipeline.encode_tokens(spark, docs, FOLDER)):
        assert coded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    clash = odd.withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit(None).cast("long"))
    one = bpe.code_documents(clash, VOCABULARY)
    two = bpe.decode_documents(bpe.encode_documents(clash, VOCABULARY), VOCABULARY)
    assert one.columns == two.columns and table(one) == table(two)


def print_of(text):
    words = bytes(text or "", "utf-8").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i, c in enumerate(counts) if 2 * c > len(grams))


def linked(prints):
    """Root of each fingerprint, by comparing all pairs."""
    keys, root = sorted(set(prints)), {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    return {k: top(k) for k in keys}


def test_simhash(spark, docs, rows, odd, odd_rows, none):
    for df, plain in ((docs, rows), (odd, odd_rows)):
        prints = [print_of(r[1]) for r in plain]
        root = linked(prints)
        least = {}
        for r, p in zip(plain, prints):
            if r[0] is not None:
                least[root[p]] = min(r[0], least.get(root[p], r[0]))
        assert table(simhash.op6_simhash(spark, df)) == in_order((r[0], f"{p:016x}", least.get(root[p])) for r, p in zip(plain, prints))
        kept = simhash.drop_near_copies(df)
        assert kept.columns == df.columns and kept.count() == len(set(root.values()))
    assert simhash.op6_simhash(spark, none).count() == 0 and simhash.drop_near_copies(none).count() == 0


def test_near_links_lose_nothing(spark):
    """Fingerprints around a few centres: the links connect just what all pairs connect."""
    prints = set()
    for c in range(40):
        centre = xxhash.xxh64_intdigest(str(c), 1)
        prints |= {centre ^ (1 << (i * 7 + c) % 64) ^ (1 << (i * 11 + 3) % 64) for i in range(c % 9)} | {centre}
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fingerprint long")
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(nodes)).collect()}
    groups, wanted = defaultdict(set), defaultdict(set)
    for p, r in linked(list(prints)).items():
        wanted[r].add(simhash.signed(p))
    for p in prints:
        groups[roots.get(simhash.signed(p), simhash.signed(p))].add(simhash.signed(p))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_chain(spark):
    links = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r["node"], r["root"]) for r in components(links).collect()} == {(i, 1) for i in range(2, 201)}


def test_media(spark, docs, rows, odd, odd_rows, none):
    for df, plain in ((docs, rows), (odd, odd_rows)):
        wanted, feature = [], {}
        for r in plain:
            raw = (r[1] or "").encode()
            payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
            stored = media.to_wav(payload)
            wanted.append((r[0], len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(stored), sha(stored)))
        out = media.op8_media(spark, df)
        assert table(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256") == in_order(wanted)
        for digest, f in out.select("payload_sha256", "feature").collect():
            assert feature.setdefault(digest, f) == f
    assert media.op8_media(spark, none).count() == 0


def test_peaks_of_a_tone():
    """Blocks give what the whole gives; a tone's peaks stand at its frequency."""
    import numpy as np

    n = np.arange(media.HOP * (media.BLOCK + 50))
    middle = media.HOP * media.BLOCK + media.FRAME // 2
    tone = np.rint(128 + 100 * np.exp(-(((n - middle) / media.FRAME) ** 2)) * np.sin(2 * np.pi * n * 20 / media.FRAME)).astype(np.uint8)
    t, f = media.spectral_peaks(tone)
    assert 20 in f[t == media.BLOCK] and t.max() > media.BLOCK
    at, codes = media.fingerprint(tone.tobytes())
    assert len(at) == len(codes) > 0 and (np.diff(at) >= 0).all()


def test_warc_archives(spark, tmp_path):
    big = "".join(f"line {i} of a page\r\n" for i in range(20_000))
    same = "<p>again and again</p>" * 60
    pages = [(1, "http://a", None), (2, "http://b/WARC/1.1", ""), (3, None, same), (9, "http://c d", same), (4, "http://e", same), (5, "http://f", big), (6, "http://g", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3),
             (7, "http://h", "small"), (8, "http://i", "small"), (10, "http://j", "日本" * 40_000 + "\r\n\r\n"), (11, "http://k", big), (12, "http://l", "\r\n" * 40_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string")
    held = {}
    for i, _, h in pages:
        held[h or ""] = max(i, held.get(h or "", i))
    wanted = []
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and held[h or ""] != i
        wanted.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", held[h or ""] if revisit else None))
    assert table(warc.op9_warc(spark, df)) == in_order(wanted)
    warc.write_warc(df, f"file://{tmp_path}/w", chunk_bytes=1000)
    chunks = warc.read_chunks(spark, f"file://{tmp_path}/w")
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] == 1000
    assert table(warc.read_records(spark, f"file://{tmp_path}/w").drop("record_id"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == in_order(wanted)
    assert warc.op9_warc(spark, df.where("false")).count() == 0


def test_warc_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    wanted = con.sql(f"SELECT {', '.join(names)} FROM ({warc.OP9_SQL})").fetchall()
    assert table(warc.op9_warc(spark, spark.read.parquet(f"{FOLDER}/pages.parquet")), *names) == in_order(wanted)


def test_sharding(spark, docs, rows, odd, odd_rows, none):
    for df, plain in ((docs, rows), (odd, odd_rows)):
        out = sharding.op10_sharding(spark, df).collect()
        raw = [(r[1] or "").encode() for r in plain]
        assert in_order((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == in_order((r[0], len(b) + 1, zlib.crc32(b)) for r, b in zip(plain, raw))
        slots, sizes = defaultdict(list), Counter({i: 0 for i in range(16)})
        for r in out:
            slots[r["shard"]].append(r["slot"])
            sizes[r["shard"]] += r["size"]
        assert all(sorted(s) == [*range(len(s))] for s in slots.values()) and set(slots) <= set(range(16))
        mean, largest = sum(sizes.values()) / 16, max(map(len, raw)) + 1
        assert all(abs(s - mean) <= 0.05 * mean + largest for s in sizes.values())
    assert sharding.op10_sharding(spark, none).count() == 0


def test_sharding_one_hot_text(spark):
    """Copies of one text are split where the bytes demand it."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "hot text").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = [r["b"] for r in sharding.op10_sharding(spark, df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.05 * sum(sizes) / 16


def test_mixing(spark, docs, odd, odd_rows, none):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    out = mixing.op4_mixing(spark, docs)
    names = [c for c in out.columns if c != "target"]
    assert table(out, *names) == in_order(con.sql(f"SELECT {', '.join(names)} FROM ({mixing.OP4_SQL})").fetchall())
    assert table(out, *names) == table(mixing.op4_mixing(spark, docs), *names)
    for df in (docs, odd):
        got = mixing.op4_mixing(spark, df).collect()
        assert len(got) == df.count() and all(r["taken"] <= 2 * r["size"] for r in got)
        targets = mixing.source_targets(df.select("source", mixing.word_count(F.col("text")).alias("size")))
        plain = targets.collect()
        total = sum(r["source_size"] for r in plain)
        assert abs(sum(r["target"] for r in plain) - 1.5 * total) < 1e-6 * total and all(r["target"] <= 2 * r["source_size"] for r in plain)
        mixed = mixing.mix(df)
        assert mixed.columns == [*df.columns, "position"]
        assert mixed.agg(F.coalesce(F.sum(mixing.word_count(F.col("text"))), F.lit(0))).first()[0] == sum(r["taken"] for r in got)
    largest = max(r["size"] for r in mixing.op4_mixing(spark, docs).collect())
    for r in mixing.op4_mixing(spark, docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) <= largest
    assert mixing.op4_mixing(spark, none).count() == 0 and mixing.mix(none).count() == 0


def test_languages(spark, docs, rows, odd, odd_rows, none):
    out = {r["doc_id"]: r for r in langid.op7_langid(spark, docs).collect()}
    truth = {r[0]: r[2] for r in rows if r[2] is not None and r[1]}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in out)
    assert sum(out[i]["lang_pred"] == truth[i] for i in held) >= 0.9 * len(held)
    for i, r in out.items():
        assert 0 <= r["score"] <= 1
    got = langid.op7_langid(spark, odd).collect()
    assert len(got) == len(odd_rows) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == {"und"}
    assert langid.op7_langid(spark, none).count() == 0


def test_forward_backward():
    """Posteriors in blocks against sums over all label sequences."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    e, t, first = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    starts = np.array([1, 0, 0, 1, 0, 0, 0], bool)
    wanted = np.zeros((7, 3))
    for a, b in ((0, 3), (3, 7)):
        for path in itertools.product(range(3), repeat=b - a):
            s = first[path[0]] + sum(e[a + i, x] for i, x in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:]))
            for i, x in enumerate(path):
                wanted[a + i, x] += np.exp(s)
    wanted /= wanted.sum(axis=1, keepdims=True)
    assert np.allclose(langid.forward_backward(e, starts, t, first)[0], wanted)


def test_code_switched_words(spark):
    """Words of two invented languages in one line get labels of their own."""
    a, b = "brugan stelgar morgun falgor", "izelia nolia vermia talia"
    model = langid.fit([(a, "x"), (b, "y")] * 40)
    post = langid.Labeller(model).posteriors([f"{a} {b}".split()])
    assert [model["labels"][i] for i in post.argmax(axis=1)] == ["x"] * 4 + ["y"] * 4


CLASHES = ("__key", "__number", "__row", "__k1", "__size", "row", "key", "words", "lines", "label", "head", "number", "positions", "size", "spans", "base")


def test_clashing_columns_stay(spark, odd):
    """Columns with the names that operators use inside come out as they went in."""
    df = odd.withColumns({c: F.lit("mine") for c in CLASHES})
    model = langid.train(df)
    key = (F.xxhash64("text"), F.col("doc_id"))
    for out in (mixing.mix(df), simhash.drop_near_copies(df), pii.sanitise(df), quality.clean_lines(df), langid.label_documents(df, model), sharding.shard_rows(df, key, F.lit(1)), bpe.encode_documents(df, VOCABULARY), media.write_media(df)):
        assert {*df.columns} <= {*out.columns}
        assert out.where(" OR ".join(f"`{c}` <> 'mine' OR `{c}` IS NULL" for c in CLASHES)).count() == 0
