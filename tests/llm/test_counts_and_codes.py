"""Source divergence, vector codes and repeated passages against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from catalume.llm import divergence, substrings, vector_codes
from pyspark.sql import functions as F

from .conftest import DOCS, PROSE, in_order, table

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def audited(rows, least=3, top=200):
    """The contract's rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms_of = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    out = []
    for lang in {r[1] for r in rows}:
        own = [(terms_of(t), s) for t, la, s in rows if la == lang]
        df = Counter(x for terms, _ in own for x in set(terms))
        kept = [t for t in df if df[t] >= least]
        counts = defaultdict(Counter)
        for terms, s in own:
            counts[s].update(t for t in terms if df[t] >= least)
        whole = Counter()
        for c in counts.values():
            whole.update(c)
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept))
        for s in counts:
            pairs = [(sum((p(counts[s], t) - p(counts[o], t)) ** 2 // p(counts[o], t) for t in kept), o) for o in counts if o != s]
            over = [((p(counts[s], t) - p(whole, t)) ** 2 // p(whole, t), t) for t in kept if counts[s][t] and p(counts[s], t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", over)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def test_divergence(spark, odd, odd_rows, docs, rows, none):
    assert table(divergence.op11_divergence(spark, odd)) == audited([r[1:4] for r in odd_rows])
    assert table(divergence.op11_divergence(spark, docs)) == audited([r[1:4] for r in rows])
    assert divergence.op11_divergence(spark, none).count() == 0


def test_divergence_of_many_sources(spark, monkeypatch):
    """Ties, sources without terms, a language that keeps nothing; shared groups by the join without broadcast, and small blocks of pairs and terms."""
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(["Aa", "b", "ça", "d", "日本", "e" * 50], k=rng.randrange(9))), rng.choice(["x", "y", None]), f"s{rng.randrange(12)}") for _ in range(400)]
    rows += [("alone", "z", "one"), ("", "z", "two"), ("1 2 3", "x", "numbers")]
    monkeypatch.setattr(divergence, "PAIRS", 5)
    monkeypatch.setattr(divergence, "HELD", 7)
    monkeypatch.setattr("catalume.llm.common.SENT_ROWS", 0)
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, term int")
    assert table(divergence.audit(df, 3, 4)) == audited(rows, top=4)


def coded(rows):
    """The contract's rows of (vec_id, vector, label)."""
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    step = len(good[0][1]) // 16
    cut = lambda v, p: v[p * step : (p + 1) * step]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[cut(v, p) for _, v, _ in first] for p in range(16)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), j) for j, e in enumerate(books[p])) for p in range(16)] for _, v, _ in good]

    for _ in range(2):
        found = assign()
        for p in range(16):
            for j in range(len(books[p])):
                if own := [cut(v, p) for (_, v, _), at in zip(good, found) if at[p][1] == j]:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(good, errors):
        by_label[label] += e
    digest = sha(",".join(str(c) for b in books for e in b for c in e))
    return [(i, "".join(f"{j:02x}" for _, j in f), e, by_label[label], digest) for (i, _, label), f, e in zip(good, found, errors)]


VECTORS = "vec_id long, embedding array<float>, label int, code string"


def test_vector_codes(spark, monkeypatch):
    """Ties, null ids, labels and components, values that aren't finite, repeated rows, unused entries, negative sums; labels joined with and without broadcast."""
    rng = random.Random(5)
    vector = lambda: [rng.randrange(-6, 7) / 256 + rng.choice([0, 0.001]) for _ in range(32)]
    rows = [(i, vector(), rng.choice([1, 2, None])) for i in range(300)]
    rows += [rows[7], (None, vector(), 3), (None, vector(), None), (-5, [0.0] * 32, 1), (-5, [0.25] * 32, 1)]
    bad = [(900, None, 1), (901, [None, *vector()[1:]], 1), (902, [float("nan"), *vector()[1:]], 1), (903, [float("-inf"), *vector()[1:]], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], VECTORS)
    wanted = in_order(coded(rows + bad))
    assert table(vector_codes.op12_vectors(spark, df)) == wanted
    monkeypatch.setattr("catalume.llm.common.SENT_ROWS", 0)
    assert table(vector_codes.op12_vectors(spark, df)) == wanted


def test_few_vectors(spark):
    rows = [(i, [i / 3, *[-i / 7] * 15], None) for i in range(5)]
    few = spark.createDataFrame([(*r, None) for r in rows], VECTORS)
    assert table(vector_codes.op12_vectors(spark, few)) == coded(rows)
    odd_one = few.unionByName(spark.createDataFrame([(0, [1.0] * 4, 1, None), (9, [], 1, None)], VECTORS))
    assert table(vector_codes.op12_vectors(spark, odd_one)) == coded(rows)
    assert vector_codes.op12_vectors(spark, few.where("vec_id > 99")).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.op12_vectors(spark, spark.createDataFrame([(0, [1.0] * 20, 1, None)], VECTORS))


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(1)
    for size in (1, 3, 8):
        x, book = rng.integers(-9, 10, (500, size)), rng.integers(-9, 10, (40, size))
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        at, distance = vector_codes.nearest(x, book)
        assert (at == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def without_repeats(texts, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    at = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if at[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_repeats(spark, odd, odd_rows, docs, rows, none):
    for df, plain in ((odd, odd_rows), (docs, rows)):
        wanted = [(r[0], n, gone, sha(kept)) for r, (n, gone, kept) in zip(plain, without_repeats([r[1] for r in plain]))]
        assert table(substrings.op13_substrings(spark, df)) == in_order(wanted)
    assert substrings.op13_substrings(spark, none).count() == 0


@pytest.mark.parametrize("sent", [200_000, 0])
def test_repeats_of_all_kinds(spark, monkeypatch, sent):
    """Passages of 33 to 60 words within random texts, at ends, twice in a text, overlapping themselves, around other words; texts of one word; many surroundings of one passage."""
    monkeypatch.setattr("catalume.llm.common.SENT_ROWS", sent)
    monkeypatch.setattr(substrings, "SENT_ROWS", sent)
    monkeypatch.setattr(substrings, "BLOCK", 40)
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    some = lambda n: [word() for _ in range(n)]
    passages = [some(n) for n in (33, 34, 35, 36, 44, 45, 46, 50, 60)]
    texts = []
    for _ in range(120):
        text = some(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            text += (p if rng.random() < 0.7 else p[a:b]) + some(rng.choice([0, 1, 5, 40]))
        texts.append("\n".join(text))
    texts += ["a " * 34, "a " * 35, "a " * 36, "b\t" * 90, "c " * 40, texts[3], texts[3], None, "", " ".join(["x", "y"] * 60), " ".join(some(20) * 5)]
    texts += [" ".join([*some(3), *passages[5], *some(3)]) for _ in range(60)]
    wanted = without_repeats(texts)
    df = spark.createDataFrame([(i // 2, t, "en", "key", len(t or "")) for i, t in enumerate(texts)], DOCS).withColumnsRenamed({"source": "ranges"}).repartition(3)
    assert table(substrings.op13_substrings(spark, df)) == in_order([(i // 2, n, gone, sha(kept)) for i, (n, gone, kept) in enumerate(wanted)])
    clean = table(substrings.remove_repeats(df).select("doc_id", "text", "ranges", "n_chars"))
    assert clean == in_order([(i // 2, None if texts[i] is None else kept, "key", len(kept)) for i, (_, _, kept) in enumerate(wanted)])


def test_long_text(spark):
    """A text of 300,000 words that shares a passage with a short one."""
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    texts = [" ".join(long), " ".join(["start", *long[70_000:70_050], "end"]), PROSE]
    found = table(substrings.op13_substrings(spark, spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")))
    assert found == [(i, n, gone, sha(kept)) for i, (n, gone, kept) in enumerate(without_repeats(texts))]
    assert [r[2] for r in found] == [50, 50, 0]


def test_clashing_columns(spark, docs):
    """Columns that have the names of the operators' own."""
    named = docs.withColumns({c: F.lit("x") for c in ("key", "seed", "term", "count", "total", "rank", "row", "__salt", "kept")})
    assert table(substrings.op13_substrings(spark, named)) == table(substrings.op13_substrings(spark, docs))
    assert substrings.remove_repeats(named).columns == named.columns
    assert table(divergence.op11_divergence(spark, named)) == table(divergence.op11_divergence(spark, docs))
