"""The pipeline's near-copy stage against brute force, and on ids that are null or repeat."""

import random
from decimal import Decimal

import corpus_pipeline
from catalume.llm import simhash

from .conftest import DOCS

SOUP = "seven wizards quietly boil a large kettle of soup beside the old mill"
BIRD = "no bird sings above the frozen harbour where nine grey ships lie waiting"


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    return sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in simhash.drop_near_copies(df).collect()), key=str)


def test_texts_without_ids(spark):
    assert kept(spark, [(None, SOUP), (None, BIRD), (None, SOUP)]) == [(True, None, BIRD), (True, None, SOUP)]
    assert kept(spark, [(None, SOUP), (3, SOUP), (5, SOUP)]) == [(False, 3, SOUP)]


def test_repeated_id(spark):
    assert kept(spark, [(7, SOUP), (7, BIRD), (7, BIRD), (9, SOUP)]) == [(False, 7, BIRD), (False, 7, SOUP)]


def test_pairs_of_four_fifths(spark, none):
    """Near copies by five-word Jaccard similarity, at any distance of their fingerprints, go; others stay."""
    draw = random.Random(5)
    rows = []
    for _ in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(120)]
        for changes in (0, 1, 2, 5):
            now = [*words]
            for c in range(changes):
                now[20 + 18 * c] = f"x{draw.randrange(5000)}"
            rows.append((len(rows), " ".join(now)))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = [shingles(t) for _, t in rows]
    root = [*range(len(rows))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    wanted = {min(i for i, r in enumerate(root) if r == group) for group in root}
    assert 12 < len(wanted) < len(rows)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_copies"]
    assert {r["doc_id"] for r in stage(spark, df, "").collect()} == wanted
    assert stage(spark, none, "").count() == 0


def groups(texts):
    """The smallest number of each text's group by five-word Jaccard similarity of 0.8, by brute force."""
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    sets, root = [shingles(t) for t in texts], [*range(len(texts))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_large_groups(spark):
    """150 copies of one text that are alike only through it, and 150 texts that share half of their words with each other."""
    draw = random.Random(9)
    word = lambda: f"w{draw.randrange(100_000)}"
    base, passage = [word() for _ in range(200)], [word() for _ in range(60)]
    texts = []
    for i in range(150):
        now = [*base]
        for place in draw.sample(range(5, 195), 3 + i % 2):
            now[place] = word()
        texts += [" ".join(now), " ".join(passage + [word() for _ in range(60)])]
    texts.append(" ".join(base))
    draw.shuffle(texts)
    wanted = {min(i for i, r in enumerate(root) if r == g) for root in [groups(texts)] for g in root}
    assert 150 < len(wanted) < 170
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    assert {r["doc_id"] for r in simhash.drop_copies(df).collect()} == wanted


def test_stage_on_ids(spark):
    rows = [(7, SOUP), (7, BIRD), (9, SOUP), (None, "one two"), (None, "three four"), (None, ""), (8, None)]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    found = {(r["doc_id"], r["text"]) for r in simhash.drop_copies(df).collect()}
    assert found == {(7, SOUP), (7, BIRD), (None, "one two"), (None, "three four"), (8, None)}


def test_full_bucket(spark):
    """A bucket of 12 texts: two are alike without the leader, one is alike to a text of the leader's group only."""
    draw = random.Random(3)
    words = lambda n: [f"w{draw.randrange(1_000_000)}" for _ in range(n)]
    texts = [words(120) for _ in range(12)]
    texts[7] = texts[3][:110] + words(10)
    texts[5] = texts[11][:108] + words(12)
    texts[9] = words(12) + texts[5][12:]
    texts = [" ".join(t) for t in texts]
    wanted = groups(texts)
    assert [i for i, r in enumerate(wanted) if r != i] == [7, 9, 11] and wanted[9] == wanted[11] == 5
    nodes = [(Decimal(i), "", draw.getrandbits(62), [1, *(draw.getrandbits(62) for _ in range(15))]) for i in range(12)]
    nodes = spark.createDataFrame(nodes, "text_key decimal(38,0), name string, fingerprint long, buckets array<long>")
    rows = spark.createDataFrame([(Decimal(i), "", t) for i, t in enumerate(texts)], "text_key decimal(38,0), name string, text string")
    found = {int(r["text_key"]): int(r["root"]) for r in simhash.copy_roots(nodes, rows).collect()}
    assert {i: found.get(i, i) for i in range(12)} == dict(enumerate(wanted))


def test_prefix_pairs(spark):
    """The exact join of sets finds every pair of four fifths or more whose roots differ, as brute force does."""
    draw = random.Random(4)
    sets = []
    for _ in range(60):
        base = draw.sample(range(400), draw.choice([1, 5, 20, 90]))
        for _ in range(4):
            kept = draw.sample(base, max(1, len(base) - draw.randrange(1 + len(base) // 6)))
            sets.append(({*kept} | {*draw.sample(range(400), draw.randrange(1 + len(base) // 8))}, draw.randrange(4)))
    alike = {(i, j) for i, (a, r) in enumerate(sets) for j, (b, q) in enumerate(sets[:i]) if r != q and 5 * len(a & b) >= 4 * len(a | b)}
    df = spark.createDataFrame([(i, r, sorted(s)) for i, (s, r) in enumerate(sets)], "text_key long, root long, set array<long>")
    found = {(r["u"], r["v"]) for r in simhash.prefix_pairs(df).collect()}
    assert len(alike) > 50 and alike <= found and len(found) < 5 * len(alike)
