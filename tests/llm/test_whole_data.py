"""Nothing is lost: licenses with words put in, left out and quoted, texts without spaces, lines that only look like boilerplate."""

import random

import numpy as np
import pytest
from catalume.llm import langid, license_scan, quality
from pyspark.sql import functions as F

WORDS = {label: [w for w in "".join(c if c.isascii() and (c.isalnum()) else " " for c in t.lower()).split()] for label, t in license_scan.TEXTS.items()}


def labels(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in license_scan.op2_licenses(spark, df).collect()}


def test_quotation_within_a_license(spark):
    mit = WORDS["mit-text"]
    quoted = mit[:31] + mit[40:45] + mit[31:]
    spaced = [x for i in range(0, len(mit), 16) for x in [*mit[i : i + 16], "new"]]
    found = labels(spark, [" ".join(quoted), " ".join(spaced), " ".join(mit), " ".join(mit + ["and"] * 4 + mit), " ".join(mit[:25])])
    assert [found[i]["labels"] for i in range(4)] == ["mit-text"] * 4 and found[4]["labels"] == ""
    grams = len(mit) - 4
    assert found[0]["score"] >= (grams - 4) / grams and found[1]["score"] > 0.7 and found[2]["score"] == 1
    assert [found[i]["n_texts"] for i in range(4)] == [1, 1, 1, 2]


def best_chain(template, words):
    """The most k-grams of a template that stand in a text in the template's order, by dynamic programming over all hits, each at most GAP diagonals from the one before and all within the length."""
    k, most = license_scan.TEXT_GRAM, license_scan.STRETCH * (len(template) + 1)
    places = {}
    for p in range(len(template) - k + 1):
        places.setdefault(tuple(template[p : p + k]), []).append(p)
    hits = [(at, p) for at in range(len(words) - k + 1) for p in places.get(tuple(words[at : at + k]), ())]
    best, start = [], []
    for i, (at, p) in enumerate(hits):
        before = [(best[j], start[j]) for j in range(i) if hits[j][0] < at and hits[j][1] < p and abs((at - p) - (hits[j][0] - hits[j][1])) <= license_scan.GAP and at + k - start[j] <= most]
        n, first = max(before, default=(0, at))
        best.append(n + 1)
        start.append(first)
    return max(best, default=0) / (len(template) - k + 1)


@pytest.mark.parametrize("seed", range(2))
def test_random_edits(spark, seed):
    """Words put in, left out, changed, and passages quoted within: what a chain of single hits finds is found."""
    rng = random.Random(seed)
    texts, wanted = [], []
    for _ in range(60):
        label = rng.choice(["mit-text", "apache-2.0-notice", "isc-text", "boost-text", "zlib-text"])
        text = list(WORDS[label])
        for _ in range(rng.randrange(5)):
            at, kind = rng.randrange(len(text)), rng.randrange(4)
            if kind == 0:
                text[at:at] = [f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 7))]
            elif kind == 1:
                del text[at : at + rng.randrange(1, 7)]
            elif kind == 2:
                text[at] = "changed"
            else:
                a = rng.randrange(len(WORDS[label]) - 8)
                text[at:at] = WORDS[label][a : a + rng.randrange(5, 9)]
        texts.append(" ".join(["before"] * rng.randrange(9) + text + ["after"] * rng.randrange(9)))
        wanted.append((label, best_chain(WORDS[label], texts[-1].split())))
    found = labels(spark, texts)
    for i, (label, share) in enumerate(wanted):
        if share >= license_scan.SHARE + 0.02:
            assert label in found[i]["labels"].split(","), (texts[i], share)
            assert found[i]["score"] >= share - 0.06
        elif share < license_scan.SHARE - 0.02:
            assert label not in found[i]["labels"].split(",")


def test_texts_without_spaces_are_learned(spark):
    rng = random.Random(6)
    chinese = lambda: "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(3000))
    english = lambda: " ".join(rng.choice(["the", "of", "house", "river", "stands", "quietly", "morning", "and"]) for _ in range(400))
    rows = [(i, chinese() if i % 2 else english(), "zh" if i % 2 else "en") for i in range(60)] + [(100, chinese() + " only a few words here", None), (101, english() + " 山水", None)]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.op7_langid(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found == {i: "zh" if i % 2 else "en" for i in range(60)} | {100: "zh", 101: "en"}


def test_passages_hold_the_whole_text(spark):
    text = "a" * 4500 + " " + "b " * 70 + "1" * 3000
    (found,) = spark.createDataFrame([(text,)], "t string").select(langid.passages(F.col("t"))).first()
    assert "".join(found).replace(" ", "").rstrip("1") == text.replace(" ", "").rstrip("1") and max(map(len, found)) <= langid.SAMPLE_CHARACTERS


def test_training_in_batches(monkeypatch):
    """Chains that are worked on in many small batches give the same model; with more labels fewer words are held."""
    lines = [(f"word{i % 7} and more{i % 5}", "xyz"[i % 3]) for i in range(120)]
    one = langid.fit(lines)
    monkeypatch.setattr(langid, "batch_words", lambda k: 20)
    many = langid.fit(lines)
    assert np.allclose(one["weights"], many["weights"]) and np.allclose(one["transition"], many["transition"])
    monkeypatch.undo()
    assert langid.batch_words(4) == langid.BATCH and langid.batch_words(100) * 100**2 <= 1.1e7


def test_lines_that_look_like_boilerplate(spark):
    good = ["An exhibition catalog in the museum was printed by the old press in a small town last year, as told.", "« One », said « two » and « three », in the long evening of that day, he went home at last.", "| a | b | c " + "word " * 40 + "end."]
    bad = ["Please log in to read the rest of this page of ours today.", "Home | News | Sport | More.", "Alle Rechte vorbehalten, wie immer in diesem Haus und an jedem Tag im Jahr."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    lost = {r["doc_id"]: r["lost_words"] for r in quality.op5_quality(spark, df).collect()}
    assert [lost[i] == 0 for i in range(6)] == [True] * 3 + [False] * 3
