"""Terms that disclose an entity, wherever in its documents they stand."""

import math
import random
import re
import time
from collections import Counter
from itertools import product

from catalume.llm import pii

from .conftest import DOCS

FILLER = "this sentence says nothing at all about anyone and only fills the page with plain words. " * 3


def cleaned(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    return {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}


def test_terms_far_from_their_entity(spark):
    """A name further off than a line, and each of its occurrences, goes from all documents that hold the address."""
    held = [f"Zanzibarowitz arrived. {FILLER} Write to zan@example.org now. {FILLER} So says zanzibarowitz {i}" for i in range(3)]
    other = [f"{FILLER} arrived now, write to nobody, so says number {i}" for i in range(60)]
    clean = cleaned(spark, [*held, *other])
    for i in range(3):
        assert clean[i] == f"[removed] arrived. {FILLER} Write to [EMAIL] now. {FILLER} So says [removed] {i}"
    assert all(clean[3 + i] == t for i, t in enumerate(other))


def test_document_counts(spark):
    """A word that stands near an address in two documents, and far from it in a third, is counted in all three."""
    near = [f"call quixandor at qui@example.org today {i}" for i in range(2)]
    texts = [*near, f"quixandor is here. {FILLER} call at qui@example.org today", *(f"{FILLER} call here at today {i}" for i in range(60))]
    clean = cleaned(spark, texts)
    assert all("quixandor" not in t for t in clean.values()) and clean[0] == "call [removed] at [EMAIL] today 0"


def marked_by_hand(texts):
    """Terms and kinds of each text, from counts over the different texts."""
    address = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    words = lambda t: re.findall(r"[^\W\d_]{3,}", address.sub(" ", t).lower())
    once = set(texts)
    of_term, of_entity, both = Counter(), Counter(), Counter()
    for t in once:
        terms, entities = set(words(t)), {m[0].lower() for m in address.finditer(t)}
        of_term.update(terms)
        of_entity.update(entities)
        both.update(product(entities, terms))
    n, out = len(once), []
    for t in texts:
        found = {}
        for e, w in product({m[0].lower() for m in address.finditer(t)}, set(words(t))):
            if of_entity[e] < n:
                share = math.log2(n * both[e, w] / (of_entity[e] * of_term[w])) / math.log2(n / of_entity[e])
                found[w] = max(found.get(w, 0), share)
        out.append(sorted((w, "removed" if s >= pii.REMOVE else "general") for w, s in found.items() if s >= pii.GENERALISE))
    return out


def marked(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r["terms"] for r in pii.find_personal(df, "doc_id").select("row.doc_id", "terms").collect()}
    return [sorted({(t[s["start"] : s["end"]].lower(), s["kind"]) for s in out[i]}) for i, t in enumerate(texts)]


def corpus(seed):
    draw = random.Random(seed)
    texts = []
    for i in range(120):
        rare, usual = draw.sample(range(300), 6), draw.choices(range(12), k=10)
        words = [f"{'abcdefghij'[w % 10] * 3}{chr(97 + w // 10 % 26)}{'xyz'[w // 260 % 3]}" for w in [*rare, *usual]]
        words += [f"{draw.choice(['ann', 'bob', 'cat', 'dan'])}@example.org" for _ in range(i % 3 == 0)] + [f"single{i}@example.org" for _ in range(i % 4 == 0)]
        draw.shuffle(words)
        texts.append(" ".join(words).title() if i % 5 == 0 else " ".join(words))
    return texts


def test_shares_against_brute_force(spark):
    """Entities of one text and of several, terms of all frequencies, and copies, which count once."""
    texts = corpus(3)
    wanted = marked_by_hand(texts)
    assert {k for row in wanted for _, k in row} == {"removed", "general"}
    assert marked(spark, texts) == wanted
    assert marked(spark, texts * 5) == wanted * 5


def test_many_repeated_texts(spark, monkeypatch):
    """Keys of repeated texts that are too many to be sent to all tasks give the same marks."""
    texts = corpus(4)
    texts += texts[:40] * 3
    monkeypatch.setattr(pii, "SENT_KEYS", 5)
    assert marked(spark, texts) == marked_by_hand(texts)


def test_entity_of_one_text(spark):
    """A name that stands in no other text goes; what others write too stays."""
    clean = cleaned(spark, [f"quixandor says call here today at qui@example.org. {FILLER}", *(f"{FILLER} he says call here today at number {i}" for i in range(60))])
    assert clean[0] == f"[removed] says call here today at [EMAIL]. {FILLER}"


def test_many_entities_in_a_text(spark):
    """Time grows with the text, not with its square: 20,000 addresses among 60,000 words."""
    text = " ".join(f"write to user{i}@example.org or not" for i in range(20_000))
    began = time.time()
    row = pii.op1_pii(spark, spark.createDataFrame([(1, text), (2, "write to nobody or not")], "doc_id long, text string")).where("doc_id = 1").first()
    assert row["n_email"] == 20_000 and time.time() - began < 90


def test_many_shared_entities(spark):
    """Two texts with the same 20,000 addresses and 20,000 terms, and others that share few of them; a smaller set of the same kind by hand."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))

    def texts(n):
        both = [f"{name(i)} u{i}@example.org" for i in range(n)]
        return [" ".join(both), " ".join(both) + " again", " ".join(both[: n // 2]) + " half u0@example.org", "u1@example.org alone with aaaa", *(f"plain {name(i)} text" for i in range(40))]

    small = texts(60)
    assert marked(spark, small) == marked_by_hand(small)
    began = time.time()
    rows = pii.op1_pii(spark, spark.createDataFrame([*enumerate(texts(20_000))], "doc_id long, text string")).where("doc_id < 2").collect()
    assert [r["n_email"] for r in rows] == [20_000] * 2 and rows[0]["n_terms"] > 0 and time.time() - began < 90


def test_odd_rows_are_sanitised(spark, odd, odd_rows):
    """Spans are cut out of texts of any length at the right places."""
    out = {(r["doc_id"], r["text"]) for r in pii.sanitise(odd.select("doc_id", "text")).collect()}
    spans = {(r["doc_id"], r["text"]): r for r in pii.find_personal(odd.select("doc_id", "text")).select("row.doc_id", "row.text", "base", "terms").collect()}
    wanted = set()
    for (i, text), r in spans.items():
        every = sorted([(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in r["base"]] + [(s["start"], s["end"], "[removed]" if s["kind"] == "removed" else text[s["start"]] + "…") for s in r["terms"]])
        at, parts = 0, []
        for a, b, mark in every:
            parts += [text[at:a] if a > at else "", mark if a >= at else ""]
            at = max(at, b)
        wanted.add((i, None if text is None else "".join(parts) + text[at:]))
    assert out == wanted and any("[EMAIL]" in (t or "") for _, t in out)
