"""Personal data, licenses and quality rules against plain Python."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from catalume.llm import license_scan, pii, quality
from pyspark.sql import functions as F

from .conftest import FOLDER, in_order, table

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passes_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personal(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text and len(text) < 20_000 else []
    spans += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))] if len(text) < 20_000 else []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and passes_luhn(digits(m))]
    spans += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


def personal_row(doc_id, text):
    spans = personal(text)
    counts = Counter(s.split(":")[0] for s in spans)
    return (doc_id, *(counts[k] for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(spans).encode()).hexdigest())


PII_COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def test_personal_data(spark, docs, rows, odd, odd_rows):
    for df, plain in ((docs, rows), (odd, odd_rows)):
        out = pii.op1_pii(spark, df)
        assert table(out, *PII_COLUMNS) == in_order(personal_row(r[0], r[1]) for r in plain)
        for r, spans in out.join(df.select("doc_id", "text").distinct(), "doc_id").select("text", "spans").collect():
            assert set(personal(r)) <= set(spans.split(","))


def test_personal_data_of_nothing(spark, none):
    assert pii.op1_pii(spark, none).count() == 0 and pii.sanitise(none).columns == none.columns


def test_disclosing_terms(spark):
    """A name that stands by one address only goes, a word that stands everywhere stays."""
    texts = [f"zanzibarowitz mailed from zan@example.org about the garden {i}" for i in range(4)] + [f"somebody wrote about the garden number {i} from home" for i in range(60)]
    df = spark.createDataFrame([(i, t, "x", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_chars long")
    clean = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert clean[0]["text"] == "[removed] [removed] from [EMAIL] about the garden 0"
    assert clean[10]["text"] == texts[10] and clean[0]["spans"] == "x" and clean[0]["n_chars"] == len(clean[0]["text"])
    found = pii.op1_pii(spark, df).where("doc_id = 0").first()
    assert "removed:0:13" in found["spans"] and found["n_email"] == 1


def test_sanitised_texts_have_no_base_spans(spark, docs, odd):
    for df in (docs, odd):
        out = pii.sanitise(df)
        assert out.columns == df.columns and out.count() == df.count()
        assert out.where(F.size(pii.base_spans(F.coalesce("text", F.lit("")))) > 0).count() == 0


PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def license_row(doc_id, text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(i, label) for label, p in PHRASES.items() for w in [p.split()] for i in range(len(words) - len(w) + 1) if words[i : i + len(w)] == w]
    places = [i for i, _ in found]
    return doc_id, len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_license_phrases(spark, docs, rows, odd, odd_rows):
    for df, plain in ((docs, rows), (odd, odd_rows)):
        out = license_scan.op2_licenses(spark, df)
        assert table(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == in_order(license_row(r[0], r[1]) for r in plain)
        for base, labels, score in out.select("base_labels", "labels", "score").collect():
            assert set(base.split(",")) - {""} <= set(labels.split(",")) and 0 <= score <= 1


def test_license_texts(spark, none):
    words = license_scan.TEXTS["mit-text"].split()
    texts = ["foreword " + " ".join(words), " ".join(words[:30] + ["extra", "words"] + words[30:]), " ".join(words[:12]), "nothing of the kind " * 30]
    out = license_scan.op2_licenses(spark, spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in out] == ["mit-text", "mit-text", "", ""]
    assert out[0]["score"] == 1 and 0.8 < out[1]["score"] < 1 and out[2]["score"] == 0
    spans = license_scan.scan_spans(spark.createDataFrame([(0, texts[0])], "doc_id long, text string")).where("label IS NOT NULL").first()
    assert spans["first_word"] == 1
    assert license_scan.op2_licenses(spark, none).count() == 0


def spans_of(spark, texts):
    out = license_scan.scan_spans(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).where("label IS NOT NULL AND NOT phrase")
    return sorted((r["doc_id"], r["first_word"], r["end_word"], r["label"]) for r in out.collect())


def test_license_copies(spark):
    """A notice stays found whatever copies follow it, and each copy that holds enough of it is a span."""
    notice = license_scan.TEXTS["cc-by-notice"].split()
    n = len(license_scan.TEXTS["cc-by-notice"].replace("4.0", "4 0").replace(".", "").split())
    cut = notice[4:]
    texts = [" ".join(notice + cut * times) for times in range(4)]
    found = spans_of(spark, texts)
    for i in range(4):
        assert [(a, b) for d, a, b, _ in found if d == i] == [(0, n), *((n + (n - 4) * j, n + (n - 4) * (j + 1)) for j in range(i))]
    assert spans_of(spark, [" ".join(notice * 50)]) == [(0, n * j, n * j + n, "cc-by-notice") for j in range(50)]


@pytest.mark.parametrize("label", sorted(license_scan.TEXTS))
def test_each_license_alone(spark, label):
    """A text has its own label only, whole and with one word in ten left out."""
    words = license_scan.TEXTS[label].split()
    text = "before it " + " ".join(words) + " and after"
    assert {x[3] for x in spans_of(spark, [text, " ".join(w for i, w in enumerate(words) if i % 12 != 6)])} == {label}


def test_license_odd(spark, odd, none):
    clash = odd.selectExpr("doc_id", "text", "lang AS template", "source AS grams", "n_chars AS diagonal", "text AS label")
    assert table(license_scan.op2_licenses(spark, clash)) == table(license_scan.op2_licenses(spark, odd))
    assert license_scan.op2_licenses(spark, none).count() == 0


def quality_row(doc_id, text):
    words, lines = SPACE_WORD.findall(text or ""), [x for x in (text or "").split("\n") if SPACE_WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)})
    return doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated, len(words) < 10 or 100 * repeated > 20 * len(words)


def test_quality(spark, docs, rows, odd, odd_rows, none):
    for df, plain in ((docs, rows), (odd, odd_rows)):
        out = quality.op5_quality(spark, df)
        assert table(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == in_order(quality_row(r[0], r[1]) for r in plain)
        assert out.where("base_failed AND kept").count() == 0
    assert quality.op5_quality(spark, none).count() == 0


def test_quality_sql(spark, docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    names = sorted(quality.op5_quality(spark, docs).columns)
    wanted = con.sql(f"SELECT {', '.join(names)} FROM ({quality.OP5_SQL})").fetchall()
    assert table(quality.op5_quality(spark, docs), *names) == in_order(wanted)


def test_lines(spark):
    good, bar = "This is a whole sentence of ordinary prose, as books have them.", "Home | News | Sport | About | Contact"
    df = spark.createDataFrame([(0, f"{good}\n{bar}", "x"), (1, f"Up we go.\n{bar}\n{bar} again\nAll rights reserved.", "x")], "doc_id long, text string, n_words string")
    out = quality.clean_lines(df).orderBy("doc_id").collect()
    assert [r["clean_text"] for r in out] == [good, "Up we go."] and [r["kept"] for r in out] == [True, False]


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "a a a a a a", "a b c d e f g h i j", "a b c d e b c d e a b c d e f"])
def test_repeated_words(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.op5_quality(spark, df).first()["n_repeat_words"] == quality_row(1, text)[5]
