"""The pipeline's stages against plain Python, each on what the one before kept."""

import time
from collections import Counter
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalume.llm.queries import VOCABULARY

from .conftest import FOLDER
from .test_near_copies import groups
from .test_scans import SPACE_WORD, personal


def test_stages(spark, docs, tmp_path):
    stages, now = dict(corpus_pipeline.STAGES), docs
    kept = {}
    for name, stage in stages.items():
        out = stage(spark, now, FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now.collect()
        if name != "bpe":
            assert now.columns == docs.columns
    known = {r["doc_id"]: r["text"] for r in kept["language_id"]}
    assert all(any(map(str.isalpha, t or "")) for t in known.values()) and len(known) >= 0.9 * docs.where(F.col("text").rlike(r"\p{L}")).count()
    ids = sorted(known)
    first = {}
    for i, root in zip(ids, groups([known[i].lower() for i in ids])):
        first.setdefault(root, i)
    assert sorted(r["doc_id"] for r in kept["simhash_near_copies"]) == sorted(first.values())
    assert not any(personal(r["text"]) for r in kept["pii"]) and len(kept["pii"]) == len(first)
    clean, times = {r["doc_id"]: r["text"] for r in kept["pii"]}, Counter(r["doc_id"] for r in kept["source_mixing"])
    assert max(times.values()) <= 2 and all(clean[r["doc_id"]] == r["text"] for r in kept["source_mixing"])
    words = lambda rows: sum(len(SPACE_WORD.findall(r["text"])) for r in rows)
    assert abs(words(kept["source_mixing"]) / words(kept["pii"]) - 1.5) < 0.25
    t = Tokenizer.from_file(VOCABULARY)
    assert len(kept["bpe"]) == len(kept["source_mixing"]) and all(r["round_trip"] for r in kept["bpe"])
    assert all(r["n_tokens"] == len(t.encode(clean[r["doc_id"]], add_special_tokens=False).ids) for r in kept["bpe"])


def test_empty(spark, none):
    now = none
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, FOLDER)
    assert now.count() == 0


def test_odd_rows(spark, odd, odd_rows, tmp_path):
    """Null ids, texts and sources, empty and very long texts, repeated rows, and a column whose name operators use, through all stages."""
    now = odd.withColumn("position", F.lit("mine")).withColumn("text_key", F.lit(None).cast("long"))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, FOLDER).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "bpe" or now.columns == columns
        if name == "simhash_near_copies":
            texts = [r["text"] for r in now.collect()]
            assert len(texts) == len(set(texts)) and any(len(t) > 60_000 for t in texts)
    assert now.count() > 0 and now.where("NOT round_trip").count() == 0


def test_no_shuffle_files_stay(spark, docs, tmp_path):
    """What a stage has shuffled is gone soon after its rows are written, though the driver's JVM has collected no garbage."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    left = lambda: {str(f) for folder in folders for f in Path(folder).rglob("shuffle_*.data")}
    before = left()
    corpus_pipeline.mix_sources(spark, docs, FOLDER).write.parquet(f"{tmp_path}/mixed")
    until = time.monotonic() + 10
    while left() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not left() - before
