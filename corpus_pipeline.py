"""The training-data pipeline: language ID, near-copies, personal data, mixing and tokens, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm import bpe, langid, mixing, pii, simhash
from catalume.llm.common import documents, materialize
from catalume.llm.queries import VOCABULARY

#: A document goes if its language is unknown or holds less than this share of its words' posterior.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in no single language; without labelled documents to learn from, all stay."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    if not model["labels"]:
        return docs
    labelled = langid.label_documents(docs, model)
    return labelled.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies: texts that share four fifths of their five-word shingles."""
    return simhash.drop_copies(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, in the texts."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in the order of training."""
    return mixing.mix(docs).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and whether decoding gave the text back."""
    coded = bpe.code_documents(docs.select("doc_id", "lang", "source", "text"), VOCABULARY)
    return coded.select("doc_id", "lang", "source", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_copies", drop_near_copies),
    ("pii", sanitise),
    ("source_mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: SQL can't express fingerprints, the language model or the tokenizer; tests/llm hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
