"""The training-data operators as queries over the tables of a folder, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, langid, license_scan, media, mixing, pii, quality, sharding, simhash, substrings, vector_codes, warc
from .common import documents

#: The tokenizer that op3 encodes with; the file is read by the driver and sent to the executors.
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda s, d: pii.op1_pii(s, documents(s, d)),
    "op2_licenses": lambda s, d: license_scan.op2_licenses(s, documents(s, d)),
    "op3_bpe": lambda s, d: bpe.op3_bpe(s, documents(s, d), VOCABULARY),
    "op4_mixing": lambda s, d: mixing.op4_mixing(s, documents(s, d)),
    "op5_quality": lambda s, d: quality.op5_quality(s, documents(s, d)),
    "op6_simhash": lambda s, d: simhash.op6_simhash(s, documents(s, d)),
    "op7_langid": lambda s, d: langid.op7_langid(s, documents(s, d)),
    "op8_media": lambda s, d: media.op8_media(s, documents(s, d)),
    "op9_warc": lambda s, d: warc.op9_warc(s, pages(s, d)),
    "op10_sharding": lambda s, d: sharding.op10_sharding(s, documents(s, d)),
    "op11_divergence": lambda s, d: divergence.op11_divergence(s, documents(s, d)),
    "op12_vectors": lambda s, d: vector_codes.op12_vectors(s, s.read.parquet(f"{d}/embeddings.parquet")),
    "op13_substrings": lambda s, d: substrings.op13_substrings(s, documents(s, d)),
}

ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.OP4_SQL, "op5_quality": quality.OP5_SQL, "op9_warc": warc.OP9_SQL, "op11_divergence": divergence.OP11_SQL, "op12_vectors": vector_codes.OP12_SQL, "op13_substrings": substrings.OP13_SQL}
