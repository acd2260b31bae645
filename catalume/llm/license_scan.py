"""License scans by diagonal voting.

All rolling word k-grams of the documents are joined with the k-grams of the license templates. A hit votes for the
diagonal (its place in the document less its place in the template); a template that stands in a text unchanged puts all
its votes on one diagonal, one with words left out or put in on neighbouring ones. Runs of votes on neighbouring diagonals
are merged to chains along which the places in the template go on, each run with the chain before it that has most votes:
what stands between them on other diagonals, such as a quotation, is passed over. What has enough of a template's votes in
about its length is a span; of chains that overlap the one with the most votes counts. Phrases are templates of which
every k-gram must hit on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let

#: Words of a k-gram, for phrases and for texts; neighbouring diagonals lie at most GAP apart; the share of a text's k-grams that must hit, and the longest span in template lengths.
PHRASE_GRAM, TEXT_GRAM, GAP, SHARE, STRETCH = 2, 5, 12, 0.5, 1.5
#: License phrases, and opening or central passages of public license texts, by label.
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
TEXTS = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-3-clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "boost-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "cc0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}
#: Separator of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text):
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS, -1), lambda w: w != "")


def _gram(hashes: str, i, k: int):
    return F.xxhash64(F.lit(k), *(F.get(hashes, i + j) for j in range(k)))


def _grams(hashes: str, k: int):
    """Hashes of all k-grams of a column of word hashes, in order."""
    last = F.size(hashes) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _gram(hashes, i, k))).otherwise(F.array().cast("array<long>"))


def templates(spark: SparkSession, phrases: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """One row a k-gram of a template: __gram, __of (its words), template, label, phrase, place, grams."""
    rows = [(label, True, PHRASE_GRAM, t) for label, t in phrases.items()] + [(label, False, TEXT_GRAM, t) for label, t in texts.items()]
    df = spark.createDataFrame(rows, "label string, phrase boolean, k int, text string")
    df = df.select("*", license_words(F.col("text")).alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.select("*", F.when(F.col("phrase"), _grams("hashes", PHRASE_GRAM)).otherwise(_grams("hashes", TEXT_GRAM)).alias("g"))
    df = df.select("label", "phrase", "k", "words", F.size("g").alias("grams"), F.posexplode_outer("g").alias("place", "__gram"))
    return df.select("__gram", F.array_join(F.slice("words", F.col("place") + 1, F.col("k")), " ").alias("__of"), F.concat_ws(":", "phrase", "label").alias("template"), "label", "phrase", "place", "grams")


def find_hits(docs: DataFrame, phrases: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """The k-grams of ``docs`` (doc_id, text) that stand in a template, and a row without template for each document: doc_id, text_key, n_words, template, ..., diagonal."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), license_words(F.col("text")).alias("__words")).withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    rows = rows.select("*", F.greatest(F.size("__words") - PHRASE_GRAM + 1, F.lit(0)).alias("__short"), F.concat(F.array(F.lit(None).cast("long")), _grams("__hashes", PHRASE_GRAM), _grams("__hashes", TEXT_GRAM)).alias("__all"))
    # outer: the optimizer puts no filter on the array's size below, which would make the array anew for each element
    rows = rows.select("doc_id", "text_key", "__words", "__short", F.posexplode_outer("__all").alias("__pos", "__hash"))
    short = F.col("__pos") <= F.col("__short")
    at = F.when(short, F.col("__pos") - 1).otherwise(F.col("__pos") - 1 - F.col("__short"))
    words = F.array_join(F.slice("__words", at + 1, F.when(short, PHRASE_GRAM).otherwise(TEXT_GRAM)), " ")
    # the templates are a fixed table of some hundred rows
    hit = rows.join(F.broadcast(templates(docs.sparkSession, phrases, texts)), F.col("__hash") == F.col("__gram"), "left")
    # words are put together for hits only
    hit = hit.where((F.col("__pos") == 0) | F.when(F.col("template").isNotNull(), words == F.col("__of")).otherwise(False))
    return hit.select("doc_id", "text_key", F.size("__words").cast("long").alias("n_words"), "template", "label", "phrase", "place", "grams", (at - F.col("place")).alias("diagonal"))


def scan_spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """The license spans of ``docs`` (doc_id, text), and a row without label for each document.

    doc_id, text_key, n_words, copies (rows that repeat doc_id and text; in rows without label), label, phrase, first_word
    and end_word (words from 0, end exclusive), score (share of the template's k-grams found). Null and empty texts have no
    words; texts of any length are scanned whole; an empty table gives no rows; other columns of ``docs`` are not looked at,
    whatever their names. Spans of different templates may overlap.
    """
    where = ["doc_id", "text_key", "n_words", "template", "label", "phrase", "grams"]
    lines = find_hits(docs, phrases, texts).groupBy(*where, "diagonal").agg(F.array_sort(F.collect_set("place")).alias("places"), F.count(F.lit(1)).alias("copies"))
    k = F.when(F.col("phrase"), PHRASE_GRAM).otherwise(TEXT_GRAM)

    def run(offset: Column) -> Column:
        """The places that differ from their index by ``offset``: they follow each other."""
        own = F.filter("places", lambda p, i: p - i == offset)
        low = F.get(own, F.lit(0))
        first = (F.col("diagonal") + low).cast("long")
        return F.struct(first.alias("first"), F.col("diagonal").cast("int").alias("diagonal"), (first + F.size(own) - 1 + k).alias("end"), low.alias("low"), (low + F.size(own) - 1).alias("high"), F.size(own).alias("score"))

    runs = F.transform(F.array_distinct(F.transform("places", lambda p, i: p - i)), run)
    groups = lines.select(*where, "copies", F.when(F.col("template").isNotNull(), runs).alias("runs")).groupBy(*where).agg(F.max("copies").alias("copies"), F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"))
    found = F.when(F.col("phrase"), F.filter("runs", lambda x: x["score"] == F.col("grams"))).otherwise(best_chains(F.col("runs"), F.col("grams")))
    spans = groups.select(*where, "copies", F.explode_outer(F.when(F.col("template").isNotNull(), found)).alias("x")).where("template IS NULL OR x IS NOT NULL")
    return spans.select("doc_id", "text_key", "n_words", "copies", "label", "phrase", F.col("x.first").alias("first_word"), F.col("x.end").alias("end_word"), (F.col("x.score") / F.col("grams")).alias("score"))


CHAIN = "array<struct<first:bigint,diagonal:int,end:bigint,low:int,high:int,score:int>>"


def best_chains(runs: Column, grams: Column) -> Column:
    """Disjoint chains of sorted ``runs`` (first, diagonal, end, low, high, score) that hold SHARE of a template's ``grams`` in STRETCH times its length.

    Each run goes on with the chain before it that makes most votes of both (of equal ones the latest begun), or begins one.
    A chain's next run lies at most GAP diagonals from its last, ends at a later place of the template, and within the
    length; places that both have count once. Only chains whose last run began within that length can be met, and these
    are among as many last runs as it has words, twice over.
    """
    length = STRETCH * (grams + TEXT_GRAM)
    last = (2 * length).cast("int")

    def go_on(chains: Column, x: Column) -> Column:
        near = F.slice(chains, F.greatest(F.size(chains) - last + 1, F.lit(1)), last)
        fits = F.filter(near, lambda c: (F.abs(c["diagonal"] - x["diagonal"]) <= GAP) & (c["high"] < x["high"]) & (x["end"] - c["first"] <= length))
        both = F.transform(fits, lambda c: F.struct((c["score"] + x["high"] - F.greatest(c["high"], x["low"] - 1)).alias("score"), c["first"].alias("first")))
        best = F.array_max(F.concat(both, F.array(F.struct(x["score"].alias("score"), x["first"].alias("first")))))
        chain = let(best, lambda b: F.struct(b["first"].alias("first"), x["diagonal"].alias("diagonal"), x["end"].alias("end"), x["low"].alias("low"), x["high"].alias("high"), b["score"].alias("score")))
        return F.concat(chains, F.array(chain))

    none = F.array().cast(CHAIN)
    good = F.filter(F.aggregate(runs, none, go_on), lambda c: (c["score"] >= SHARE * grams) & (c["end"] - c["first"] <= length))
    ordered = F.array_sort(F.transform(good, lambda c: F.struct((-c["score"]).alias("rank"), (c["end"] - c["first"]).alias("size"), c.alias("c"))))
    apart = lambda kept, c: ~F.exists(kept, lambda o: (o["first"] < c["end"]) & (c["first"] < o["end"]))
    return F.sort_array(F.aggregate(ordered, none, lambda kept, x: F.when(apart(kept, x["c"]), F.concat(kept, F.array(x["c"]))).otherwise(kept)))


def op2_licenses(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Phrases and license texts of every document; ``score`` is the largest share of a template found, 1 for a phrase, 0 without any."""
    spans = scan_spans(docs.select("doc_id", "text"))
    base = F.col("phrase")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("doc_id", "text_key", "n_words").agg(
        F.max(F.when(F.col("label").isNull(), F.col("copies"))).alias("__copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        F.count_if(~base).alias("n_texts"),
    )
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_texts")
