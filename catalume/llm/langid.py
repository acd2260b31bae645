"""Language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; learned transitions join the labels of neighbouring words, so
that code-switched text gets a label for each word. Word posteriors come from forward-backward; a document's language is
that with the largest sum of posteriors. The model is fitted on the driver from a bounded sample of labelled passages and
sent to the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, pack, small_batches

#: The sample, of passages: each text is cut into passages of SAMPLE_WORDS words; of each language so many documents, and of each of them so many passages, both from anywhere by hash. What has more characters is cut again, so that texts without spaces have passages too.
SAMPLE_DOCS, SAMPLE_PASSAGES, SAMPLE_WORDS, SAMPLE_CHARACTERS = 150, 4, 60, 2000
#: Languages that a model can have; with more values in lang, fitting is an error.
LANGUAGES = 1000
#: Parts of a language in which documents are ranked, one level after another, so that few meet in one task.
SALTS = (128, 32, 4, 1)
#: Features kept (the most frequent), lexicon words, rounds of training, step size, and the weight of the penalty.
FEATURES, LEXICON, ROUNDS, STEP, PENALTY = 20_000, 4_000, 20, 0.3, 1e-4
#: Passages that are joined to one training chain, so that transitions between languages are seen.
CHAIN = 6
#: Words of a block in the vectorised forward-backward; words that are scored at once and words that a worker remembers, with up to 4 labels: with more labels fewer, so that memory doesn't grow with their square.
BLOCK, BATCH, MEMO = 32, 200_000, 200_000
#: Letters of a word at most: a longer run of letters, as in scripts without spaces, is as many words.
LETTERS = 24
UNKNOWN = "und"
WORD = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}")


def words_of(text: str) -> list[str]:
    """Lower-cased words; numerals that the pattern takes for a word (such as a half) are none."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def batch_words(labels: int) -> int:
    """Words whose steps (labels x labels numbers each) are held at once."""
    return max(32 * BLOCK, BATCH * 16 // max(4, labels) ** 2)


def word_features(word: str) -> Iterator[str]:
    """Prefixes and suffixes of up to 3 characters, character 2-grams and 3-grams of the whole word, and the word itself as its lexicon entry."""
    w = f"<{word}>"
    yield from (f"p{w[:n]}" for n in (2, 3, 4))
    yield from (f"s{w[-n:]}" for n in (2, 3, 4))
    yield from (w[i : i + 2] for i in range(len(w) - 1))
    yield from (w[i : i + 3] for i in range(len(w) - 2))
    yield f"={word}"


def forward_backward(emission: np.ndarray, starts: np.ndarray, transition: np.ndarray, initial: np.ndarray, neighbours: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors (words x labels) of chains that stand one after another in ``emission`` (log scores), and of neighbours (words x labels before x labels here; of no use where a chain starts; only if ``neighbours``). ``starts`` marks the first word of each.

    The steps' matrices are multiplied in blocks of BLOCK words, all blocks at once; a scan over the blocks' products
    gives what enters each block from the left and right; then each block is filled in. A chain's first word has a
    matrix whose rows are all alike, so that nothing passes from one chain to the next. All products are scaled.
    """
    n, k = emission.shape
    size = -(-n // BLOCK) * BLOCK
    score = np.exp(emission - emission.max(axis=1, keepdims=True))
    step = np.exp(transition)[None] * score[:, None, :]
    step[starts] = (np.exp(initial) * score[starts])[:, None, :]
    pad = np.broadcast_to(np.eye(k), (size - n, k, k))
    step = np.concatenate([step, pad]).reshape(-1, BLOCK, k, k)
    blocks = len(step)
    scaled = lambda x, axes: x / x.sum(axis=axes, keepdims=True)
    product = np.broadcast_to(np.eye(k), (blocks, k, k))
    for i in range(BLOCK):
        product = scaled(product @ step[:, i], (1, 2))
    left = np.empty((blocks, k))
    right = np.empty((blocks, k))
    now = np.full(k, 1 / k)
    for b in range(blocks):
        left[b] = now
        now = now @ product[b]
        now = now / now.sum()
    now = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        right[b] = now
        now = product[b] @ now
        now = now / now.sum()
    forward = np.empty((blocks, BLOCK, k))
    for i in range(BLOCK):
        left = scaled(np.einsum("bi,bij->bj", left, step[:, i]), 1)
        forward[:, i] = left
    backward = np.empty((blocks, BLOCK, k))
    for i in range(BLOCK - 1, -1, -1):
        backward[:, i] = right
        right = scaled(np.einsum("bij,bj->bi", step[:, i], right), 1)
    forward, backward, step = (x.reshape(-1, *x.shape[2:])[:n] for x in (forward, backward, step))
    if not neighbours:
        return scaled(forward * backward, 1), None
    pairs = np.concatenate([np.ones((1, k)), forward[:-1]])[:, :, None] * step * backward[:, None, :]
    return scaled(forward * backward, 1), scaled(pairs, (1, 2))


class Model:
    """Labels, feature weights, transitions and initial scores, in plain types."""

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, transition: np.ndarray, initial: np.ndarray):
        self.labels, self.index, self.weights, self.transition, self.initial = labels, index, weights, transition, initial


def _feature_matrix(words: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word and feature numbers of all features that the words have."""
    get = index.get
    found = [[c for f in word_features(w) if (c := get(f)) is not None] for w in words]
    return np.repeat(np.arange(len(words)), [*map(len, found)]), np.array([c for row in found for c in row], np.int64)


def fit(lines: list[tuple[str, str]]) -> dict:
    """The model of labelled lines (text, language), by gradient steps with per-weight scaling on the chains' likelihood."""
    labels = sorted({lang for _, lang in lines})
    words: dict[str, int] = {}
    tokens, gold, starts = [], [], []
    for i, (text, lang) in enumerate(lines):
        found = words_of(text)
        starts += [i % CHAIN == 0 and j == 0 for j in range(len(found))]
        tokens += [words.setdefault(w, len(words)) for w in found]
        gold += [labels.index(lang)] * len(found)
    k = max(1, len(labels))
    model = {"labels": labels, "index": {}, "weights": np.zeros((1, k)), "transition": np.zeros((k, k)), "initial": np.zeros(k)}
    if not tokens:
        return model
    tokens, gold, starts = np.array(tokens), np.array(gold), np.array(starts)
    starts[0] = True
    seen = np.bincount(tokens)
    counts: Counter[str] = Counter()
    for w, i in words.items():
        for f in set(word_features(w)):
            counts[f] += int(seen[i])
    by_count = sorted(counts, key=lambda f: (-counts[f], f))
    kept = [f for f in by_count if f[0] != "="][:FEATURES] + [f for f in by_count if f[0] == "=" and counts[f] > 1][:LEXICON]
    index = {f: i for i, f in enumerate(kept)}
    rows, columns = _feature_matrix(list(words), index)
    added = lambda to, values, size: np.stack([np.bincount(to, v, size) for v in values.T], axis=1)  # noqa: E731  sums of the values' rows by number
    weights, transition, initial = np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)
    squares = [np.full_like(x, 1e-8) for x in (weights, transition, initial)]
    goal = np.eye(k)[gold]
    inner = np.flatnonzero(~starts)
    # whole chains are worked on together, as many as fit a batch
    firsts, cuts = np.flatnonzero(starts), [0]
    for a, b in zip(firsts, [*firsts[1:], len(tokens)]):
        if b - cuts[-1] > batch_words(k) and a > cuts[-1]:
            cuts.append(int(a))
    batches = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(tokens)])]
    seen_pairs = np.einsum("ni,nj->ij", goal[inner - 1], goal[inner])
    for _ in range(ROUNDS):
        scores = added(rows, weights[columns], len(words))
        post, on_pairs = np.empty_like(goal), seen_pairs.copy()
        for some in batches:
            post[some], pairs = forward_backward(scores[tokens[some]], starts[some], transition, initial)
            on_pairs -= pairs[~starts[some]].sum(axis=0)
        by_word = added(tokens, goal - post, len(words))
        gradient = added(columns, by_word[rows], len(index))
        on_first = (goal - post)[starts].sum(axis=0)
        for x, g, q in zip((weights, transition, initial), (gradient, on_pairs, on_first), squares):
            g = g / len(tokens) - PENALTY * x
            q += g * g
            x += STEP * g / np.sqrt(q)
    return model | {"index": index, "weights": weights, "transition": transition, "initial": initial}


class Labeller:
    """Labels texts with a model; scores of words are remembered."""

    def __init__(self, model: dict):
        self.model = model
        self.memo: dict[str, int] = model.setdefault("memo", {})
        k = max(1, len(model["labels"]))
        self.table = model.setdefault("table", np.zeros((max(BLOCK, MEMO * 4 // max(4, k)), k)))
        self.batch = batch_words(k)

    def scores(self, words: list[str]) -> np.ndarray:
        memo, most = self.memo, len(self.table)
        fresh = [*dict.fromkeys(w for w in words if w not in memo)]
        if len(memo) + len(fresh) > most:
            memo.clear()
            fresh = [*dict.fromkeys(words)]
            if len(fresh) > most:  # more new words than are remembered: score them in two halves
                half = len(words) // 2
                return np.concatenate([self.scores(words[:half]), self.scores(words[half:])])
        if fresh:
            start, (rows, columns) = len(memo), _feature_matrix(fresh, self.model["index"])
            for label, weights in enumerate(self.model["weights"].T):
                self.table[start : start + len(fresh), label] = np.bincount(rows, weights[columns], len(fresh))
            memo.update(zip(fresh, range(start, start + len(fresh))))
        return self.table[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))]

    def posteriors(self, chains: list[list[str]]) -> np.ndarray:
        words = [w for c in chains for w in c]
        starts = np.zeros(len(words), bool)
        starts[np.cumsum([0, *map(len, chains)])[:-1]] = True
        return forward_backward(self.scores(words), starts, self.model["transition"], self.model["initial"], neighbours=False)[0]

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors summed up by text, and the texts' numbers of words. Chains of up to a batch's words are worked on at once; a longer text goes in several chains, each of which begins as a text does: only the posteriors of the words next to such a cut can differ from those of one chain."""
        total, n = np.zeros((len(texts), max(1, len(self.model["labels"])))), np.zeros(len(texts), np.int64)
        chains: list[list[str]] = []
        owners: list[int] = []

        def flush():
            if chains:
                lengths = list(map(len, chains))
                np.add.at(total, np.repeat(owners, lengths), self.posteriors(chains))
                np.add.at(n, owners, lengths)
                chains.clear()
                owners.clear()

        waiting = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            for j in range(0, len(words), self.batch):
                chains.append(words[j : j + self.batch])
                owners.append(i)
                waiting += len(chains[-1])
                if waiting >= self.batch:
                    flush()
                    waiting = 0
        flush()
        return total, n


def held_out(doc_id):
    """Whether a document stays out of the training: crc32 of its id as text, modulo 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def passages(text, words: int = SAMPLE_WORDS):
    """An array of the passages of a text: ``words`` words or SAMPLE_CHARACTERS characters each, whichever is less, without those that have no letter."""
    every = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    cut = lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / words).cast("int")), lambda i: F.array_join(F.slice(ws, i * words + 1, words), " "))
    made = let(every, lambda ws: F.when(F.size(ws) > 0, cut(ws)))
    short = F.flatten(F.transform(made, lambda p: F.regexp_extract_all(p, F.lit(rf"(?s).{{1,{SAMPLE_CHARACTERS}}}"), F.lit(0))))
    return F.filter(short, lambda p: F.regexp_like(p, F.lit(r"\p{L}")))


def train(docs: DataFrame, docs_a_language: int = SAMPLE_DOCS, passages_a_doc: int = SAMPLE_PASSAGES) -> dict:
    """The model of the documents (doc_id, text, lang) that are not held out and have a language and text.

    The sample is bounded: of each language the ``docs_a_language`` documents with the smallest hashes, of each of these the
    ``passages_a_doc`` passages with the smallest hashes, wherever they stand in it. Passages come in the order of their
    hashes, which mixes languages. An empty sample gives a model without labels, which finds every text unknown; more than
    LANGUAGES languages are an error. Only narrow rows are ranked; then the sampled texts alone are read.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("lang", "text", F.xxhash64("doc_id").alias("__hash"))
    first = rows.select("lang", "__hash")
    for salts in SALTS:
        order = Window.partitionBy("lang", F.pmod(F.xxhash64("__hash"), F.lit(salts))).orderBy("__hash")
        first = first.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= docs_a_language).drop("__rank")
    cuts = first.groupBy("lang").agg(F.max("__hash")).limit(LANGUAGES + 1).collect()  # a row a language
    if len(cuts) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    if not cuts:
        return fit([])
    cut = F.create_map(*(F.lit(x) for r in cuts for x in r))[F.col("lang")]
    hashed = F.transform(passages(F.col("text")), lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("passage")))
    few = rows.where(F.col("__hash") <= cut).select("lang", F.explode(F.slice(F.sort_array(hashed), 1, passages_a_doc)).alias("x"))
    sample = few.select("x.h", "x.passage", "lang").collect()  # docs_a_language * passages_a_doc rows a language, but for rows that repeat a doc_id
    return fit([(r["passage"], r["lang"]) for r in sorted(sample, key=lambda r: (r["h"], r["lang"], r["passage"]))])


def label_documents(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score: the language with the most word posterior and its share (0 to 1); `und` and 0 for a null text, one without letters, or a model without languages. Whole texts are labelled; other columns stay, those two are replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: FEATURES and LEXICON weights a language

    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        labels = shared.value["labels"]
        for s in texts:
            total, n = labeller.sums([t or "" for t in s])
            best = total.argmax(axis=1)
            known = (n > 0) & bool(labels)
            share = total[np.arange(len(best)), best] / np.maximum(n, 1)
            yield pd.DataFrame({"lang_pred": [labels[b] if k else UNKNOWN for b, k in zip(best, known)], "score": np.where(known, np.clip(share, 0, 1), 0.0)})

    udf = F.pandas_udf(label, "lang_pred string, score double").asNondeterministic()
    out = pack(docs, label=udf(F.col(f"`{text}`")))
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in ("lang_pred", "score")), "label.lang_pred", "label.score")


def op7_langid(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model of the documents that are not held out."""
    model = train(docs.select("doc_id", "text", "lang"))
    return label_documents(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
