"""Byte-level BPE encoding and decoding by forced-boundary splitting.

Two bytes that stand side by side inside no token of the vocabulary can never end up in one token, so the place between
them is a certain cut: what lies left and right of it is merged independently. Each pre-token is cut at those places, the
fragments are encoded one by one (equal fragments once, through a bounded memo) and the ids are concatenated. The same
table shows that no token has a white-space byte after another byte, so that a text may also be cut before white space;
long texts are streamed in such pieces and never tokenised as a whole.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Fixed value: the split pattern of byte-level BPE, which the vocabulary was made with.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after which a long text is cut at the next certain place.
PIECE = 1 << 16
#: Words that a worker remembers; beyond it the memo starts anew.
MEMO = 300_000
#: Bytes up to which a fragment is merged by plain search, and what stands for a pair without a merge.
SHORT, NEVER = 40, 1 << 60
#: A merge is its rank, times 2 ** 32, and the id that it makes.
ID = (1 << 32) - 1


def printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: visible Latin-1 as itself, the rest from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary_tables(raw: bytes) -> dict:
    """The tables that encoding and decoding need, from a vocabulary file (the JSON of a byte-level BPE tokenizer), in plain types."""
    spec = json.loads(raw)
    code = printable_bytes()
    as_bytes = lambda token: bytes(code[c] for c in token)
    ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
    special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    tokens: list[bytes | None] = [None] * (1 + max([*ids.values(), *special.values()]))
    for t, i in ids.items():
        tokens[i] = t
    for s, i in special.items():
        tokens[i] = s.encode()
    pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
    merges = {}
    for rank, (a, b) in enumerate(pairs):
        x, y = as_bytes(a), as_bytes(b)
        merges[ids[x] << 32 | ids[y]] = rank << 32 | ids[x + y]
    joins: list[set[int]] = [set() for _ in range(256)]  # for each byte, those that follow it inside some token
    for t in ids:
        for a, b in zip(t, t[1:]):
            joins[a].add(b)
    return {"tokens": tokens, "special": special, "merges": merges, "joins": joins, "bytes": [ids.get(bytes([b])) for b in range(256)], "memo": {}}


class Codec:
    """Encoder and decoder over the tables of a vocabulary. Encoded words are remembered in ``tables["memo"]``."""

    def __init__(self, tables: dict):
        self.tokens, self.special, self.merges, self.joins, self.byte_ids = (tables[k] for k in ("tokens", "special", "merges", "joins", "bytes"))
        self.memo = tables["memo"]
        self.pattern = regex.compile(PRE_TOKEN)
        self.cut = regex.compile(r"(?<=\S)(?=[ \n])")
        self.cut_after = frozenset(b for b in range(256) if not self.joins[b] & {32, 10})
        self.around_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def fragments(self, piece: bytes) -> Iterator[bytes]:
        """The piece, cut between all bytes that no token holds side by side."""
        start = 0
        for i in range(1, len(piece)):
            if piece[i] not in self.joins[piece[i - 1]]:
                yield piece[start:i]
                start = i
        yield piece[start:]

    def merge(self, fragment: bytes) -> list[int]:
        """Merges of one fragment, lowest rank first and leftmost among equals."""
        ids = [self.byte_ids[b] for b in fragment]
        if len(ids) > SHORT:
            return self.merge_long(ids)
        find = self.merges.get
        found = [find(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != NEVER:
            i = found.index(best)
            ids[i : i + 2] = [best & ID]
            del found[i]
            if i < len(found):
                found[i] = find(ids[i] << 32 | ids[i + 1], NEVER)
            if i:
                found[i - 1] = find(ids[i - 1] << 32 | ids[i], NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of merges and a linked list of ids, for fragments of any length."""
        merges, after, before = self.merges, [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(merges[p], i, p) for i, p in enumerate(a << 32 | b for a, b in zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] < 0 or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], ids[j] = merges[pair] & ID, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := ids[a] << 32 | ids[b]) in merges:
                    heapq.heappush(heap, (merges[p], a, p))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> bytes:
        found = self.memo.get(word)
        if found is None:
            ids = [x for f in self.fragments(word.encode("utf-8", "surrogatepass")) for x in self.merge(f)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = found
        return found

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about PIECE characters, each cut before white space that follows other characters, where no token joins them."""
        start, at = 0, PIECE
        while len(text) - start > 2 * PIECE and (m := self.cut.search(text, at)):
            at = m.start()
            if text[at - 1 : at].encode("utf-8", "surrogatepass")[-1] in self.cut_after:
                yield text[start:at]
                start, at = at, at + PIECE
            else:
                at += 1
        yield text[start:] if start else text

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = []
        for section in self.around_special.split(text) if self.around_special else [text]:
            if section in self.special:
                parts.append(np.array([self.special[section]], "<u4").tobytes())
                continue
            for piece in self.pieces(section):
                parts += map(self.encode_word, self.pattern.findall(piece))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _codec_udfs(spark: SparkSession, vocabulary: str):
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        tables = spark.sparkContext.broadcast(vocabulary_tables(f.read()))  # one vocabulary: its size does not follow the data

    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(tables.value)
        for s in texts:
            yield pd.Series([codec.encode(t or "") for t in s])

    def decode(packed: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(tables.value)
        for s in packed:
            yield pd.Series([None if b is None else codec.decode(b) for b in s])

    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(tables.value)
        for s in texts:
            packed = [codec.encode(t or "") for t in s]
            yield pd.DataFrame({"ids": packed, "decoded": [codec.decode(b) for b in packed]})

    # not deterministic: keeps the optimizer from encoding a text once for each use of its ids
    made = ((encode, T.BinaryType()), (decode, T.StringType()), (both, "ids binary, decoded string"))
    return [F.pandas_udf(f, kind).asNondeterministic() for f, kind in made]


def encode_documents(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with its texts' token ids in the binary column ``ids`` (little-endian unsigned 32-bit integers).

    A null or empty text has no ids (an empty value, not null). Special tokens' strings become their ids. Rows are encoded
    where they are read, without a shuffle; repeated rows give equal ids. Other columns stay; one named as ``ids`` is replaced.
    """
    encode, _, _ = _codec_udfs(df.sparkSession, vocabulary)
    return df.withColumn(ids, encode(F.col(f"`{text}`")))


def decode_documents(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the texts of its token ids in ``decoded``, special tokens included. Null ids give null; none give an empty text. An id that the vocabulary lacks is an error."""
    _, decode, _ = _codec_udfs(df.sparkSession, vocabulary)
    return df.withColumn(decoded, decode(F.col(f"`{ids}`")))


def code_documents(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with its texts' token ids and what these decode to: `encode_documents` and then `decode_documents` in one Python process a task, with one vocabulary and one queue of waiting rows, where the two in turn take two of each."""
    *_, both = _codec_udfs(df.sparkSession, vocabulary)
    coded = df.withColumn(ids, both(F.col(f"`{text}`")))
    return coded.withColumns({decoded: F.col(f"`{ids}`.decoded"), ids: F.col(f"`{ids}`.ids")})


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def op3_bpe(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = code_documents(docs.select("doc_id", "text"), vocabulary)
    return coded.select(
        "doc_id",
        n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
