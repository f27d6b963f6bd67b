"""Token ids of whole texts by a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's own pattern. Within a piece the pair of lowest rank, leftmost
first, is merged until no adjacent pair has a rank. The pairs stand in a segment tree whose root names the
next merge; a merge changes three leaves, so a piece of n bytes costs O(n log n) however long it is. Most
pieces of a corpus repeat, so a worker remembers the ids of short ones.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splitting pattern of the byte-level vocabulary (fixed by it): contractions, letters, digits, other marks, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces remembered by a worker, and the longest that is worth it.
CACHE, CACHED_BYTES = 1 << 17, 64


def parse_ranks(text: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one base64 token and its rank for each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in text.splitlines() if line.strip())}


class PairTree:
    """Segment tree over the ranks of adjacent pairs; the root is the lowest rank, leftmost among equals."""

    def __init__(self, keys: list[int], none: int) -> None:
        self.size = 1 << max(0, (len(keys) - 1).bit_length())
        self.none = none
        self.nodes = [none] * self.size + keys + [none] * (self.size - len(keys))
        for k in range(self.size - 1, 0, -1):
            self.nodes[k] = min(self.nodes[2 * k], self.nodes[2 * k + 1])

    def root(self) -> int:
        return self.nodes[1]

    def put(self, at: int, key: int) -> None:
        nodes, k = self.nodes, at + self.size
        nodes[k] = key
        while k > 1:
            k >>= 1
            low = min(nodes[2 * k], nodes[2 * k + 1])
            if nodes[k] == low:
                break
            nodes[k] = low


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    none = (1 << 62)
    parts: list[bytes | None] = [piece[k : k + 1] for k in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(at: int) -> int:
        """Rank and place of the pair that begins here, in one number."""
        other = after[at]
        if other >= n:
            return none
        rank = ranks.get(parts[at] + parts[other])
        return none if rank is None else rank * n + at

    tree = PairTree([key(k) for k in range(n)], none)
    while (low := tree.root()) != none:
        at = low % n
        other = after[at]
        parts[at] += parts[other]
        parts[other] = None
        after[at] = after[other]
        if after[at] < n:
            before[after[at]] = at
        tree.put(other, none)
        tree.put(at, key(at))
        if before[at] >= 0:
            tree.put(before[at], key(before[at]))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without special tokens."""
        out: list[int] = []
        known, ranks = self.known, self.ranks
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                ids = merge_piece(raw, ranks)
                if len(raw) <= CACHED_BYTES:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    with open(path, "rb") as file:
        return Encoder(parse_ranks(file.read()))


def _encoders(spark: SparkSession, vocabulary: str) -> Callable[[], Encoder]:
    """How a worker gets its encoder: from the path if it can read it, else from the copy that the driver shipped."""
    name = os.path.basename(vocabulary)
    shipped = getattr(spark.sparkContext, "_lumenloom_vocabularies", set())
    if os.path.exists(vocabulary) and vocabulary not in shipped:
        spark.sparkContext.addFile(vocabulary)  # a vocabulary is a few megabytes, sent once for each executor
        spark.sparkContext._lumenloom_vocabularies = shipped | {vocabulary}
    return lambda: _encoder(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(name))


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, ids) for every row of documents; an empty and a null text give an empty list.

    Repeated rows each keep a row. vocabulary is a path on the driver, or one that every executor can read. No
    shuffle.
    """
    encoder = _encoders(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder().encode
        for batch in batches:
            ids = [encode(t) if isinstance(t, str) and t else [] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        run, "doc_id long, ids array<int>"
    )


def token_counts(documents: DataFrame, by: str = "source", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents, tokens and longest document for each source: counted where the text is read, one row for each batch and source is shuffled."""
    encoder = _encoders(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder().encode
        for batch in batches:
            sizes = pd.DataFrame({"k": batch["k"], "n": [len(encode(t)) if isinstance(t, str) and t else 0 for t in batch["text"]]})
            yield sizes.groupby("k")["n"].agg(documents="count", tokens="sum", longest="max").reset_index()

    rows = documents.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("k"), F.col(text_col).cast("string").alias("text"))
    parts = rows.mapInPandas(run, "k string, documents long, tokens long, longest long")
    return parts.groupBy(F.col("k").alias(by)).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.max("longest").cast("int").alias("longest"))
