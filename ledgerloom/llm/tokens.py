"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; the merges of a piece are done with a priority queue of merge ranks over a
doubly linked list of symbols, in which stale entries are skipped, so a piece of n bytes costs n log n however long it is.
Pieces repeat, so each worker keeps the ids of those it has met.

Defined results: null and empty texts have an empty list of ids. Special tokens are never produced: their names in a text
are ordinary text. Texts are taken whole. Repeated rows are encoded each; other columns stay as they are.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How byte-level vocabularies split a text; must equal the pattern the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces kept by a worker, and the longest that is kept.
KEPT, KEPT_LENGTH = 400_000, 64


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always the pair of lowest rank, the leftmost of equals, is merged next."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(parts[i] + parts[i + 1])
        if rank is not None:
            heap.append((rank, i, parts[i], parts[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or parts[i] is not left or parts[j] is not right:
            continue  # stale: one of the two symbols has been merged since
        parts[i] = left + right
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n:
                rank = ranks.get(parts[a] + parts[b])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, parts[a], parts[b]))
    return [ranks[parts[i]] for i in range(n) if alive[i]]


class ByteBPE:
    """Encoder and decoder of a vocabulary of ranks (lines of base64 token and rank)."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        kept = self.kept
        for piece in self.split(text):
            ids = kept.get(piece)
            if ids is None:
                ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
                if len(piece) <= KEPT_LENGTH:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        """The text: the concatenated strings of the vocabulary."""
        if not hasattr(self, "tokens"):
            self.tokens = {rank: token for token, rank in self.ranks.items()}
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


def load_vocabulary(path: str) -> ByteBPE:
    """The encoder of this process; executors without the file take the copy that the driver has sent."""
    import os

    held = sys.__dict__.setdefault("_ledgerloom_bpe", {})
    if path not in held:
        held[path] = ByteBPE(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return held[path]


def ship(spark, path: str) -> None:
    """Send the vocabulary to executors once."""
    spark.sparkContext.addFile(path)


def encode(df: DataFrame, text: str, vocabulary: str = DEFAULT_VOCABULARY, name: str = "ids") -> DataFrame:
    """Add ``name``, the list of ids of the column ``text``."""
    ship(df.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load_vocabulary(vocabulary)
        for batch in batches:
            yield batch.map(bpe.encode)

    return df.withColumn(name, ids(F.col(text)))


def count(df: DataFrame, text: str, vocabulary: str = DEFAULT_VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """Add ``name``, the number of ids of the column ``text``."""
    ship(df.sparkSession, vocabulary)

    @F.pandas_udf("bigint")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load_vocabulary(vocabulary)
        for batch in batches:
            yield batch.map(bpe.count)

    # Else a filter on the result would count every text a second time.
    return df.withColumn(name, size.asNondeterministic()(F.col(text)))


def decode(df: DataFrame, ids: str, vocabulary: str = DEFAULT_VOCABULARY, name: str = "text") -> DataFrame:
    """Add ``name``, the text of the ids; bytes that are no UTF-8 become replacement characters, a null list gives null."""
    ship(df.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load_vocabulary(vocabulary)
        for batch in batches:
            yield batch.map(lambda x: None if x is None else bpe.decode(list(x)))

    return df.withColumn(name, back(F.col(ids)))
