"""Problem 8: encoding with a public byte-level BPE.

A text is cut into words by the tokenizer's pattern; within a word a priority queue
of merge ranks works over a doubly linked list of symbols and skips entries that
earlier merges made stale. Decoding joins the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rank file of byte_bpe_50k; another byte-level rank file may be given instead.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the tokenizer's pattern for words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker keeps; beyond that it starts anew.
CACHED_WORDS = 100_000
#: Longer words are encoded each time they come.
CACHED_LENGTH = 64


class ByteBpe:
    """Byte-level BPE of a rank file's content (lines of base64 token and rank)."""

    def __init__(self, ranks: bytes) -> None:
        import regex

        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.words = regex.compile(PATTERN).findall
        self._cache: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts give an empty list."""
        out: list[int] = []
        if not text:
            return out
        cache = self._cache
        for word in self.words(text):
            found = cache.get(word)
            if found is None:
                found = tuple(self._merge(word.encode("utf-8", "replace")))
                if len(word) <= CACHED_LENGTH:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = found
            out.extend(found)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")

    def _merge(self, word: bytes) -> list[int]:
        ids, n = self.ids, len(word)
        symbol: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, 2) for i in range(n - 1) if (r := ids.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            left, j = symbol[i], after[i]
            if left is None or j >= n or len(left) + len(symbol[j]) != size:
                continue  # stale: one of the two was merged since
            symbol[i] = left = left + symbol[j]
            symbol[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ids.get(left + symbol[k])) is not None:
                    heapq.heappush(queue, (r, i, size + len(symbol[k])))
            if (h := before[i]) >= 0 and (r := ids.get(symbol[h] + left)) is not None:
                heapq.heappush(queue, (r, h, len(symbol[h]) + size))
        return [ids[s] for s in symbol if s is not None]


@lru_cache(2)
def _of(ranks: bytes) -> ByteBpe:
    return ByteBpe(ranks)


def load(path: str = RANKS) -> ByteBpe:
    with open(path, "rb") as f:
        return _of(f.read())


def _shared(df: DataFrame, path: str):
    """The rank file's content for all executors; a vocabulary, so of fixed size."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(documents: DataFrame, key: str = "doc_id", path: str = RANKS) -> DataFrame:
    """One row (key, ids) per row: the token ids of ``text``.

    Whole texts are encoded, however long; strings that look like special tokens are
    ordinary text; null and empty texts give an empty list; nulls in the key are
    kept. The plan is a scan of two columns and one map without a shuffle.
    """
    ranks = _shared(documents, path)
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(ranks.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [np.asarray(bpe.encode(t), np.int32) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.array([], np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return documents.select(key, "text").mapInArrow(run, schema)


def count_tokens(documents: DataFrame, key: str = "doc_id", path: str = RANKS) -> DataFrame:
    """One row (key, tokens) per row: the number of token ids of ``text``; null and empty texts have none."""
    ranks = _shared(documents, path)
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("tokens", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(ranks.value)
        for b in batches:
            sizes = [len(bpe.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32())], names=[key, "tokens"])

    return documents.select(key, "text").mapInArrow(run, schema)
