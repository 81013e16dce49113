"""Problem 1: records of evaluation splits that a training record shows too.

The keys of the evaluation rows (image digests, near-duplicate components) are put
into compressed full-text indexes (FM-index: Burrows-Wheeler transform with bit
vectors for rank), one per shard, and the keys of the training rows are streamed
through backward search. The indexed text holds the keys reversed, so a training
key is read from its first character on and the search yields at each step the
evaluation keys that begin with what was read, and those that end there: a
shortened digest on either side meets the digest it begins. The intervals of the
matches are merged by a difference array, which gives the training rows of each
evaluation key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from ..session import checkpoint
from .ids import SHORTEST_DIGEST, plain_component, plain_digest, plain_id, plain_split

#: Distinct keys per shard; an index and the keys streamed through it stay within some 50 MB.
KEYS_PER_SHARD = 60_000


class FmIndex:
    """FM-index over reversed, separated keys, for matches from the keys' first character on."""

    def __init__(self, keys: list[str]) -> None:
        text = np.frombuffer(("\0" + "".join(k[::-1] + "\0" for k in keys)).encode("latin-1"), np.uint8)
        self.alphabet, codes = np.unique(text, return_inverse=True)
        n, sigma = len(text), len(self.alphabet)
        self.code_of = np.full(256, -1, np.int64)
        self.code_of[self.alphabet] = np.arange(sigma)
        order = _suffix_array(codes.astype(np.int64))
        bwt = codes[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma))])
        words = n // 64 + 1
        self.bits = np.zeros((sigma, words), np.uint64)
        for c in range(sigma):
            packed = np.zeros(words * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bwt == c, bitorder="little")
            self.bits[c] = packed.view("<u8")
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.concatenate([np.zeros((sigma, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)[:, :words]
        self.key_at = (np.cumsum(text == 0) - 1)[order]
        self.n, self.keys = n, len(keys)

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Backward step: where the suffixes that follow symbol ``c`` begin, of those before ``i``."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        inside = np.bitwise_count(self.bits[c, word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.first[c] + self.before[c, word] + inside

    def match(self, patterns: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each indexed key: the weight of the patterns that equal it, begin it or are begun by it, and the longest span read."""
        cover, spans = np.zeros(self.n + 1, np.int64), np.zeros(self.keys, np.int64)
        ended = np.zeros(self.keys, np.int64)
        if not patterns or not self.keys:
            return ended, spans
        size = np.array([len(p) for p in patterns])
        chars = np.array([p.encode("latin-1", "replace") for p in patterns], dtype=f"S{size.max()}").view(np.uint8).reshape(len(patterns), -1)
        live = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.first[1], np.int64)
        for j in range(chars.shape[1]):
            live = live[size[live] > j]
            c = self.code_of[chars[live, j]]
            live, c = live[c > 0], c[c > 0]
            lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
            done = live[size[live] == j + 1]
            np.add.at(cover, lo[done], weights[done])
            np.add.at(cover, hi[done], -weights[done])
            more = live[size[live] > j + 1]
            zero = np.zeros(len(more), np.int64)
            a, b = self.step(zero, lo[more]), self.step(zero, hi[more])
            for p, x, y in zip(more[b > a], a[b > a], b[b > a]):  # an indexed key ends here: the pattern goes on
                # suffixes that start with the separator before a key bear the number of that key
                np.add.at(ended, self.key_at[x:y], weights[p])
                spans[self.key_at[x:y]] = np.maximum(spans[self.key_at[x:y]], j + 1)
            np.maximum.at(spans, self.key_at[lo[done]], j + 1)
            for x, y in zip(lo[wide := done[hi[done] - lo[done] > 1]], hi[wide]):
                spans[self.key_at[x:y]] = np.maximum(spans[self.key_at[x:y]], j + 1)
        covered = np.cumsum(cover)[: self.n]
        hit = np.nonzero(covered)[0]
        total = ended + np.bincount(self.key_at[hit], weights=covered[hit], minlength=self.keys)[: self.keys].astype(np.int64)
        return total, spans


def _suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling from eight symbols on."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length()) if n else 1
    start = max(1, min(8, 62 // bits))
    rank = np.zeros(n, np.int64)
    for k in range(start):
        rank = (rank << bits) | np.concatenate([codes[k:], np.zeros(min(k, n), np.int64)])[:n]
    h = start
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
        if h >= n or fresh[order[-1]] == n - 1:
            return order
        after = np.full(n, 0, np.int64)
        after[: n - h] = fresh[h:] + 1
        rank = fresh * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        h *= 2


def _shard_matches(pdf: pd.DataFrame) -> pd.DataFrame:
    held, train = pdf[pdf.n_eval > 0], pdf[pdf.n_train > 0]
    if held.empty or train.empty:
        return pd.DataFrame({"key": [], "n_eval": [], "train_rows": [], "span": []})
    rows, spans = FmIndex(held.key.tolist()).match(train.key.tolist(), train.n_train.to_numpy(np.int64))
    found = rows > 0
    return pd.DataFrame({"key": held.key.to_numpy()[found], "n_eval": held.n_eval.to_numpy()[found], "train_rows": rows[found], "span": spans[found] - 1})


def plain_rows(provenance: DataFrame) -> DataFrame:
    """id, split, source and the two keys (``d`` + digest, ``c`` + component) in plain spelling."""
    return provenance.select(
        plain_id(F.col("id")).alias("id"),
        plain_split(F.col("split")).alias("split"),
        F.col("source"),
        F.concat(F.lit("d"), plain_digest(F.col("source_image_sha256"))).alias("digest_key"),
        F.concat(F.lit("c"), plain_component(F.col("near_duplicate_component_id"))).alias("component_key"),
    )


def matched_keys(rows: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """Evaluation keys that a training key meets: key, n_eval, train_rows, span.

    Keys are counted once per split side before anything is shuffled, so a key that
    bears a third of the rows is one record. Shards go by the digits that even the
    shortest digest has; components by the whole value. The number of shards follows
    the number of rows.
    """
    pair = rows.filter(F.col("split").isin("train", "val", "dev")).select((F.col("split") == "train").alias("train"), F.explode(F.array("digest_key", "component_key")).alias("key")).filter("key IS NOT NULL")
    keys = pair.groupBy("key").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_eval"))
    shards = max(1, -(-rows.count() // keys_per_shard))
    route = F.when(F.col("key").startswith("d"), F.substring("key", 1, 1 + SHORTEST_DIGEST)).otherwise(F.col("key"))
    return keys.withColumn("shard", F.pmod(F.xxhash64(route), F.lit(shards))).groupBy("shard").applyInPandas(_shard_matches, "key string, n_eval long, train_rows long, span long")


def cross_split_overlap(provenance: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """One row per id of val or dev that shows a training image: id, split, source, overlap, train_rows, span.

    ``overlap`` is ``exact`` where a training row has the same digest (a shortened
    digest equals the one it begins), else ``near`` where one has the same component.
    ``split`` and ``source`` are the least of the id's matched rows, ``train_rows`` the
    number of training rows of its best match and ``span`` the digits it shares with them. Null, blank and stand-in keys match
    nothing; ids that are null and rows without a known split are left out; an empty
    table gives an empty result; further columns are ignored.
    """
    rows = plain_rows(provenance)
    found = checkpoint(matched_keys(rows, keys_per_shard))
    held = rows.filter(F.col("split").isin("val", "dev") & F.col("id").isNotNull()).select("id", "split", "source", F.explode(F.array("digest_key", "component_key")).alias("key")).filter("key IS NOT NULL").distinct()
    hits = salted_join(held, found, "key", hot_keys(found, "key", "n_eval"), F.col("id"))
    near = F.substring("key", 1, 1) == "c"
    best = hits.groupBy("id").agg(F.min(near).alias("near"), F.min("split").alias("split"), F.min("source").alias("source"), F.min(F.struct(near, -F.col("train_rows"), -F.col("span"))).alias("best"))
    return best.select("id", "split", "source", F.when(F.col("near"), "near").otherwise("exact").alias("overlap"), (-F.col("best.col2")).alias("train_rows"), (-F.col("best.col3")).alias("span"))


def overlap_report(provenance: DataFrame) -> DataFrame:
    """Evaluation ids and those that overlap with train, per split and source (null sources as their own group)."""
    held = plain_rows(provenance).filter(F.col("split").isin("val", "dev") & F.col("id").isNotNull()).groupBy("id").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    found = cross_split_overlap(provenance).select("id", "overlap")
    return held.join(found, "id", "left").groupBy("split", "source").agg(F.count("*").alias("ids"), F.count_if(F.col("overlap") == "exact").alias("exact_ids"), F.count_if(F.col("overlap") == "near").alias("near_ids"), F.avg(F.col("overlap").isNotNull().cast("double")).alias("overlap_rate"))
