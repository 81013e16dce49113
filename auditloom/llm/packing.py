"""Problem 9: filling containers of fixed capacity by best-two-fit.

A bin is filled greedily with the largest item that still fits; then its smallest
item is replaced by two unpacked ones that fill the widened gap more tightly. Items
are dealt by hash to groups of bounded size that are packed on their own; the items
of bins that stayed loose are dealt anew and packed once more.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Items that one task packs together.
ITEMS_PER_GROUP = 20_000
#: Bins filled to a smaller share are packed a second time.
LOOSE = 0.97


class _Pool:
    """Unpacked items by size; a bit set of the sizes that are left finds the largest that fits."""

    def __init__(self, sizes: list[int]) -> None:
        self.of: dict[int, list[int]] = defaultdict(list)
        self.bits = 0
        for i, s in enumerate(sizes):
            self.put(s, i)

    def put(self, size: int, item: int) -> None:
        self.of[size].append(item)
        self.bits |= 1 << size

    def take(self, size: int) -> int:
        held = self.of[size]
        item = held.pop()
        if not held:
            self.bits &= ~(1 << size)
        return item

    def largest(self, most: int) -> int:
        """The largest size up to ``most``; 0 if there is none."""
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.bits else 0

    def best_two(self, most: int, least: int) -> tuple[int, int] | None:
        """Two sizes that add up to at most ``most``, as much as possible and more than ``least``."""
        best, a = None, self.largest(most - 1)
        while a > 0 and 2 * a > least:
            b = self.largest(min(a, most - a))
            if b == a and len(self.of[a]) < 2:
                b = self.largest(a - 1)
            if b > 0 and a + b > least:
                least, best = a + b, (a, b)
                if least == most:
                    break
            a = self.largest(a - 1)
        return best


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; sizes lie between 1 and ``capacity``; each item is in one bin."""
    pool, bins = _Pool(sizes), []
    while (size := pool.largest(capacity)) > 0:
        gap, held = capacity, []
        while size > 0:
            held.append(pool.take(size))
            gap -= size
            size = pool.largest(gap)
        if gap and len(held) > 1:
            small = sizes[held[-1]]
            if two := pool.best_two(gap + small, small):
                pool.put(small, held.pop())
                held += [pool.take(two[0]), pool.take(two[1])]
        bins.append(held)
    return bins


def _pack(round_: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, group, capacity = key
        pdf = pdf.sort_values(["size", "doc_id", "piece"], kind="stable", ignore_index=True)
        empty = int((pdf["size"] == 0).sum())
        sizes = pdf["size"].tolist()[empty:]
        bins = best_two_fit(sizes, int(capacity)) or [[]]
        at, fill = [0] * len(pdf), [0] * len(pdf)
        for number, held in enumerate(bins):
            total = sum(sizes[i] for i in held)
            for i in held:
                at[empty + i], fill[empty + i] = number, total
        for i in range(empty):
            fill[i] = sum(sizes[j] for j in bins[0])
        return pdf.assign(container_id=[f"{kind}/{round_}/{group}/{n}" for n in at], fill=fill)[["container_kind", "capacity_tokens", "doc_id", "piece", "start_token", "size", "container_id", "fill"]]

    return run


_SCHEMA = "container_kind string, capacity_tokens int, doc_id long, piece int, start_token int, size int, container_id string, fill int"


def pack(sizes: DataFrame, specs: DataFrame, items_per_group: int = ITEMS_PER_GROUP) -> DataFrame:
    """One row per piece: container_kind, capacity_tokens, container_id, doc_id, piece, start_token, tokens.

    ``sizes`` has doc_id and tokens, ``specs`` container_kind and capacity_tokens (a
    fixed handful). A document above the capacity is cut into full pieces, each a
    container of its own, and a rest; no other is split. Documents without tokens
    take no room and lie in a group's first container; null sizes count as none.
    Containers are the same in every run over the same rows. No documents or no
    specs give no rows; specs of no capacity are ignored.
    """
    kinds = specs.filter("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity_tokens")).distinct().orderBy("container_kind", "capacity_tokens").collect()
    if not kinds:
        return sizes.sparkSession.createDataFrame([], "container_kind string, capacity_tokens int, container_id string, doc_id long, piece int, start_token int, tokens int")
    sizes = checkpoint(sizes.select("doc_id", "tokens"))  # texts are encoded once
    cap, tokens = F.col("capacity_tokens"), F.coalesce(F.col("tokens"), F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(k["container_kind"]).alias("container_kind"), F.lit(k["capacity_tokens"]).alias("capacity_tokens")) for k in kinds]))
    pieces = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.cast("int").alias("tokens"), each.alias("k")).select("doc_id", "tokens", "k.*")
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / cap).cast("int") - 1, F.lit(0)))))
    pieces = pieces.select("container_kind", "capacity_tokens", "doc_id", "piece", (F.col("piece") * cap).alias("start_token"), F.least(cap, F.col("tokens") - F.col("piece") * cap).alias("size"))
    full = pieces.filter("size = capacity_tokens").withColumn("container_id", F.concat_ws("/", "container_kind", F.lit("full"), "doc_id", "piece")).withColumn("fill", F.col("size"))
    groups = max(1, -(-sizes.count() // items_per_group))

    def deal(df: DataFrame, n: int, round_: int) -> DataFrame:
        dealt = df.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_)), F.lit(n)))
        return dealt.groupBy("container_kind", "group", "capacity_tokens").applyInPandas(_pack(round_), _SCHEMA)

    first = checkpoint(deal(pieces.filter("size < capacity_tokens").select(*[c for c in pieces.columns]), groups, 1))
    loose = first.filter(F.col("fill") < LOOSE * F.col("capacity_tokens"))
    n = loose.count()
    second = deal(loose.drop("container_id", "fill"), max(1, -(-n // items_per_group)), 2)
    packed = first.filter(F.col("fill") >= LOOSE * F.col("capacity_tokens")).unionByName(second).unionByName(full)
    return packed.select("container_kind", "capacity_tokens", "container_id", "doc_id", "piece", "start_token", F.col("size").alias("tokens"))


def packing_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, tokens held, the least possible number of containers, and the share of room in use."""
    cap = F.max("capacity_tokens")
    return packed.groupBy("container_kind").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"), F.ceil(F.sum("tokens") / cap).alias("least_containers"), (F.sum("tokens") / (F.count_distinct("container_id") * cap)).alias("used_share"))
