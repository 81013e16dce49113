"""Set operations, connected components and exact assignment."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, stable_key
from ..session import checkpoint
from .rank import running_before
from .skew import hot_keys, salted_join


#: Nodes that one union-find holds before it hands out its forest and starts anew.
NODES_PER_FOREST = 400_000
#: Forests of at most so many rows are merged in one task.
EDGES_PER_PARTITION = 400_000


def forests(limit: int, kind: str = "string"):
    """A map over batches of edges (two columns) that gives a spanning forest of its partition: (node, root), roots least.

    At ``limit`` nodes a forest is handed out and a new one begun, so memory is bounded.
    """
    whole = kind in ("int", "bigint", "smallint", "tinyint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[str, str] = {}

        def find(x: str) -> str:
            root = x
            while (up := parent[root]) != root:
                root = up
            while (up := parent[x]) != root:
                parent[x], x = root, up
            return root

        def forest() -> pd.DataFrame:
            found = pd.DataFrame({"node": list(parent), "root": [find(x) for x in parent]})
            return found.astype("int64") if whole else found

        for pdf in batches:
            for a, b in pdf.drop_duplicates().itertuples(index=False):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                x, y = find(a), find(b)
                if x < y:
                    parent[y] = x
                elif y < x:
                    parent[x] = y
            if len(parent) >= limit:
                yield forest()
                parent.clear()
        if parent:
            yield forest()

    return run


def components(edges: DataFrame, max_rounds: int = 60, edges_per_partition: int = EDGES_PER_PARTITION) -> DataFrame:
    """(node, component): components of an edge table (a, b), named by their least node.

    Each partition first keeps a spanning forest of its edges. If the forests together
    have at most ``edges_per_partition`` rows they are merged in one task; else rounds
    of large-star (a node's greater neighbours go to its least one) and small-star
    (its lesser neighbours and itself do) end in one star per component, after a
    number of rounds that grows as the squared logarithm of the size. A node that
    bears a large part of the edges is spread over tasks. A self edge names a lone node.
    """
    kind = edges.schema["a"].dataType.simpleString()
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", F.col("b").cast(kind))
    forest = checkpoint(e.mapInPandas(forests(NODES_PER_FOREST, kind), f"node {kind}, root {kind}"))
    if forest.count() <= edges_per_partition:
        return checkpoint(forest.coalesce(1).mapInPandas(forests(2**62, kind), f"node {kind}, root {kind}").toDF("node", "component"))
    state = checkpoint(forest.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    sign = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"))
    before = state.agg(*sign).first()
    for _ in range(max_rounds):
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = salted_join(both, least.select("a", "m"), "a", hot_keys(least, "a", "n", 2 * before["n"]), F.col("b")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpoint(large)
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        sent = salted_join(large, lower.select("a", "m"), "a", hot_keys(lower, "a", "n", before["n"]), F.col("b")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = checkpoint(sent.union(lower.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = state.agg(*sign).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not stable after {max_rounds} rounds")
    grown = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component"))
    lone = forest.filter("node = root").select("node", F.col("root").alias("component")).join(grown.select("node"), "node", "left_anti")
    return grown.union(roots.union(lone).distinct())


def component_digest(members: DataFrame) -> DataFrame:
    """(component, component_id, size): the first 24 digits of the digest of the sorted members, one per line.

    Members of one component are joined in one row; use it on bounded components.
    """
    return members.groupBy("component").agg(F.substring(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set("node"))).cast("binary"), 256), 1, 24).alias("component_id"), F.count_distinct("node").alias("size"))


def union_shuffled(parts: dict[str, DataFrame], key: str, seed: str) -> DataFrame:
    """Union of sources with their name, and ``place``: the order by hash within a split."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("place_key", stable_key(seed, F.col(key).cast("string")))


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of one side only: key, side."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("extra")))


def pairwise_overlap(df: DataFrame, value: str, group: str, groups: list[str]) -> DataFrame:
    """(left, right, shared) for every pair of the named groups: how many values both hold, 0 included."""
    held = df.filter(F.col(group).isin(groups) & F.col(value).isNotNull()).groupBy(value).agg(F.array_sort(F.collect_set(group)).alias("g"))
    pairs = [(a, b) for i, a in enumerate(sorted(groups)) for b in sorted(groups)[i + 1 :]]
    counted = held.agg(*[F.count_if(F.array_contains("g", a) & F.array_contains("g", b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"p{i}").alias("shared")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def absent_class(classes: list[int], present: Column, key: Column) -> Column:
    """A class that is not present, picked by hash of the key; null if all are."""
    left = F.array_except(F.array(*map(F.lit, classes)), present)
    at = (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 15), 16, 10).cast("long") % F.greatest(F.size(left), F.lit(1))).cast("int")
    return F.when(F.size(left) > 0, F.get(left, at))


def dedup_by_content(df: DataFrame, digest: str, order: list[str], prior: DataFrame | None = None) -> DataFrame:
    """``df`` with ``dropped_as``: prior_content for digests seen before, exact_content_duplicate for repeats, else null.

    The row that comes first in ``order`` (unique within a digest) is kept; null digests
    are never repeats. The first place per digest is found before the shuffle and
    joined back, with hot digests spread over tasks.
    """
    place = F.struct(*order)
    first = checkpoint(df.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(place).alias("_first"), F.count("*").alias("_n")))
    out = salted_join(df, first.select(digest, "_first"), digest, hot_keys(first, digest, "_n"), F.col(order[0]), "left").withColumn("_p", F.when(place == F.col("_first"), 1).otherwise(2)).drop("_first")
    known = F.lit(False)
    if prior is not None:
        out = out.join(prior.select(F.col(prior.columns[0]).alias("_k")).filter("_k IS NOT NULL").distinct(), F.col(digest) == F.col("_k"), "left")
        known = F.col("_k").isNotNull()
    reason = F.when(known, "prior_content").when(F.col(digest).isNotNull() & (F.col("_p") > 1), "exact_content_duplicate")
    return out.withColumn("dropped_as", reason).drop("_p", "_k")


def repaired(df: DataFrame, key: str, changes: DataFrame, column: str, only: Column) -> DataFrame:
    """``df`` with ``column`` replaced where ``only`` holds and ``changes`` (key, column) has a value; nothing else changes."""
    new = changes.select(key, F.col(column).alias("_new")).dropDuplicates([key])
    return df.join(new, key, "left").withColumn(column, F.when(only & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(column))).drop("_new")


class _Flow:
    """Maximum flow by levels and blocking paths, on small graphs."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, room: int) -> int:
        self.to += [b, a]
        self.room += [room, 0]
        self.out[a].append(len(self.to) - 2)
        self.out[b].append(len(self.to) - 1)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            level = [-1] * len(self.out)
            level[s], queue = 0, deque([s])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if level[t] < 0:
                return total
            at = [0] * len(self.out)
            while True:
                path, a = [], s
                while a != t:
                    while at[a] < len(self.out[a]) and not (self.room[e := self.out[a][at[a]]] and level[self.to[e]] == level[a] + 1):
                        at[a] += 1
                    if at[a] < len(self.out[a]):
                        path.append(self.out[a][at[a]])
                        a = self.to[path[-1]]
                    elif path:
                        a = self.to[path.pop() ^ 1]
                        at[a] += 1
                    else:
                        break
                if a != t:
                    break
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                total += push


def _flows(key: tuple, pdf: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """One stratum's flow from sets of shown classes (with their number of families) to the classes in demand."""
    want = pdf[pdf.shown.isna()]
    demand = dict(zip(want["class"].astype(int), want["n"].astype(int)))
    have = pdf[pdf.shown.notna()].sort_values("shown")
    groups = [(text, {int(c) for c in text.split(",")}, int(n)) for text, n in zip(have.shown, have["n"])]
    classes = sorted(demand)
    flow, edges = _Flow(2 + len(groups) + len(classes)), {}
    for i, (_, shown, n) in enumerate(groups):
        flow.add(0, 2 + i, n)
        for j, c in enumerate(classes):
            if c not in shown:
                edges[i, j] = flow.add(2 + i, 2 + len(groups) + j, n)
    for j, c in enumerate(classes):
        flow.add(2 + len(groups) + j, 1, demand[c])
    total = sum(demand.values())
    reached = flow.run(0, 1)
    if reached < total:
        return pd.DataFrame([(*key, None, None, None, total - reached)], columns=names)
    rows = []
    for i, (text, _, _) in enumerate(groups):
        upto = 0
        for j, c in enumerate(classes):
            if (i, j) in edges and (n := flow.room[edges[i, j] ^ 1]):
                upto += n
                rows.append((*key, text, c, upto, 0))
    return pd.DataFrame(rows, columns=names)


def exact_absent_assignment(df: DataFrame, strata: list[str]) -> DataFrame:
    """(strata, family, absent_class, status, deficit): each family gets a class it does not show, and every class as often as it is positive.

    ``df`` has the strata, family (string), positive (int) and present (array of int);
    strata must not be null. Families that show the same classes are one node with a
    count, so a stratum's maximum flow is over sets and classes, whatever its number
    of families; the families then take their classes by rank within their set. Where
    no exact assignment exists the stratum gives one row ``infeasible`` with the number
    of families left, never a part of an assignment.
    """
    kinds = ", ".join(f"{s} {df.schema[s].dataType.simpleString()}" for s in strata)
    names = [*strata, "shown", "class", "upto", "deficit"]
    none = F.array().cast("array<int>")
    shown = F.array_join(F.array_sort(F.array_distinct(F.concat(F.filter(F.coalesce("present", none), lambda c: c.isNotNull()), F.array("positive")))).cast("array<string>"), ",")
    ready = df.filter("family IS NOT NULL AND positive IS NOT NULL").dropDuplicates([*strata, "family"]).select(*strata, "family", "positive", shown.alias("shown"))
    ready = checkpoint(ready.filter(" AND ".join(f"{s} IS NOT NULL" for s in strata)))
    sets = ready.groupBy(*strata, "shown").agg(F.count("*").alias("n")).withColumn("class", F.lit(None).cast("int"))
    wants = ready.groupBy(*strata, F.col("positive").alias("class")).agg(F.count("*").alias("n")).withColumn("shown", F.lit(None).cast("string"))
    solved = checkpoint(sets.unionByName(wants).groupBy(*strata).applyInPandas(lambda key, pdf: _flows(key, pdf, names), f"{kinds}, shown string, class int, upto long, deficit int"))
    steps = solved.filter("shown IS NOT NULL").groupBy(*strata, "shown").agg(F.array_sort(F.collect_list(F.struct("upto", "class"))).alias("steps"))
    ranked = running_before(ready, [*strata, "shown"], ["family"], name="_i").join(steps, [*strata, "shown"])
    assigned = ranked.select(*strata, "family", F.filter("steps", lambda x: F.col("_i") < x["upto"])[0]["class"].alias("absent_class"), F.lit("assigned").alias("status"), F.lit(0).alias("deficit"))
    failed = solved.filter("shown IS NULL").select(*strata, F.lit(None).cast("string").alias("family"), F.lit(None).cast("int").alias("absent_class"), F.lit("infeasible").alias("status"), "deficit")
    return assigned.unionByName(failed)


def hashed_part(df: DataFrame, key: str, n: int, slots: list[int]) -> DataFrame:
    """Rows whose unsigned digest bucket is among the slots."""
    return df.filter(hash_bucket(F.col(key).cast("string"), n).isin(slots))
