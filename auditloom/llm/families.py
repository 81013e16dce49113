"""Problem 2: splits that keep related records together.

Records that share a family, a source image or a near-duplicate component are
joined into groups by hash-to-min over the image graph, and each group is given to
a split by weighted rendezvous hashing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from ..session import checkpoint
from .ids import plain_component, plain_digest, plain_id, plain_image, plain_split

#: Groups of at least this share of the smallest split's target are placed one by one, largest first.
LARGE_SHARE = 0.02


def hash_to_min(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: one row (node, root) per node of ``edges`` (a, b); root is the least node.

    Hash-to-min as relations: the cluster of a node is a set of rows (v, u). In each
    round every node sends its cluster to the cluster's minimum and the minimum to
    every member; clusters are never gathered into one record, and a node that bears
    a large part of the rows is spread over tasks. Rounds end when nothing changes;
    their number grows as the logarithm of the longest path. Null ends and self
    edges are ignored; an empty table gives no rows.
    """
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    state = checkpoint(e.select(F.col("a").alias("v"), F.col("b").alias("u")).union(e.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct())
    sign = F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))
    before = state.agg(F.count("*").alias("n"), sign.alias("s")).first()
    for _ in range(max_rounds):
        least = state.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count("*").alias("n"))
        sent = salted_join(state, least.select("v", "m"), "v", hot_keys(least, "v", "n", before["n"]), F.col("u"))
        to_min = sent.select(F.col("m").alias("v"), "u")
        to_members = sent.select(F.col("u").alias("v"), F.col("m").alias("u"))
        own = least.select(F.col("m").alias("v"), F.col("v").alias("u")).union(least.select("v", F.col("m").alias("u")))
        state = checkpoint(to_min.union(to_members).union(own).filter("v <> u").distinct())
        now = state.agg(F.count("*").alias("n"), sign.alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"hash-to-min is not stable after {max_rounds} rounds")
    return state.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("root")).withColumnRenamed("v", "node")


def related_rows(provenance: DataFrame) -> DataFrame:
    """id, split, family, component and the node that stands for the row: its image, or else its family, component or id."""
    rows = provenance.select(
        plain_id(F.col("id")).alias("id"),
        plain_split(F.col("split")).alias("split"),
        plain_id(F.col("family_id")).alias("family"),
        plain_component(F.col("near_duplicate_component_id")).alias("component"),
        plain_digest(F.col("source_image_sha256")).alias("digest"),
        plain_image(F.col("source_image_id")).alias("image"),
    )
    tag = lambda t, c: F.concat(F.lit(t), F.col(c))
    return rows.withColumn("node", F.coalesce("image", tag("f:", "family"), tag("c:", "component"), tag("d:", "digest"), tag("r:", "id"))).drop("image")


def related_groups(rows: DataFrame) -> DataFrame:
    """(node, root) of every node tied to another by family, component, full digest or a repeated id."""
    full = F.when(F.length("digest") == 64, F.col("digest"))
    ties = F.array(*[F.concat(F.lit(t), c) for t, c in (("f:", F.col("family")), ("c:", F.col("component")), ("d:", full), ("r:", F.col("id")))])
    pairs = checkpoint(rows.filter("node IS NOT NULL").select("node", F.explode(ties).alias("tie")).filter("tie IS NOT NULL").distinct())
    # the first exchange, from ties to nodes: a tie on one node says nothing and is dropped before the join
    least = pairs.groupBy("tie").agg(F.min("node").alias("m"), F.max("node").alias("most"), F.count("*").alias("n")).filter("m <> most")
    hot = hot_keys(least, "tie", "n", pairs.count())
    return hash_to_min(salted_join(pairs, least.select("tie", "m"), "tie", hot, F.col("node")).select(F.col("node").alias("a"), F.col("m").alias("b")))


def rendezvous(key: Column, weights: dict[str, float], seed: int) -> Column:
    """The name that wins ``key`` by weighted rendezvous hashing: greatest weight over minus log of a uniform hash."""
    best = None
    for name, weight in sorted(weights.items()):
        if weight <= 0:
            continue
        uniform = (F.pmod(F.xxhash64(key, F.lit(name), F.lit(seed)), F.lit(2**53)).cast("double") + 0.5) / F.lit(float(2**53))
        entry = F.struct((F.lit(float(weight)) / -F.log(uniform)).alias("score"), F.lit(name).alias("name"))
        best = entry if best is None else F.greatest(best, entry)
    return F.lit(None).cast("string") if best is None else best["name"]


def assign_splits(provenance: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """One row (id, group_id, split) per id; all rows of one family, image, component or full digest share a split.

    ``targets`` has split_name and target_share. Groups of at least LARGE_SHARE of the
    smallest target (so few that the driver holds them) go, largest first, to the
    split that lacks most rows; the shares still lacking are the weights by which
    rendezvous hashing gives out all other groups. A group's place depends on its
    name and these weights only, never on the layout. Rows without any id are left
    out; an empty table gives no rows; if the targets are empty the split is null.
    """
    rows = related_rows(provenance).filter("id IS NOT NULL")
    groups = related_groups(rows)
    placed = checkpoint(rows.join(groups, "node", "left").select("id", F.coalesce("root", "node").alias("group_id")).distinct())
    wanted = {r["split_name"]: float(r["target_share"]) for r in targets.filter("split_name IS NOT NULL AND target_share > 0").groupBy("split_name").agg(F.sum("target_share").alias("target_share")).collect()}
    total, share = placed.count(), sum(wanted.values())
    if not wanted or not total:
        return placed.withColumn("split", F.lit(None).cast("string"))
    lacking = {name: total * w / share for name, w in wanted.items()}
    large = placed.groupBy("group_id").count().filter(F.col("count") >= max(2.0, LARGE_SHARE * min(lacking.values()))).collect()  # at most total / that bound rows
    fixed = {}
    for r in sorted(large, key=lambda r: (-r["count"], r["group_id"])):
        fixed[r["group_id"]] = name = max(sorted(lacking), key=lacking.get)
        lacking[name] -= r["count"]
    weights = {n: max(0.0, v) for n, v in lacking.items()}
    hashed = rendezvous(F.col("group_id"), weights if any(weights.values()) else wanted, seed)
    if not fixed:
        return placed.withColumn("split", hashed)
    set_ = F.broadcast(placed.sparkSession.createDataFrame(sorted(fixed.items()), "group_id string, fixed string"))
    return placed.join(set_, "group_id", "left").select("id", "group_id", F.coalesce("fixed", hashed).alias("split"))


def torn_groups(provenance: DataFrame) -> DataFrame:
    """(key_kind, key_id) of each family and each 24-digit component that the present splits tear apart.

    The groups of hash-to-min are tested first: only one with rows in more than one
    of train, val and dev can hold a torn family or component. Within these groups a
    row without family takes that of its image, and each family and component is
    checked by its rows. Rows of equal image, family and component are one cell
    before anything is joined. Null keys tear nothing; an empty table gives no rows.
    """
    rows = related_rows(provenance)
    bit = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).when(F.col("split") == "dev", 4).otherwise(0)
    cells = checkpoint(rows.filter("node IS NOT NULL").groupBy("node", "family", "component").agg(F.bit_or(bit).alias("bits")))
    per_node = cells.groupBy("node").agg(F.count("*").alias("n"), F.min("family").alias("node_family")).join(related_groups(rows), "node", "left").select("node", "n", "node_family", F.coalesce("root", "node").alias("group_id"))
    per_node = checkpoint(per_node)
    grouped = checkpoint(salted_join(cells, per_node.drop("n"), "node", hot_keys(per_node, "node", "n"), F.xxhash64("family", "component")))
    of_group = checkpoint(grouped.groupBy("group_id").agg(F.bit_or("bits").alias("of_group"), F.count("*").alias("n")))
    torn = of_group.filter(F.bit_count("of_group") > 1)
    held = salted_join(grouped, torn.select("group_id"), "group_id", hot_keys(of_group, "group_id", "n"), F.xxhash64("node", "family", "component"), "left_semi")
    key = lambda kind, c: F.struct(F.lit(kind).alias("key_kind"), c.alias("key_id"))
    keys = F.array(key("family", F.coalesce("family", "node_family")), key("component", F.when(F.length("component") == 24, F.col("component"))))
    checked = held.filter("bits > 0").select("bits", F.explode(keys).alias("k")).filter("k.key_id IS NOT NULL").groupBy("k").agg(F.bit_or("bits").alias("bits"))
    return checked.filter(F.bit_count("bits") > 1).select("k.key_kind", "k.key_id")
