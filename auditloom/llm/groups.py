"""Problem 5: consolidating pairwise matches into groups.

Union-find runs within the partitions of the edges and keeps only a spanning
forest (a star per tree). Forests are merged level by level: a forest that fits a
bounded partition is finished there; a larger one is contracted to its roots, the
roots to their least neighbour in a hashed order that changes with the level, and
merged again. In a random order that leaves at most three quarters of the nodes on
average, whatever the graph and however its rows lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import forests
from ..session import checkpoint
from .ids import plain_component, plain_image

#: Nodes that one union-find holds before it hands out its forest and starts anew.
NODES_PER_FOREST = 400_000
#: A forest of at most so many edges is finished in one partition.
EDGES_PER_PARTITION = 400_000
#: After so many contractions the rest is finished in one partition, however large it is.
MOST_LEVELS = 100


def union_find_groups(edges: DataFrame, nodes_per_forest: int = NODES_PER_FOREST, edges_per_partition: int = EDGES_PER_PARTITION) -> DataFrame:
    """Connected components: one row (node, root) per node of ``edges`` (a, b strings); root is the least node.

    A self edge names a node of its own; null ends are ignored; repeats and order do
    not matter; an empty table gives no rows. A tree's root is its least node, so the
    forest of a node that ties a third of all rows is one row per partition and node.
    """
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    star = forests(nodes_per_forest)
    schema = "node string, root string"
    levels: list[DataFrame] = []
    for salt in range(MOST_LEVELS + 1):
        forest = checkpoint(e.mapInPandas(star, schema))
        size = forest.count()
        if size <= edges_per_partition and (size <= nodes_per_forest or not levels) or salt == MOST_LEVELS:
            last = checkpoint(forest.coalesce(1).mapInPandas(forests(2**62), schema))
            break
        # each node to the least root of its trees; the roots that met in a node are the next level's edges
        node = forest.repartition(max(1, -(-size // edges_per_partition)), "node").groupBy("node").agg(F.min("root").alias("least"), F.collect_set("root").alias("roots"))
        node = checkpoint(node)
        levels.append(node.select("node", F.col("least").alias("root")))
        e = node.filter(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        chosen, e = _contracted(checkpoint(e), salt)
        levels.append(chosen)
    if not levels:
        return last
    for level in reversed(levels):
        up = last.select(F.col("node").alias("root"), F.col("root").alias("final"))
        last = level.join(up, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    last = checkpoint(last)
    least = last.groupBy("root").agg(F.min("node").alias("least"))
    return last.join(least, "root").select("node", F.col("least").alias("root"))


def _contracted(edges: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) with each node's first among itself and its neighbours, ordered by a hash with ``salt``; and the edges between these."""
    both = edges.union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b"))
    chosen = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", F.lit(salt)).alias("h"), F.col("b").alias("v"))).alias("m")).select("node", F.col("m.v").alias("root")))
    end = lambda c: chosen.select(F.col("node").alias(c), F.col("root").alias(f"to_{c}"))
    moved = edges.join(end("a"), "a").join(end("b"), "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
    return chosen, moved.filter("a <> b").distinct()


def match_edges(pair_matches: DataFrame, provenance: DataFrame, prior_positives: DataFrame) -> DataFrame:
    """Ties (a, b) between images, and between images and the components they bear (``~`` + component).

    A match counts unless its high_confidence is false. Half-empty and self-referring
    rows tie nothing; stand-ins for unknown components tie nothing.
    """
    pairs = pair_matches.filter(F.coalesce("high_confidence", F.lit(True))).select(plain_image(F.col("left_id")).alias("a"), plain_image(F.col("right_id")).alias("b"))
    edges = pairs
    for t in (provenance, prior_positives):
        edges = edges.unionByName(t.select(plain_image(F.col("source_image_id")).alias("a"), F.concat(F.lit("~"), plain_component(F.col("near_duplicate_component_id"))).alias("b")))
    return edges.filter("a <> b")


def image_groups(pair_matches: DataFrame, provenance: DataFrame, prior_positives: DataFrame, **bounds: int) -> DataFrame:
    """(source_image_id, group_id) of every image tied to another; group_id is the group's least image.

    Component nodes sort after image ids, so a root is always an image.
    """
    found = union_find_groups(match_edges(pair_matches, provenance, prior_positives), **bounds).filter(~F.col("node").startswith("~"))
    shared = found.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    grown = found.filter("node <> root").select(F.col("node").alias("source_image_id"), F.col("root").alias("group_id"))
    return grown.union(shared.select(F.col("root").alias("source_image_id"), F.col("root").alias("group_id")))
