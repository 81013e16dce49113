"""Joins: strict, lookup, exclusion, pairing, expansion and similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import touches
from ..functions.hashing import stable_key
from ..session import checkpoint
from .skew import hot_keys, salted_join


def strict_join(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """One-to-one join of equal key sets; the query fails on a repeated or unmatched key.

    Uniqueness is counted in windows over the join's own partitioning, so each side
    is shuffled once. Null keys fail. Two empty tables give no rows.
    """
    keys = Window.partitionBy(*on)
    a = left.withColumn("_l", F.count("*").over(keys))
    b = right.withColumn("_r", F.count("*").over(keys))
    ok = F.coalesce((F.col("_l") == 1) & (F.col("_r") == 1), F.lit(False))
    joined = a.join(b, list(on), "full_outer").withColumn("_ok", F.when(ok, True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("strict join: key repeated or without partner:"), *[F.col(k).cast("string") for k in on])).cast("boolean")))
    return joined.filter("_ok").drop("_l", "_r", "_ok")


def key_gaps(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """Keys that only one side has, or that repeat: key columns, n_left, n_right."""
    a = left.groupBy(*on).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*on).agg(F.count("*").alias("n_right"))
    both = a.join(b, list(on), "full_outer").select(*on, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.filter("n_left <> 1 OR n_right <> 1")


def paired(left: DataFrame, right: DataFrame, on: str, columns: list[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Two arms side by side: key, and each column once per arm as ``<arm>_<column>``."""
    a, b = (df.select(on, *[F.col(c).alias(f"{n}_{c}") for c in columns]) for df, n in zip((left, right), names))
    return a.join(b, on)


def complete_matrix(df: DataFrame, row: str, column: str, levels: list[str], value: Column) -> DataFrame:
    """One row per ``row`` that has a value for every level of ``column``; the levels become columns."""
    cells = [F.max(F.when(F.col(column) == v, value)).alias(str(v)) for v in levels]
    wide = df.groupBy(row).agg(*cells)
    return wide.filter(" AND ".join(f"`{v}` IS NOT NULL" for v in levels))


def lookup_join(rows: DataFrame, dimension: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """N:1 join. Repeats in the dimension are allowed if they agree; keys that conflict or are missing give ``lookup`` = conflict or missing, others ok."""
    values = F.struct(*columns)
    dim = dimension.groupBy(on).agg(F.min(values).alias("_v"), (F.min(values).eqNullSafe(F.max(values))).alias("_same"))
    state = F.when(F.col("_same").isNull(), "missing").when(~F.col("_same"), "conflict").otherwise("ok")
    return rows.join(dim, on, "left").select(*[rows[c] for c in rows.columns], *[F.when(F.col("_same"), F.col(f"_v.{c}")).alias(c) for c in columns], state.alias("lookup"))


def pending(source: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Distinct rows of ``source`` that are not done yet."""
    return source.dropDuplicates([on]).join(done.select(on).distinct(), on, "left_anti")


def exclusion_reasons(rows: DataFrame, sets: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """``rows`` with ``excluded_by``: the first set (in the given order) that holds the row, or null.

    ``sets`` maps a reason to (column of rows, one-column table). One equi-join per
    set; a single join with OR would be a nested loop.
    """
    out, reason = rows, None
    for i, (name, (column, values)) in enumerate(sets.items()):
        mark = values.select(F.col(values.columns[0]).alias(f"_k{i}")).filter(f"_k{i} IS NOT NULL").distinct()
        out = out.join(mark, F.col(column) == F.col(f"_k{i}"), "left")
        hit = F.col(f"_k{i}").isNotNull()
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    return out.withColumn("excluded_by", reason).drop(*[f"_k{i}" for i in range(len(sets))])


def hash_index(c: Column) -> Column:
    """The first 15 hex digits of a SHA-256 as a non-negative long."""
    return F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def partners(families: DataFrame, family: str, klass: str, draws: int = 2, seed: str = "partner") -> DataFrame:
    """(family, draw, partner, partner_class): seeded partners of another class.

    All families are numbered class by class; a draw is a number among those outside
    the own class, so the join is by number and no pairs are spelled out.
    """
    ranked = families.select(family, klass).filter(f"{family} IS NOT NULL AND {klass} IS NOT NULL").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(klass).orderBy(family)) - 1)
    sizes = ranked.groupBy(klass).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy(klass).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    numbered = ranked.join(sizes, klass).withColumn("_g", F.col("_off") + F.col("_i"))
    draw = numbered.filter("_all > _n").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    r = hash_index(F.concat_ws("/", F.lit(seed), family, F.col("draw").cast("string"))) % (F.col("_all") - F.col("_n"))
    draw = draw.withColumn("_r", r).withColumn("_g", F.when(F.col("_r") >= F.col("_off"), F.col("_r") + F.col("_n")).otherwise(F.col("_r"))).select(family, "draw", "_g")
    return draw.join(numbered.select("_g", F.col(family).alias("partner"), F.col(klass).alias("partner_class")), "_g").drop("_g")


def each_with(rows: DataFrame, name: str, values: list) -> DataFrame:
    """Every row once per value (conditions, views, seeds): an explode, not a join."""
    return rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def near_hash_pairs(rows: DataFrame, key: str, hash64: str, group: str, most: int = 4, across_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pairs of 64-bit hashes at Hamming distance up to ``most``: (pairs, members).

    Rows of equal hash and group form one class, named by its least key; ``members``
    maps keys to classes. ``pairs`` (left, right, distance) holds every pair of
    different classes within the distance, in different groups if so asked. The hash
    is cut into most + 1 bands; by the pigeonhole principle such a pair shares one.
    """
    known = rows.filter(f"{hash64} IS NOT NULL")
    both = F.concat_ws("/", F.col(hash64).cast("string"), F.coalesce(F.col(group).cast("string"), F.lit("")))
    classes = known.groupBy(hash64, group).agg(F.min(key).alias("class"), F.count("*").alias("n"))
    named = checkpoint(classes.select(both.alias("_both"), "class", "n"))
    members = salted_join(known.select(key, both.alias("_both")), named.select("_both", "class"), "_both", hot_keys(named, "_both", "n"), F.col(key)).select(key, "class")
    n = most + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.shiftleft(F.col(hash64), 64 - edges[i + 1]), 64 - (edges[i + 1] - edges[i])).alias("v")) for i in range(n)])
    spread = classes.select("class", F.col(hash64).alias("h"), F.col(group).alias("g"), F.explode(bands).alias("band"))
    a, b = spread.alias("a"), spread.alias("b")
    apart = F.expr("NOT (a.g <=> b.g)") if across_groups else F.lit(True)
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.class") < F.col("b.class")) & apart)
    distance = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h")))
    return pairs.filter(distance <= most).select(F.col("a.class").alias("left"), F.col("b.class").alias("right"), distance.alias("distance")).distinct(), members


def near_hash_members(rows: DataFrame, key: str, hash64: str, group: str, most: int = 4, across_groups: bool = True) -> DataFrame:
    """(key, class, links) of every row with a hash: ``links`` counts the rows of all classes paired with its own by ``near_hash_pairs``."""
    pairs, members = near_hash_pairs(rows, key, hash64, group, most, across_groups)
    members = checkpoint(members)
    sizes = members.groupBy(F.col("class").alias("other")).agg(F.count("*").alias("n"))
    ends = pairs.select(F.col("left").alias("class"), F.col("right").alias("other"))
    ends = ends.union(ends.select("other", "class"))
    links = checkpoint(ends.join(sizes, "other").groupBy("class").agg(F.sum("n").alias("links")))
    counted = checkpoint(sizes.withColumnRenamed("other", "class").join(links, "class", "left").select("class", "n", F.coalesce("links", F.lit(0).cast("long")).alias("links")))
    return salted_join(members, counted.select("class", "links"), "class", hot_keys(counted, "class", "n"), F.col(key)).select(key, "class", "links")


def nearest_rows(queries: DataFrame, corpus: DataFrame, key: str, vector: str, label: str, k: int = 1, block: int = 20_000) -> DataFrame:
    """(key, rank, neighbour, neighbour_label, similarity): the k most cosine-similar corpus rows of each query.

    Queries are taken in blocks of ``block`` rows (so what is broadcast is bounded);
    each block meets all corpus rows as matrix products within the partitions, whose
    best k are merged. A row is not its own neighbour; ties go to the lesser key.
    """
    total = queries.count()
    parts = max(1, -(-total // block))
    out = None
    for p in range(parts):
        mine = queries.select(key, vector).filter(f"{vector} IS NOT NULL").filter(F.pmod(F.xxhash64(key), F.lit(parts)) == p).toPandas()
        if mine.empty:
            continue
        q = np.stack(mine[vector].to_numpy()).astype(np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)
        shared = queries.sparkSession.sparkContext.broadcast((mine[key].to_numpy(), q))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for pdf in batches:
                if pdf.empty:
                    continue
                c = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
                keys, labels = pdf[key].to_numpy(), pdf[label].to_numpy()
                sim = matrix @ c.T
                sim[ids[:, None] == keys[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(keys, sim.shape), -np.round(sim, 12)), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(ids)), order.shape[1])
                cols = order.ravel()
                keep = np.isfinite(sim[rows, cols])
                yield pd.DataFrame({key: ids[rows][keep], "neighbour": keys[cols][keep], "neighbour_label": labels[cols][keep], "similarity": sim[rows, cols][keep]})

        kind, lab = corpus.schema[key].dataType.simpleString(), corpus.schema[label].dataType.simpleString()
        part = corpus.select(key, vector, label).filter(f"{vector} IS NOT NULL").mapInPandas(run, f"{key} {kind}, neighbour {kind}, neighbour_label {lab}, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind, lab = corpus.schema[key].dataType.simpleString(), corpus.schema[label].dataType.simpleString()
        out = queries.sparkSession.createDataFrame([], f"{key} {kind}, neighbour {kind}, neighbour_label {lab}, similarity double")
    order = Window.partitionBy(key).orderBy(F.round("similarity", 12).desc(), "neighbour")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "rank", "neighbour", "neighbour_label", "similarity")


def concat_features(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): both vectors one after the other, each divided by the root of two."""
    both = a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key)
    return both.select(key, F.transform(F.concat("_a", "_b"), lambda x: x.cast("double") / F.sqrt(F.lit(2.0))).alias(vector))


def review_join(manifest: DataFrame, a: DataFrame, b: DataFrame, adjudication: DataFrame, key: str) -> DataFrame:
    """key, decision_a, decision_b, adjudicated, state of each manifest row.

    ``state`` is agreed, adjudicated, open (they disagree and nobody decided), extra
    (decided though they agree) or missing (a review lacks). Null decisions are missing.
    """
    one = lambda df, name: df.groupBy(key).agg(F.min("decision").alias(name))
    joined = manifest.select(key).distinct().join(one(a, "decision_a"), key, "left").join(one(b, "decision_b"), key, "left").join(one(adjudication, "adjudicated"), key, "left")
    agree = F.col("decision_a") == F.col("decision_b")
    state = F.when(agree.isNull(), "missing").when(agree & F.col("adjudicated").isNotNull(), "extra").when(agree, "agreed").when(F.col("adjudicated").isNotNull(), "adjudicated").otherwise("open")
    return joined.withColumn("state", state)


def clear_of_boxes(crops: DataFrame, boxes: str, crop: str) -> DataFrame:
    """Crops that share no inner points with any box of their row's list; empty and null lists hit nothing."""
    return crops.filter(F.coalesce(F.forall(boxes, lambda b: ~touches(F.col(crop), b)), F.lit(True)))


def family_roles(images: DataFrame, key: str, query: str, absent: str) -> DataFrame:
    """Three role rows per image: positive, semantic_negative (asks for the absent class), visual_counterfactual."""
    role = lambda name, c, present: F.struct(F.lit(name).alias("role"), c.alias("query_class_id"), F.lit(present).alias("evidence_present"))
    roles = F.array(role("positive", F.col(query), True), role("semantic_negative", F.col(absent), False), role("visual_counterfactual", F.col(query), False))
    return images.select(*[c for c in images.columns if c not in (query, absent)], F.explode(roles).alias("_r")).select("*", "_r.*").drop("_r").withColumn("role_id", F.substring(stable_key("role", F.col(key).cast("string"), F.col("role")), 1, 32))
