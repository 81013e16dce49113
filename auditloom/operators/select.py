"""Ranking, sampling by rank, quotas, bands and schedules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import stable_key
from .rank import running_before


def hash_rank(df: DataFrame, value: str, strata: list[str], namespace: str, name: str = "hash_rank") -> DataFrame:
    """Rank within the strata by the digest of ``namespace/value``, ties by value: the same in every run and layout."""
    keyed = df.withColumn("_hash", stable_key(namespace, F.col(value).cast("string")))
    return running_before(keyed, strata, ["_hash", value], name="_b").withColumn(name, (F.col("_b") + 1).cast("int")).drop("_hash", "_b")


def hash_top_k(df: DataFrame, value: str, strata: list[str], k: int, namespace: str) -> DataFrame:
    """The k rows of least hash rank in each stratum; the window group limit prunes before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(stable_key(namespace, F.col(value).cast("string")), value))
    return df.withColumn("_k", place).filter(F.col("_k") <= k).drop("_k")


def round_robin(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The first item of each group, then the second of each, until k: columns of df and ``turn``."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return turn.orderBy("turn", group).limit(k)


def representatives(df: DataFrame, component: str, klass: str, value: str, namespace: str) -> DataFrame:
    """The member of least (hash, value) of each component of one class; mixed components are dropped."""
    key = F.struct(stable_key(namespace, F.col(value).cast("string")), F.col(value))
    return df.groupBy(component).agg(F.min_by(value, key).alias(value), F.min(klass).alias(klass), F.count_distinct(klass).alias("_n")).filter("_n = 1").drop("_n")


def split_fill(df: DataFrame, rank: str, quotas: list[tuple[str, int]]) -> DataFrame:
    """Ranks 1 to q1 to the first split, the next q2 to the second and so on; the rest is left out."""
    out, upto = None, 0
    for name, q in quotas:
        upto += q
        out = F.when(F.col(rank) <= upto, name) if out is None else out.when(F.col(rank) <= upto, name)
    return df.withColumn("split", out).filter("split IS NOT NULL")


def modulo_split(df: DataFrame, rank: str, excluded: Column) -> DataFrame:
    """Slots of ten by rank: 0 is dev, 1 is val, else train; excluded rows stay ``excluded``."""
    slot = (F.col(rank) - 1) % 10
    return df.withColumn("split", F.when(excluded, "excluded").when(slot == 0, "dev").when(slot == 1, "val").otherwise("train"))


def class_bands(df: DataFrame, klass: str) -> DataFrame:
    """(class, n, band): classes by falling count then id; first third head, second medium, rest tail."""
    counts = df.filter(f"{klass} IS NOT NULL").groupBy(klass).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_i", F.row_number().over(Window.orderBy(F.desc("n"), klass)) - 1).withColumn("_all", F.count("*").over(Window.partitionBy()))
    at = F.col("_i") / F.col("_all")
    return ranked.select(klass, "n", F.when(at < 1 / 3, "head").when(at < 2 / 3, "medium").otherwise("tail").alias("band"))


def even_picks(df: DataFrame, strata: list[str], order: list[str], k: int) -> DataFrame:
    """k evenly spaced rows per stratum by rank: places trunc(i * (n - 1) / (k - 1)); the middle one if k is 1."""
    ranked = running_before(df, strata, order, name="_i")
    sizes = ranked.groupBy(*[F.col(s).alias(f"_z{i}") for i, s in enumerate(strata)]).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for i, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"_z{i}"))
    ranked = ranked.join(sizes, same).drop(*[f"_z{i}" for i in range(len(strata))])
    if k == 1:
        return ranked.filter(F.col("_i") == F.floor((F.col("_n") - 1) / 2)).drop("_i", "_n")
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (k - 1)))
    return ranked.filter(F.array_contains(places, F.col("_i").cast("long"))).drop("_i", "_n")


def top_classes(counts: DataFrame, klass: str, n: str, band: str, quota: int) -> DataFrame:
    """The first ``quota`` classes of each band by falling count, then id."""
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(band).orderBy(F.desc(n), klass))).filter(F.col("place") <= quota)


def largest_box(boxes: Column) -> Column:
    """Of an array of structs with ``box`` and ``pest_id``: the one of largest area, ties to the lesser id."""
    key = lambda b: F.struct(((b["box"][2] - b["box"][0]) * (b["box"][3] - b["box"][1])).alias("a"), (-b["pest_id"]).alias("i"), b.alias("b"))
    return F.array_max(F.transform(boxes, key))["b"]


def largest_box_per(df: DataFrame, key: str, boxes: str) -> DataFrame:
    """(key, largest) over all rows of a key: each row's best box, then the best of those, combined before the shuffle."""
    best = df.select(key, largest_box(F.col(boxes)).alias("b")).filter("b IS NOT NULL")
    size = (F.col("b.box")[2] - F.col("b.box")[0]) * (F.col("b.box")[3] - F.col("b.box")[1])
    return best.groupBy(key).agg(F.max(F.struct(size.alias("size"), (-F.col("b.pest_id")).alias("i"), F.col("b")))["b"].alias("largest"))


def top_two(p: Column) -> Column:
    """Struct of the best and second place (from 0), the best value and the margin; ties to the lower place."""
    ranked = F.sort_array(F.transform(p, lambda v, i: F.struct(v.cast("double").alias("v"), (-i).alias("i"))), asc=False)
    return F.struct((-ranked[0]["i"]).alias("top1"), (-F.get(ranked, F.lit(1))["i"]).alias("top2"), ranked[0]["v"].alias("confidence"), (ranked[0]["v"] - F.get(ranked, F.lit(1))["v"]).alias("margin"))


def ranked_candidates(scores: DataFrame, key: str, candidate: str, score: str, truth: str) -> DataFrame:
    """(key, truth_rank, top1, top3, top5) from one row per candidate; order by falling score, then candidate."""
    placed = scores.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), candidate)))
    rank = F.min(F.when(F.col(candidate) == F.col(truth), F.col("_r")))
    return placed.groupBy(key).agg(rank.alias("truth_rank")).select(key, "truth_rank", *[F.coalesce(F.col("truth_rank") <= k, F.lit(False)).alias(f"top{k}") for k in (1, 3, 5)])


def first_per_case(df: DataFrame, case: Column, order: list[str], most: int = 5) -> DataFrame:
    """The first rows of each case type in the given order; rows without a case are left out."""
    typed = df.withColumn("case_type", case).filter("case_type IS NOT NULL")
    return typed.withColumn("place", F.row_number().over(Window.partitionBy("case_type").orderBy(*order))).filter(F.col("place") <= most)


def cyclic_schedule(df: DataFrame, order: list[str], length: int, roles: tuple[str, ...]) -> DataFrame:
    """(step, role, and the row of place step // roles modulo the pool): an exposure schedule of ``length`` steps."""
    pool = df.withColumn("_i", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    steps = df.sparkSession.range(length).select(F.col("id").alias("step"))
    role = F.element_at(F.array(*map(F.lit, roles)), (F.col("step") % len(roles) + 1).cast("int"))
    size = pool.agg(F.max("_n").alias("_size"))
    at = steps.crossJoin(F.broadcast(size)).withColumn("_i", (F.floor(F.col("step") / len(roles)) % F.col("_size")).cast("int")).withColumn("schedule_role", role)
    return at.join(pool.drop("_n"), "_i").drop("_i", "_size")


def class_quota_schedule(rows: DataFrame, family: str, klass: str, band: str, role: str, key: str, quotas: dict[str, int], per_class: int, roles: tuple[str, ...], length: int, strict: bool = True) -> DataFrame:
    """An exposure schedule over whole families: (step, schedule_role, key, family, class, band, exposure_id).

    Of each band the quota of classes is picked by hash among those with at least
    ``per_class`` families that have every role; of each class that many families, by
    hash. Step i takes role i modulo the roles, from that role's rows in hash order,
    over and over, so each family's rows are passed through whole. A band with too few
    classes fails the query, unless ``strict`` is off: then it gives those it has. The picked rows (quotas times families) are few by
    request; the ranking before them is spread over tasks.
    """
    known = rows.filter(F.col(family).isNotNull() & F.col(klass).isNotNull() & F.col(role).isin(*roles))
    whole = known.groupBy(klass, band, family).agg(*[F.count_if(F.col(role) == r).alias(f"_{i}") for i, r in enumerate(roles)]).filter(" AND ".join(f"_{i} >= 1" for i in range(len(roles)))).select(klass, band, family)
    classes = whole.groupBy(klass, band).agg(F.count("*").alias("_n")).filter(F.col("_n") >= per_class)
    picked = None
    for name, quota in sorted(quotas.items()):
        one = hash_top_k(classes.filter(F.col(band) == name), klass, [band], quota, f"class-{name}")
        gap = one.agg(F.count("*").alias("n")).select(F.when(F.col("n") == quota, True).otherwise(F.raise_error(F.format_string(f"band {name} has %d of {quota} classes", "n")).cast("boolean")).alias("_ok"))
        one = (one.crossJoin(F.broadcast(gap)).filter("_ok") if strict else one).select(klass)
        picked = one if picked is None else picked.unionByName(one)
    families = hash_top_k(whole.join(picked, klass, "left_semi"), family, [klass], per_class, "family").select(family)
    pool = known.join(families, family, "left_semi").withColumn("_key", stable_key("exposure", F.col(key)))
    pool = pool.withColumn("_i", F.row_number().over(Window.partitionBy(role).orderBy("_key", key)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(role)))
    steps = rows.sparkSession.range(length).select(F.col("id").alias("step"), F.element_at(F.array(*map(F.lit, roles)), (F.col("id") % len(roles) + 1).cast("int")).alias("schedule_role"), F.floor(F.col("id") / len(roles)).alias("_turn"))
    sizes = pool.groupBy(F.col(role).alias("schedule_role")).agg(F.count("*").alias("_size"))
    at = steps.join(F.broadcast(sizes), "schedule_role").withColumn("_i", (F.col("_turn") % F.col("_size")).cast("int"))
    out = at.join(pool.withColumnRenamed(role, "schedule_role").drop("_n"), ["schedule_role", "_i"])
    return out.select("step", "schedule_role", key, family, klass, band, F.substring(F.sha2(F.concat_ws("|", F.lit("exposure"), "step", key).cast("binary"), 256), 1, 32).alias("exposure_id"))


def python_random_sample(df: DataFrame, klass: str, value: str, k: int, seed: int) -> DataFrame:
    """Per class, ``random.Random("<seed>:<class>").sample`` of its sorted distinct values; classes must fit a task."""
    import random

    kinds = df.schema[klass].dataType.simpleString(), df.schema[value].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = sorted(pdf[value].dropna().unique().tolist())
        picked = random.Random(f"{seed}:{key[0]}").sample(values, min(k, len(values)))
        return pd.DataFrame({klass: [key[0]] * len(picked), value: picked})

    return df.select(klass, value).distinct().groupBy(klass).applyInPandas(run, f"{klass} {kinds[0]}, {value} {kinds[1]}")


def capped_taxonomy(files: DataFrame, klass: str, path: str, cap: int, seed: str) -> DataFrame:
    """At most ``cap`` files per class directory by hash rank, with the name's spelling mended and cut at its last dash."""
    picked = hash_rank(files, path, [klass], seed, "place").filter(F.col("place") <= cap)
    mended = F.regexp_replace(F.lower(klass), "lavra", "larva")
    stage = F.regexp_extract(mended, r"^(.*)-([^-]+)$", 2)
    species = F.when(stage != "", F.regexp_extract(mended, r"^(.*)-([^-]+)$", 1)).otherwise(mended)
    return picked.withColumn("species", species).withColumn("stage", F.when(stage != "", stage))


def half_by_score(df: DataFrame, strata: list[str], order: list[Column], value: str, total: int, namespace: str) -> DataFrame:
    """The first half of ``total`` by score, the rest by hash rank among the remainder: ``picked`` is score or sample."""
    w = Window.partitionBy(*strata)
    scored = df.withColumn("_s", F.row_number().over(w.orderBy(*order, F.col(value))))
    half = total // 2
    rest = hash_rank(scored.filter(F.col("_s") > half), value, strata, namespace, "_h").filter(F.col("_h") <= total - half)
    return scored.filter(F.col("_s") <= half).withColumn("picked", F.lit("score")).drop("_s").unionByName(rest.withColumn("picked", F.lit("sample")).drop("_s", "_h"))


def winner(df: DataFrame, order: list[Column]) -> DataFrame:
    """The one row that comes first."""
    return df.orderBy(*order).limit(1)
