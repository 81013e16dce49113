"""Constraints as tables of violations, threshold gates and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .aggregate import overlap_across, repeated


def violations(rules: dict[str, DataFrame], hard: set[str]) -> DataFrame:
    """(rule, hard, subject): every row a rule's table names in its first column; all rules in one table."""
    out = None
    for name, df in rules.items():
        one = df.select(F.lit(name).alias("rule"), F.lit(name in hard).alias("hard"), F.col(df.columns[0]).cast("string").alias("subject"))
        out = one if out is None else out.unionByName(one)
    return out


def passes(found: DataFrame) -> DataFrame:
    """One row: passed (no hard violation), hard and soft counts."""
    return found.agg((F.count_if("hard") == 0).alias("passed"), F.count_if("hard").alias("hard_violations"), F.count_if(~F.col("hard")).alias("warnings"))


def enforced(df: DataFrame, found: DataFrame) -> DataFrame:
    """``df``, or a failure of the query if there is a hard violation."""
    verdict = passes(found).select(F.when(F.col("passed"), True).otherwise(F.raise_error(F.format_string("%d hard violations", "hard_violations")).cast("boolean")).alias("_ok"))
    return df.crossJoin(F.broadcast(verdict)).filter("_ok").drop("_ok")


def leakage_rules(rows: DataFrame, key: str, split: str, digest: str, component: str) -> DataFrame:
    """Repeated keys and digests in several splits (hard), components in several splits (warnings)."""
    return violations({"repeated_id": repeated(rows.filter(f"{key} IS NOT NULL"), key), "digest_across_splits": overlap_across(rows, digest, split), "component_across_splits": overlap_across(rows, component, split)}, {"repeated_id", "digest_across_splits"})


def incomplete_groups(rows: DataFrame, group: str, part: str, wanted: list[str]) -> DataFrame:
    """Groups whose parts are not exactly the wanted ones, each once: group, parts as ``name:count``.

    Repeats are counted before they are gathered, so a group has one entry per part.
    """
    counted = rows.filter(f"{group} IS NOT NULL").groupBy(group, part).agg(F.count("*").alias("_n"))
    parts = F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce(part, F.lit("none")), F.col("_n").cast("string"))))
    return counted.groupBy(group).agg(parts.alias("parts")).filter(F.col("parts") != F.array(*[F.lit(f"{w}:1") for w in sorted(wanted)]))


def quota_check(available: DataFrame, strata: list[str], n: str, quota: int) -> DataFrame:
    """Per stratum: available, quota, missing, status READY or BLOCK; nothing is approximated."""
    missing = F.greatest(F.lit(quota) - F.col(n), F.lit(0))
    return available.select(*strata, F.col(n).alias("available"), F.lit(quota).alias("quota"), missing.alias("missing"), F.when(missing > 0, "BLOCK").otherwise("READY").alias("status"))


def gates_table(spark: SparkSession, rows: list[tuple[str, str, float]]) -> DataFrame:
    """(gate, op, threshold), op among >=, >, <=, <, =."""
    return spark.createDataFrame(rows, "gate string, op string, threshold double")


def judged(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """(gate, observed, op, threshold, passed) of each gate; a gate without an observed value fails."""
    v, t = F.col("observed"), F.col("threshold")
    ok = F.when(F.col("op") == ">=", v >= t).when(F.col("op") == ">", v > t).when(F.col("op") == "<=", v <= t).when(F.col("op") == "<", v < t).otherwise(v == t)
    return gates.join(metrics.select("gate", F.col("value").alias("observed")), "gate", "left").select("gate", "observed", "op", "threshold", F.coalesce(ok, F.lit(False)).alias("passed"))


def decision(judgement: DataFrame, yes: str = "PASS", no: str = "FAIL") -> DataFrame:
    """One row: decision and the sorted names of the failed gates; no gates at all fail."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("gate"))))
    return judgement.agg(F.when(F.coalesce(F.bool_and("passed"), F.lit(False)), yes).otherwise(no).alias("decision"), F.array_join(failed, ",").alias("failed"))


def review_verdict(criteria: Column) -> Column:
    """REJECT if any criterion is FAIL, PASS if all are PASS, else UNCERTAIN; an empty list is UNCERTAIN."""
    return F.when(F.exists(criteria, lambda c: c == "FAIL"), "REJECT").when((F.size(criteria) > 0) & F.forall(criteria, lambda c: c.eqNullSafe(F.lit("PASS"))), "PASS").otherwise("UNCERTAIN")


def final_label(a: Column, b: Column, adjudicated: Column) -> Column:
    """The adjudication, else the agreement of both reviews, else OPEN."""
    return F.coalesce(adjudicated, F.when(a == b, a), F.lit("OPEN"))


def merged_failures(a: Column, b: Column) -> Column:
    """Sorted union of two lists of failures; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def run_state(expected: int, present: int, failed: int) -> str:
    """READY, WAITING or BLOCKED of a stage from its counts."""
    return "BLOCKED" if failed or present > expected else "READY" if present == expected else "WAITING"


def check_config(config: dict, required: dict[str, type], frozen: dict) -> list[str]:
    """What a configuration breaks: missing keys, wrong types, changed frozen values, unknown keys; empty if sound."""
    out = [f"missing {k}" for k in required if k not in config]
    out += [f"type {k}" for k, t in required.items() if k in config and (not isinstance(config[k], t) or (t is not bool and isinstance(config[k], bool)))]
    out += [f"frozen {k}" for k, v in frozen.items() if k in config and config[k] != v]
    return out + [f"unknown {k}" for k in config if k not in required and k not in frozen]


def aligned_views(rows: DataFrame, key: str, label: str, views: dict[str, Column]) -> DataFrame:
    """(key, label, view, text): one row per view of each row, from one explode."""
    return rows.select(key, label, F.explode(F.array(*[F.struct(F.lit(n).alias("view"), c.alias("text")) for n, c in views.items()])).alias("v")).select(key, label, "v.view", "v.text")
