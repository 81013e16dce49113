"""The queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import abuse, completeness, families, groups, overlap, packing, pairs, sampling, tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split_overlap(table(spark, sf_dir, "provenance")).select("id", "overlap")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "provenance"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.torn_groups(table(spark, sf_dir, "provenance"))


def p2_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.assign_splits(table(spark, sf_dir, "provenance"), table(spark, sf_dir, "split_targets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.cut_answers(table(spark, sf_dir, "predictions")).select("id", "attempt").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.truncation_report(table(spark, sf_dir, "predictions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_defects(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "predictions")).select("id", "attempt", "defect").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defect_report(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "predictions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.image_groups(table(spark, sf_dir, "pair_matches"), table(spark, sf_dir, "provenance"), table(spark, sf_dir, "prior_positives"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.short_categories(table(spark, sf_dir, "feature_rows"), table(spark, sf_dir, "sample_targets"))


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw_sample(table(spark, sf_dir, "feature_rows"), table(spark, sf_dir, "sample_targets"), table(spark, sf_dir, "class_catalog"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.category_report(table(spark, sf_dir, "feature_rows"), table(spark, sf_dir, "sample_targets"), table(spark, sf_dir, "class_catalog"))


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stable_sample(table(spark, sf_dir, "feature_rows"), table(spark, sf_dir, "provenance"))


def p7_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.growth_report(table(spark, sf_dir, "feature_rows"), table(spark, sf_dir, "provenance"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "container_specs"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p9_containers(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abusive_documents(table(spark, sf_dir, "documents"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf_dir, "documents"))


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abuse_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}

def oracle_sql() -> dict[str, str]:
    from . import sql

    return dict(sql.ORACLE)
