"""Shared inputs of the queries, and their SQL as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spelling
from ..functions.json_contract import DIAGNOSIS_KEYS, KEYS, RELIABILITIES, STATUSES, with_answers
from ..functions.spelling import EMPTY_SHA256
from ..session import table

#: DuckDB expressions of the plain spellings (see ``functions.spelling``) of the columns as the tables name them.
_EDGE = "' ' || chr(9) || chr(10) || chr(13)"
SQL_SPLIT = f"CASE WHEN lower(trim(split, {_EDGE})) IN ('train', 'training') THEN 'train' WHEN lower(trim(split, {_EDGE})) IN ('val', 'valid', 'validation') THEN 'val' WHEN lower(trim(split, {_EDGE})) IN ('dev', 'development', 'test') THEN 'dev' WHEN lower(trim(split, {_EDGE})) IN ('excluded', 'exclude') THEN 'excluded' END"
SQL_COMPONENT = f"CASE WHEN regexp_extract(lower(trim(near_duplicate_component_id, {_EDGE})), '(?:^|[^0-9a-z])([0-9a-f]{{24}}|ip[0-9]{{9}})$', 1) LIKE 'ip%' THEN upper(regexp_extract(lower(trim(near_duplicate_component_id, {_EDGE})), '(?:^|[^0-9a-z])([0-9a-f]{{24}}|ip[0-9]{{9}})$', 1)) ELSE (SELECT CASE WHEN c <> '' AND replace(c, c[1], '') <> '' THEN c END FROM (SELECT regexp_extract(lower(trim(near_duplicate_component_id, {_EDGE})), '(?:^|[^0-9a-z])([0-9a-f]{{24}})$', 1) AS c)) END"
SQL_DIGEST = f"(SELECT CASE WHEN d <> '' AND replace(d, d[1], '') <> '' AND NOT starts_with('{EMPTY_SHA256}', d) THEN d END FROM (SELECT CASE WHEN regexp_matches(t, '^sha-?256[-:=][A-Za-z0-9+/]{{43}}=$', 'i') THEN lower(hex(from_base64(regexp_extract(t, '[-:=]([A-Za-z0-9+/]{{43}}=)$', 1)))) ELSE regexp_extract(lower(t), '^(?:sha-?256[-:=])?([0-9a-f]{{8,64}})(?:…|\\.\\.\\.)?$', 1) END AS d FROM (SELECT trim(source_image_sha256, {_EDGE}) AS t)))"
SQL_IMAGE = "nullif(regexp_extract(upper(source_image_id), '(?:^|[^0-9A-Z])(IP[0-9]{9})(?:[^0-9]|$)', 1), '')"
SQL_ID = f"nullif(lower(trim(id, {_EDGE})), '')"
PLAIN = f"pl AS (SELECT {SQL_ID} AS id, {SQL_SPLIT} AS split, {SQL_IMAGE} AS image, {SQL_DIGEST} AS digest, {SQL_COMPONENT} AS component, family_id, role, template_id, length_bucket, transform_id, query_class_id, derived_image_sha256 FROM provenance)"

SEEDS = ("s17", "s29", "s43")


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per manifest id."""
    return table(spark, sf_dir, "manifest").groupBy("id").agg(*[F.min(c).alias(c) for c in ("role", "condition", "prompt_view", "query_class_id", "family_id", "gt_bbox")])


def latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last attempt's text per id."""
    order = Window.partitionBy("id").orderBy(F.desc("attempt"), "raw_text", F.asc_nulls_last("source"))
    return table(spark, sf_dir, "predictions").filter("raw_text IS NOT NULL").select("id", "source", "raw_text", F.row_number().over(order).alias("rn")).filter("rn = 1").drop("rn")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows with their parsed answer and the class band."""
    parsed = with_answers(latest_answers(spark, sf_dir)).withColumn("parsed", F.col("syntax"))
    band = table(spark, sf_dir, "class_catalog").select(F.col("class_id").alias("query_class_id"), "band")
    return manifest_rows(spark, sf_dir).join(parsed, "id").join(band, "query_class_id", "left")


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance with one row per id: the least of each column, from the plain spellings of split."""
    return table(spark, sf_dir, "provenance").groupBy("id").agg(*[F.min(c).alias(c) for c in ("family_id", "role", "split", "source", "template_id", "length_bucket", "query_class_id", "present_class_ids", "source_image_id", "source_image_sha256", "near_duplicate_component_id", "transform_id")])


def plain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance with id, split, image, digest and component in plain spelling, one row per delivery."""
    kept = ("family_id", "role", "template_id", "length_bucket", "transform_id", "query_class_id", "derived_image_sha256")
    return table(spark, sf_dir, "provenance").select(spelling.plain_id(F.col("id")).alias("id"), spelling.plain_split(F.col("split")).alias("split"), spelling.plain_image(F.col("source_image_id")).alias("image"), spelling.plain_digest(F.col("source_image_sha256")).alias("digest"), spelling.plain_component(F.col("near_duplicate_component_id")).alias("component"), *kept)


def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


MANIFEST = """m AS (SELECT id, min(role) AS role, min(condition) AS condition, min(prompt_view) AS prompt_view, min(query_class_id) AS query_class_id, min(family_id) AS family_id, min(gt_bbox) AS gt_bbox FROM manifest GROUP BY id)"""
ANSWERS = """a AS (SELECT id, source, raw_text FROM (SELECT id, source, raw_text, row_number() OVER (PARTITION BY id ORDER BY attempt DESC, raw_text, source NULLS LAST) AS rn FROM predictions WHERE raw_text IS NOT NULL) WHERE rn = 1)"""
OUTCOMES = rf"""{MANIFEST}, {ANSWERS},
j AS (SELECT *, CASE WHEN json_valid(raw_text) AND NOT regexp_matches(raw_text, ',\s*[}}\]]') THEN raw_text END AS js FROM a),
k AS (SELECT *, coalesce(json_type(js) = 'OBJECT', false) AS parsed, CASE WHEN json_type(js) = 'OBJECT' THEN js END AS jo FROM j),
f AS (SELECT id, source, raw_text, parsed, jo,
  CASE WHEN json_type(jo, '$.evidence_present') = 'BOOLEAN' THEN (jo->>'$.evidence_present')::BOOLEAN END AS evidence_present,
  CASE WHEN json_type(jo, '$.evidence_region') = 'ARRAY' THEN (jo->'$.evidence_region')::DOUBLE[] END AS region,
  CASE WHEN json_type(jo, '$.diagnosis.pest_id') IN ('UBIGINT', 'BIGINT') THEN (jo->>'$.diagnosis.pest_id')::INTEGER END AS pest_id,
  jo->>'$.diagnosis.status' AS status, jo->>'$.reliability' AS reliability FROM k),
g AS (SELECT *, coalesce(json_keys(jo) = [{_quoted(KEYS)}] AND json_type(jo, '$.diagnosis') = 'OBJECT' AND json_keys(jo, '$.diagnosis') = [{_quoted(DIAGNOSIS_KEYS)}] AND evidence_present IS NOT NULL AND json_type(jo, '$.visible_attributes') = 'ARRAY' AND status IN ({_quoted(STATUSES)}) AND reliability IN ({_quoted(RELIABILITIES)}), false) AS schema_ok FROM f),
h AS (SELECT *, schema_ok AND CASE WHEN evidence_present THEN coalesce(len(region) = 4 AND region[3] > region[1] AND region[4] > region[2] AND status = 'supported' AND pest_id IS NOT NULL AND reliability = 'supported', false) ELSE json_type(jo, '$.evidence_region') = 'NULL' AND status <> 'supported' AND pest_id IS NULL AND reliability <> 'supported' END AS semantic FROM g),
o AS (SELECT m.*, h.source, h.raw_text, h.parsed, h.evidence_present, h.region, h.pest_id, h.status, h.reliability, h.schema_ok, h.semantic, c.band FROM m JOIN h USING (id) LEFT JOIN class_catalog c ON c.class_id = m.query_class_id)"""
FIRST = """r AS (SELECT id, min(family_id) AS family_id, min(role) AS role, min(split) AS split, min(source) AS source, min(template_id) AS template_id, min(length_bucket) AS length_bucket, min(query_class_id) AS query_class_id, min(present_class_ids) AS present_class_ids, min(source_image_id) AS source_image_id, min(source_image_sha256) AS source_image_sha256, min(near_duplicate_component_id) AS near_duplicate_component_id, min(transform_id) AS transform_id FROM provenance GROUP BY id)"""


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
