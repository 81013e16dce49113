"""Queries of the aggregates and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.geometry import centre_inside, iou
from ..functions.text import share
from ..operators import aggregate as A
from ..operators.rank import auroc, spearman
from ..session import table
from .base import FIRST, OUTCOMES, first_rows, outcomes, rounded
from .registry import query

_F1 = """, cells AS (SELECT {keys} t, p, count(*) AS n FROM src GROUP BY {keys} t, p),
sides AS (SELECT {keys} t AS label, n AS tn, 0 AS pn, CASE WHEN t = p THEN n ELSE 0 END AS tp FROM cells WHERE t IS NOT NULL UNION ALL SELECT {keys} p, 0, n, 0 FROM cells WHERE p IS NOT NULL),
per AS (SELECT {keys} label, sum(tn) AS tn, sum(pn) AS pn, sum(tp) AS tp FROM sides GROUP BY {keys} label)"""


def _f1_sql(source: str, keys: str = "", where: str = "tn > 0") -> str:
    k = f"{keys}, " if keys else ""
    return f"WITH {source}{_F1.format(keys=k)} SELECT {k}round(avg(2.0::DOUBLE * tp / (tn + pn)), 6) AS macro_f1, count(*) AS labels FROM per WHERE {where}" + (f" GROUP BY {keys}" if keys else "")


@query("SELECT role, split, count(*) AS n FROM provenance GROUP BY role, split")
def e01_nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nested_counts(table(spark, sf_dir, "provenance"), "role", "split")


@query("SELECT source, count(DISTINCT text) AS texts, count(DISTINCT site_key) AS sites, coalesce(min(n_chars), 0) AS min_chars, coalesce(max(n_chars), 0) AS max_chars FROM documents GROUP BY source")
def e02_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("text").alias("texts"), F.count_distinct("site_key").alias("sites"), F.coalesce(F.min("n_chars"), F.lit(0)).alias("min_chars"), F.coalesce(F.max("n_chars"), F.lit(0)).alias("max_chars"))


@query("SELECT source, count(*) AS n, min(length(raw_text))::INT AS min_len, max(length(raw_text))::INT AS max_len, round(avg(length(raw_text)), 6) AS mean_len, round(quantile_cont(length(raw_text), 0.5), 6) AS median_len, count(DISTINCT length(raw_text)) AS n_len FROM predictions WHERE raw_text IS NOT NULL GROUP BY source")
def e03_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.length_summary(table(spark, sf_dir, "predictions"), "raw_text", "source"), "mean_len", "median_len")


@query("SELECT source_image_sha256, count(DISTINCT split) AS groups, (count(DISTINCT split) * (count(DISTINCT split) - 1)) // 2 AS pairs FROM provenance WHERE source_image_sha256 IS NOT NULL AND split IS NOT NULL GROUP BY source_image_sha256 HAVING count(DISTINCT split) > 1")
def e04_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overlap_across(table(spark, sf_dir, "provenance"), "source_image_sha256", "split")


@query(f"WITH {OUTCOMES} SELECT condition, round(coalesce(avg(evidence_present::INT::DOUBLE), 0.0), 6) AS present_rate, round(avg(parsed::INT::DOUBLE), 6) AS parse_rate FROM o GROUP BY condition")
def e05_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes(spark, sf_dir).groupBy("condition").agg(share(F.col("evidence_present")).alias("present_rate"), share(F.col("parsed")).alias("parse_rate")), "present_rate", "parse_rate")


@query(f"WITH {OUTCOMES} SELECT condition, query_class_id::VARCHAR AS truth, coalesce(pest_id::VARCHAR, 'INVALID') AS predicted, count(*) AS n FROM o GROUP BY ALL")
def e06_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion(outcomes(spark, sf_dir), "query_class_id", "pest_id", "condition")


@query(f"WITH {OUTCOMES} SELECT source, band, count(*) AS n, count(*) FILTER (WHERE evidence_present) AS accepted, round(coalesce(avg(evidence_present::INT::DOUBLE), 0.0), 6) AS rate, max(length(raw_text))::INT AS longest FROM o WHERE role <> 'positive' GROUP BY source, band")
def e07_attribute_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nulls = outcomes(spark, sf_dir).filter("role <> 'positive'")
    return rounded(nulls.groupBy("source", "band").agg(F.count("*").alias("n"), F.count_if("evidence_present").alias("accepted"), share(F.col("evidence_present")).alias("rate"), F.max(F.length("raw_text")).alias("longest")), "rate")


@query(f"WITH {OUTCOMES}, s AS (SELECT source, split_part(source, '_', 1) AS model, avg(parsed::INT::DOUBLE) AS rate FROM o WHERE source IS NOT NULL GROUP BY source) SELECT model, round(avg(rate), 6) AS mean, round(coalesce(stddev_samp(rate), 0.0), 6) AS std, round(coalesce(stddev_pop(rate), 0.0), 6) AS pop_std, round(min(rate), 6) AS worst, count(rate) AS n FROM s GROUP BY model")
def e08_seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = outcomes(spark, sf_dir).filter("source IS NOT NULL").groupBy("source").agg(share(F.col("parsed")).alias("rate")).withColumn("model", F.split("source", "_")[0])
    return rounded(A.seed_summary(rates, "rate", "model"), "mean", "std", "pop_std", "worst")


@query(f"WITH {OUTCOMES}, c AS (SELECT condition, pest_id, count(*) AS n FROM o WHERE pest_id IS NOT NULL GROUP BY ALL), p AS (SELECT condition, pest_id, n::DOUBLE / sum(n) OVER (PARTITION BY condition) AS p, row_number() OVER (PARTITION BY condition ORDER BY n DESC, pest_id) AS r FROM c) SELECT condition, count(*) AS \"values\", round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0.0 END, 6) AS entropy, round(sum(p) FILTER (WHERE r = 1), 6) AS top1_share, round(sum(p) FILTER (WHERE r <= 5), 6) AS top5_share FROM p GROUP BY condition")
def e09_e10_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.concentration(outcomes(spark, sf_dir), "pest_id", "condition"), "entropy", "top1_share", "top5_share")


@query("WITH c AS (SELECT trim(lower(class_band)) AS name, class_id, count(*) AS n FROM feature_rows WHERE class_band IS NOT NULL AND class_id IS NOT NULL GROUP BY ALL), p AS (SELECT name, max(n) AS b, sum(n) AS s FROM c GROUP BY name) SELECT round(sum(b)::DOUBLE / sum(s), 6) AS modal_share, sum(s)::BIGINT AS pairs FROM p")
def e11_modal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.modal_share(table(spark, sf_dir, "feature_rows").withColumn("name", F.trim(F.lower("class_band"))), "name", "class_id"), "modal_share")


@query("SELECT 'source_image_id -> family_id' AS side, source_image_id AS value, count(DISTINCT family_id) AS partners FROM provenance WHERE source_image_id IS NOT NULL AND family_id IS NOT NULL GROUP BY source_image_id HAVING count(DISTINCT family_id) > 1 UNION ALL SELECT 'family_id -> source_image_id', family_id, count(DISTINCT source_image_id) FROM provenance WHERE source_image_id IS NOT NULL AND family_id IS NOT NULL GROUP BY family_id HAVING count(DISTINCT source_image_id) > 1")
def e12_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dependency_breaks(table(spark, sf_dir, "provenance"), "source_image_id", "family_id")


@query(f"WITH {OUTCOMES}, t AS (SELECT unnest(list_filter([CASE WHEN NOT parsed THEN 'syntax' END, CASE WHEN parsed AND NOT schema_ok THEN 'schema' END, CASE WHEN schema_ok AND NOT semantic THEN 'semantic' END], lambda x: x IS NOT NULL)) AS issue FROM o) SELECT issue, count(*) AS n FROM t GROUP BY issue")
def e13_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = F.array(F.when(~F.col("parsed"), "syntax"), F.when(F.col("parsed") & ~F.col("schema_ok"), "schema"), F.when(F.col("schema_ok") & ~F.col("semantic"), "semantic"))
    return outcomes(spark, sf_dir).select(F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("SELECT id, count(*) AS n FROM provenance GROUP BY id HAVING count(*) > 1")
def e14_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeated(table(spark, sf_dir, "provenance"), "id")


@query(f"WITH {OUTCOMES} SELECT condition, count(*) FILTER (WHERE l AND r) AS \"both\", count(*) FILTER (WHERE l AND NOT r) AS only_left, count(*) FILTER (WHERE NOT l AND r) AS only_right, count(*) FILTER (WHERE NOT l AND NOT r) AS neither FROM (SELECT condition, parsed AS l, coalesce(evidence_present = (role = 'positive'), false) AS r FROM o) GROUP BY condition")
def e15_complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.complementarity(outcomes(spark, sf_dir), F.col("parsed"), F.coalesce(F.col("evidence_present") == (F.col("role") == "positive"), F.lit(False)), "condition")


@query("SELECT event_type, min(value) AS least, round(quantile_cont(value, 0.5::DOUBLE), 6) AS median, round(quantile_cont(value, 0.95::DOUBLE), 6) AS p95, max(value) AS most FROM events GROUP BY event_type")
def e16_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.quantiles(table(spark, sf_dir, "events"), "value", "event_type"), "median", "p95")


@query(f"WITH {OUTCOMES}, s AS (SELECT split_part(source, '_', 1) AS model, CASE split_part(source, '_', 2) WHEN 's17' THEN 17 WHEN 's43' THEN 43 END AS step, avg(parsed::INT::DOUBLE) AS parse, avg(semantic::INT::DOUBLE) AS sound FROM o WHERE source IS NOT NULL GROUP BY ALL), d AS (SELECT model, round(max(parse) FILTER (WHERE step = 43) - max(parse) FILTER (WHERE step = 17), 6) AS parse_delta, round(max(sound) FILTER (WHERE step = 43) - max(sound) FILTER (WHERE step = 17), 6) AS sound_delta FROM s GROUP BY model) SELECT *, (coalesce(parse_delta > 0, false)::INT + coalesce(sound_delta > 0, false)::INT)::INT AS rising FROM d")
def e17_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = outcomes(spark, sf_dir).filter("source IS NOT NULL").groupBy("source").agg(share(F.col("parsed")).alias("parse"), share(F.col("semantic")).alias("sound"))
    steps = rates.select(F.split("source", "_")[0].alias("model"), F.regexp_extract("source", r"_s(\d+)$", 1).cast("int").alias("step"), "parse", "sound")
    return rounded(A.hierarchical_delta(steps, "step", 17, 43, "parse", "sound", keys=("model",)), "parse_delta", "sound_delta")


@query(f"WITH {OUTCOMES} SELECT condition, band, prompt_view, GROUPING(condition, band, prompt_view)::BIGINT AS level, count(*) AS n, round(coalesce(avg(parsed::INT::DOUBLE), 0.0), 6) AS parse_rate, round(coalesce(avg(evidence_present::INT::DOUBLE), 0.0), 6) AS present_rate FROM o GROUP BY GROUPING SETS ((), (condition), (band), (prompt_view), (condition, band))")
def e18_grouping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = A.grouping_report(outcomes(spark, sf_dir), [[], ["condition"], ["band"], ["prompt_view"], ["condition", "band"]], ["condition", "band", "prompt_view"], F.count("*").alias("n"), share(F.col("parsed")).alias("parse_rate"), share(F.col("evidence_present")).alias("present_rate"))
    return rounded(report.select("condition", "band", "prompt_view", "level", "n", "parse_rate", "present_rate"), "parse_rate", "present_rate")


@query("WITH s AS (SELECT role, count(*) AS samples, min(length_bucket) AS min_tokens, max(length_bucket) AS max_tokens, round(avg(length_bucket), 6) AS mean_tokens, sum(length_bucket)::BIGINT AS sum_tokens FROM provenance GROUP BY role) SELECT *, round(samples::DOUBLE / sum(samples) OVER (), 6) AS sample_share, round(sum_tokens::DOUBLE / sum(sum_tokens) OVER (), 6) AS token_share FROM s")
def e19_mass_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.mass_shares(table(spark, sf_dir, "provenance"), "role", "length_bucket"), "mean_tokens", "sample_share", "token_share")


@query("SELECT split, count(*) AS \"rows\", count(DISTINCT id) AS ids, count(*) FILTER (WHERE source_image_sha256 IS NULL) AS no_digest, count(DISTINCT query_class_id) AS classes, count(*) FILTER (WHERE len(present_class_ids) > 1) AS many_classes FROM provenance GROUP BY split")
def e20_dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "provenance").groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(F.col("source_image_sha256").isNull()).alias("no_digest"), F.count_distinct("query_class_id").alias("classes"), F.count_if(F.size("present_class_ids") > 1).alias("many_classes"))


@query(f"WITH {OUTCOMES} SELECT source, round(avg(parsed::INT::DOUBLE), 6) AS parse_rate, round(avg((pest_id = query_class_id)::INT::DOUBLE), 6) AS id_accuracy FROM o GROUP BY source")
def e21_probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes(spark, sf_dir).groupBy("source").agg(F.avg(F.col("parsed").cast("double")).alias("parse_rate"), F.avg((F.col("pest_id") == F.col("query_class_id")).cast("double")).alias("id_accuracy")), "parse_rate", "id_accuracy")


@query(f"WITH {OUTCOMES}, s AS (SELECT prompt_view, role = 'positive' AS t, evidence_present AS p FROM o WHERE parsed), c AS (SELECT prompt_view, count(*) FILTER (WHERE t AND coalesce(p, NOT t)) AS tp, count(*) FILTER (WHERE t AND NOT coalesce(p, NOT t)) AS fn, count(*) FILTER (WHERE NOT t AND coalesce(p, NOT t)) AS fp, count(*) FILTER (WHERE NOT t AND NOT coalesce(p, NOT t)) AS tn FROM s GROUP BY prompt_view), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0.0 END AS spec FROM c) SELECT prompt_view, tp, fn, fp, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1, round((recall + spec) / 2, 6) AS balanced_accuracy FROM r")
def i01_evidence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir).filter("parsed")
    return rounded(A.presence_metrics(o, F.col("role") == "positive", F.col("evidence_present"), "prompt_view"), "precision", "recall", "f1", "balanced_accuracy")


@query(_f1_sql(f"{OUTCOMES}, src AS (SELECT condition, query_class_id AS t, pest_id AS p FROM o)", "condition"))
def i02_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.macro_f1(outcomes(spark, sf_dir), "query_class_id", "pest_id", "condition"), "macro_f1")


@query(f"WITH {OUTCOMES}, src AS (SELECT query_class_id AS t, pest_id AS p FROM o WHERE role = 'positive'){_F1.format(keys='')}, l AS (SELECT DISTINCT class_id AS label FROM sample_targets) SELECT round(avg(coalesce(2.0::DOUBLE * tp / nullif(tn + pn, 0), 0.0)), 6) AS macro_f1, count(*) AS labels FROM l LEFT JOIN per USING (label)")
def i03_macro_f1_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "sample_targets").select("class_id")
    return rounded(A.macro_f1(outcomes(spark, sf_dir).filter("role = 'positive'"), "query_class_id", "pest_id", labels=labels), "macro_f1")


@query(_f1_sql(f"{OUTCOMES}, src AS (SELECT band, query_class_id AS t, pest_id AS p FROM o WHERE role = 'positive')", "band"))
def i04_macro_f1_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.macro_f1(outcomes(spark, sf_dir).filter("role = 'positive'"), "query_class_id", "pest_id", "band"), "macro_f1")


_BOX = "len(region) = 4 AND region[3] > region[1] AND region[4] > region[2] AND len(gt_bbox) = 4"
_INTER = "greatest(0.0, least(region[3], gt_bbox[3]) - greatest(region[1], gt_bbox[1])) * greatest(0.0, least(region[4], gt_bbox[4]) - greatest(region[2], gt_bbox[2]))"


@query(f"WITH {OUTCOMES}, s AS (SELECT source, coalesce(pest_id = query_class_id, false) AS hit, CASE WHEN {_BOX} THEN {_INTER} / ((region[3] - region[1]) * (region[4] - region[2]) + (gt_bbox[3] - gt_bbox[1]) * (gt_bbox[4] - gt_bbox[2]) - {_INTER}) ELSE 0.0 END AS iou, coalesce({_BOX} AND (region[1] + region[3]) / 2 BETWEEN gt_bbox[1] AND gt_bbox[3] AND (region[2] + region[4]) / 2 BETWEEN gt_bbox[2] AND gt_bbox[4], false) AS pointed, coalesce(evidence_present, false) AS present FROM o WHERE role = 'positive') SELECT source, count(*) AS n, round(avg(hit::INT::DOUBLE), 6) AS accuracy, round(avg(iou), 6) AS mean_iou, round(avg(pointed::INT::DOUBLE), 6) AS pointing, round(avg((hit AND present AND iou >= 0.5)::INT::DOUBLE), 6) AS supported FROM s GROUP BY source")
def i05_positive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = outcomes(spark, sf_dir).filter("role = 'positive'").withColumn("hit", F.coalesce(F.col("pest_id") == F.col("query_class_id"), F.lit(False))).withColumn("iou", iou(F.col("region"), F.col("gt_bbox")))
    supported = F.col("hit") & F.coalesce("evidence_present", F.lit(False)) & (F.col("iou") >= 0.5)
    return rounded(s.groupBy("source").agg(F.count("*").alias("n"), share(F.col("hit")).alias("accuracy"), F.avg("iou").alias("mean_iou"), share(centre_inside(F.col("region"), F.col("gt_bbox"))).alias("pointing"), share(supported).alias("supported")), "accuracy", "mean_iou", "pointing", "supported")


@query(f"WITH {OUTCOMES}, c AS (SELECT source, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM (SELECT source, role = 'positive' AS t, coalesce(evidence_present, role <> 'positive') AS p FROM o) GROUP BY source) SELECT source, tp, fn, fp, tn, round((coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0.0)) / 2, 6) AS balanced_accuracy FROM c")
def i06_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.presence_metrics(outcomes(spark, sf_dir), F.col("role") == "positive", F.col("evidence_present"), "source")
    return rounded(m.select("source", "tp", "fn", "fp", "tn", "balanced_accuracy"), "balanced_accuracy")


@query("WITH c AS (SELECT event_type, round(value, 1) AS s, count(*) FILTER (WHERE user_id % 2 = 0) AS p, count(*) FILTER (WHERE user_id % 2 = 1) AS n FROM events GROUP BY ALL), w AS (SELECT event_type, p, n, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT event_type, round(sum(p * (below + n / 2)) / (sum(p) * sum(n))::DOUBLE, 6) AS auroc FROM w GROUP BY event_type")
def i07_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.round("value", 1).alias("s"), (F.col("user_id") % 2 == 0).alias("label"))
    return rounded(auroc(e, "s", "label", "event_type"), "auroc")


@query(f"WITH {OUTCOMES}, fam AS (SELECT family_id, bool_or(role = 'positive' AND evidence_present AND pest_id = query_class_id) AS hit, bool_and(role = 'positive' OR coalesce(NOT evidence_present, false)) AS rejects, count(*) FILTER (WHERE role <> 'positive') AS nulls FROM o WHERE family_id IS NOT NULL GROUP BY family_id) SELECT count(*) AS families, count(*) FILTER (WHERE coalesce(hit, false)) AS originals_right, count(*) FILTER (WHERE coalesce(hit, false) AND rejects AND nulls > 0) AS strict_success, count(*) FILTER (WHERE NOT rejects) AS contradicted FROM fam")
def i08_family_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("role") == "positive"
    f = outcomes(spark, sf_dir).filter("family_id IS NOT NULL").groupBy("family_id").agg(F.bool_or(F.coalesce(pos & F.col("evidence_present") & (F.col("pest_id") == F.col("query_class_id")), F.lit(False))).alias("hit"), F.bool_and(pos | F.coalesce(~F.col("evidence_present"), F.lit(False))).alias("rejects"), F.count_if(~pos).alias("nulls"))
    return f.agg(F.count("*").alias("families"), F.count_if("hit").alias("originals_right"), F.count_if(F.col("hit") & F.col("rejects") & (F.col("nulls") > 0)).alias("strict_success"), F.count_if(~F.col("rejects")).alias("contradicted"))


@query(f"WITH {OUTCOMES}, v AS (SELECT source, avg((pest_id = query_class_id)::INT::DOUBLE) FILTER (WHERE prompt_view LIKE 'native%') AS native, avg((pest_id = query_class_id)::INT::DOUBLE) FILTER (WHERE prompt_view = 'canonical') AS canonical FROM o WHERE role = 'positive' GROUP BY source) SELECT source, round(abs(native - canonical), 6) AS prompt_gap FROM v")
def i09_prompt_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("pest_id") == F.col("query_class_id")).cast("double")
    v = outcomes(spark, sf_dir).filter("role = 'positive'").groupBy("source").agg(F.avg(F.when(F.col("prompt_view").like("native%"), hit)).alias("native"), F.avg(F.when(F.col("prompt_view") == "canonical", hit)).alias("canonical"))
    return rounded(v.select("source", F.abs(F.col("native") - F.col("canonical")).alias("prompt_gap")), "prompt_gap")


@query(f"WITH {OUTCOMES} SELECT condition, round(avg((pest_id IS NOT NULL)::INT::DOUBLE), 6) AS coverage, round(coalesce(avg((pest_id = query_class_id)::INT::DOUBLE), 0.0), 6) AS selective_accuracy, round(avg((role <> 'positive' AND pest_id IS NOT NULL)::INT::DOUBLE), 6) AS false_rate FROM o GROUP BY condition")
def i10_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.col("pest_id").isNotNull()
    return rounded(outcomes(spark, sf_dir).groupBy("condition").agg(share(named).alias("coverage"), share(F.col("pest_id") == F.col("query_class_id")).alias("selective_accuracy"), share((F.col("role") != "positive") & named).alias("false_rate")), "coverage", "selective_accuracy", "false_rate")


@query("WITH d AS (SELECT source, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT % 5 > 0 AS a, ('0x' || substr(sha256('b' || (doc_id // 2)::VARCHAR), 1, 15))::BIGINT % 7 > 0 AS b FROM documents), r AS (SELECT source, avg((a = b)::INT::DOUBLE) AS agree, avg(a::INT::DOUBLE) AS pa, avg(b::INT::DOUBLE) AS pb FROM d GROUP BY source) SELECT source, round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) >= 1 THEN 1.0 ELSE (agree - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 6) AS kappa FROM r")
def i11_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import hash_index

    d = table(spark, sf_dir, "documents").select("source", (hash_index(F.col("doc_id").cast("string")) % 5 > 0).alias("a"), (hash_index(F.concat(F.lit("b"), F.floor(F.col("doc_id") / 2).cast("string"))) % 7 > 0).alias("b"))
    return rounded(d.groupBy("source").agg(stats.kappa(F.col("a"), F.col("b")).alias("kappa")), "kappa")


@query("WITH r AS (SELECT l_returnflag, l_quantity AS x, round(l_extendedprice, -3) AS y FROM lineitem), k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2 AS ry FROM r) SELECT l_returnflag, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM k GROUP BY l_returnflag")
def i12_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.round("l_extendedprice", -3).alias("y"))
    return rounded(spearman(r, "x", "y", "l_returnflag"), "spearman")


@query("WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings), p AS (SELECT vec_id, list_transform(a, lambda x: x / list_aggregate(a, 'sum')) AS p FROM n) SELECT x.vec_id, round(sqrt(list_aggregate(list_transform(list_zip(x.p, y.p), lambda z: (sqrt(z[1]) - sqrt(z[2])) ** 2), 'sum')) / sqrt(2), 5) AS distance FROM p x JOIN p y ON y.vec_id = x.vec_id + 1")
def i13_hellinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    p = table(spark, sf_dir, "embeddings").select("vec_id", a.alias("a")).select("vec_id", F.transform("a", lambda x: x / F.aggregate("a", F.lit(0.0), lambda s, v: s + v)).alias("p"))
    other = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    return p.join(other, "vec_id").select("vec_id", F.round(stats.hellinger(F.col("p"), F.col("q")), 5).alias("distance"))


@query(f"WITH {OUTCOMES} SELECT condition, count(*) AS n, round(avg((NOT coalesce(NOT evidence_present, false))::INT::DOUBLE), 6) AS said_present, round(avg(coalesce(parsed AND pest_id IS NOT NULL, false)::INT::DOUBLE), 6) AS named_parsed, round(avg(coalesce(semantic AND pest_id IS NOT NULL, false)::INT::DOUBLE), 6) AS named_semantic FROM o WHERE role <> 'positive' GROUP BY condition")
def t05_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.null_rates(outcomes(spark, sf_dir).filter("role <> 'positive'"), "condition"), "said_present", "named_parsed", "named_semantic")


@query(f"WITH {FIRST} SELECT template_id, count(*) AS n, count(DISTINCT family_id) AS families FROM r GROUP BY template_id")
def e01_template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(spark, sf_dir).groupBy("template_id").agg(F.count("*").alias("n"), F.count_distinct("family_id").alias("families"))
