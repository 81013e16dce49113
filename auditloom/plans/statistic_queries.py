"""Queries of resampling, exact tests, probes and calibration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import bootstrap as B
from ..operators import probe as P
from ..operators.rank import auroc
from ..session import checkpoint, table
from .base import OUTCOMES, outcomes, rounded
from .join_queries import _image as image
from .registry import query

REPS = 1000


def _with_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with the family as their cluster; where the manifest names none, that of the source row or its image, else the id alone."""
    rows = table(spark, sf_dir, "provenance").select(F.col("id").alias("source_id"), "family_id", image("source_image_id").alias("image"))
    by_image = rows.filter("image IS NOT NULL").groupBy("image").agg(F.min("family_id").alias("image_family"))
    known = rows.groupBy("source_id").agg(F.min("family_id").alias("source_family"), F.min("image").alias("image")).join(by_image, "image", "left").select("source_id", F.coalesce("source_family", "image_family").alias("source_family"))
    lost = table(spark, sf_dir, "manifest").groupBy("id").agg(F.min("family_id").alias("f"), F.min("source_id").alias("source_id")).filter("f IS NULL").join(known, "source_id").select("id", "source_family")
    return outcomes(spark, sf_dir).join(lost, "id", "left").withColumn("cluster", F.coalesce("family_id", "source_family", F.concat(F.lit("id/"), "id")))


@query()
def j01_cluster_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rate_interval(_with_cluster(spark, sf_dir), "cluster", F.col("parsed"), "condition", reps=REPS, seed=17)


@query()
def j02_paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.paired_delta_interval(_with_cluster(spark, sf_dir), "cluster", F.col("parsed"), F.col("schema_ok"), REPS, 29)


@query()
def j03_pooled_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.macro_f1_interval(_with_cluster(spark, sf_dir).filter("role = 'positive'"), "cluster", "query_class_id", "pest_id", REPS, 43)


@query()
def j04_several_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = checkpoint(_with_cluster(spark, sf_dir).select("cluster", "parsed", "semantic"))
    one = lambda name, flag: B.rate_interval(o, "cluster", flag, reps=REPS, seed=5).withColumn("statistic", F.lit(name))
    return one("parsed", F.col("parsed")).unionByName(one("semantic", F.col("semantic")))


@query()
def j05_false_alarm_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    nulls = _with_cluster(spark, sf_dir).filter("role <> 'positive'")
    sums = nulls.groupBy("id").agg(F.count_if("evidence_present").alias("h"), F.count("*").alias("n"))
    drawn = B.poisson_draws(sums, "id", REPS, 3).groupBy("rep").agg((F.sum(F.expr("h * weight")) / F.sum(F.expr("n * weight"))).alias("rate"))
    return B.interval(drawn, "rate")


@query()
def j06_two_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _with_cluster(spark, sf_dir)
    return B.two_population_interval(o.filter("role = 'positive'"), o.filter("role <> 'positive'"), "cluster", F.col("parsed"), F.col("parsed"), REPS, 11)


def _spread(d: pd.DataFrame) -> float:
    return float(d["value"].quantile(0.9) - d["value"].quantile(0.1))


@query()
def j07_any_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = B.bootstrap_statistic(table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("value")), ["value"], _spread, REPS, 7)
    return B.interval(values, "value")


@query(f"WITH {OUTCOMES}, c AS (SELECT condition, count(*) FILTER (WHERE parsed AND NOT coalesce(evidence_present, false)) AS b, count(*) FILTER (WHERE NOT parsed OR (evidence_present AND NOT semantic)) AS c FROM o GROUP BY condition) SELECT condition, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(least(b, c) + 1) t(i))) END, 6) AS p_value FROM c")
def j08_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("parsed") & ~F.coalesce("evidence_present", F.lit(False))
    c = ~F.col("parsed") | F.coalesce(F.col("evidence_present") & ~F.col("semantic"), F.lit(False))
    counts = outcomes(spark, sf_dir).groupBy("condition").agg(F.count_if(b).alias("b"), F.count_if(c).alias("c"))
    return rounded(counts.withColumn("p_value", stats.exact_mcnemar(F.col("b"), F.col("c"))), "p_value")


@query()
def j09_exact_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = outcomes(spark, sf_dir).groupBy("source").agg(F.count_if("parsed").alias("k"), F.count("*").alias("n"))
    return rounded(counts.withColumn("ci", stats.exact_interval(F.col("k"), F.col("n"))).select("source", "k", "n", "ci.low", "ci.high"), "low", "high")


_DOC = "d AS (SELECT doc_id, text, (source = 'scout_app')::INT AS label FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)"


@query(f"WITH {_DOC}, n AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM d WHERE doc_id % 5 <> 0), w AS (SELECT doc_id, label, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS word FROM d), c AS (SELECT word, count(*) FILTER (WHERE label = 1) AS c1, count(*) FILTER (WHERE label = 0) AS c0 FROM w WHERE doc_id % 5 <> 0 GROUP BY word), p AS (SELECT word, ln((c1 + 1)::DOUBLE / (n1 + 2)) - ln((c0 + 1)::DOUBLE / (n0 + 2)) - ln(1 - (c1 + 1)::DOUBLE / (n1 + 2)) + ln(1 - (c0 + 1)::DOUBLE / (n0 + 2)) AS delta, ln(1 - (c1 + 1)::DOUBLE / (n1 + 2)) - ln(1 - (c0 + 1)::DOUBLE / (n0 + 2)) AS absent FROM c, n), b AS (SELECT (SELECT sum(absent) FROM p) + ln((n1 + 1)::DOUBLE / (n0 + 1)) AS base FROM n), s AS (SELECT doc_id, sum(delta) AS s FROM w JOIN p USING (word) WHERE doc_id % 5 = 0 GROUP BY doc_id) SELECT d.doc_id, round(coalesce(s, 0.0) + base, 4) AS log_odds, (coalesce(s, 0.0) + base >= 0)::INT AS predicted FROM d LEFT JOIN s USING (doc_id), b WHERE d.doc_id % 5 = 0")
def k01_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", (F.col("source") == "scout_app").cast("int").alias("label"))
    return rounded(P.naive_bayes(d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 5 = 0"), "doc_id", "text", "label"), "log_odds", places=4)


@query()
def k02_shortcut_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "provenance").select("id", "template_id", (F.col("role") == "positive").cast("double").alias("label"), F.concat_ws(" ", "template_id", "transform_id", F.col("query_class_id").cast("string")).alias("text")).dropDuplicates(["id"])
    scored = P.tfidf_logistic(m.filter("id < '8'"), m.filter("id >= '8'"), "id", "text", "label").join(m.select("id", "label"), "id")
    return auroc(scored.withColumn("label", F.col("label") == 1.0).withColumn("score", F.round("score", 9)), "score", "label")


@query()
def k03_linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "feature_rows").filter("class_id IS NOT NULL").withColumn("s", F.lower(F.trim("probe_split"))).dropDuplicates(["id"])
    probe = P.linear_probe(f.filter("s = 'probe_train'"), f.filter("s IN ('probe_val', 'probe_test')"), "id", "features", "class_id")
    truth = f.select("id", "class_id", "s")
    return probe.join(truth, "id").groupBy("s").agg(F.avg((F.col("predicted") == F.col("class_id")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


@query()
def k03_probe_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on probe_test of a probe trained on permuted labels and of guesses in the training shares, per seed."""
    f = table(spark, sf_dir, "feature_rows").filter("class_id IS NOT NULL AND features IS NOT NULL").withColumn("s", F.lower(F.trim("probe_split"))).groupBy("id").agg(F.min(F.struct("batch_no", "feature_index", "s", "class_id", "features")).alias("r")).select("id", "r.s", "r.class_id", "r.features")
    f = checkpoint(f)
    return P.probe_controls(f.filter("s = 'probe_train'"), f.filter("s = 'probe_test'"), "id", "features", "class_id", (17, 29, 43))


@query()
def k04_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double"))).alias("w"))
    p = e.select("label", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, v: a + v)).alias("p"))
    return P.fit_temperature(p, "p", "label")


@query("WITH s AS (SELECT least(value / 100, 1.0) AS score, user_id % 2 = 0 AS y FROM events), t AS (SELECT unnest(range(101)) AS i), c AS (SELECT i, count(*) FILTER (WHERE y AND floor(round(score * 100, 9)) >= i) AS tp, count(*) FILTER (WHERE NOT y AND floor(round(score * 100, 9)) >= i) AS fp, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM s, t GROUP BY i) SELECT i / 100.0::DOUBLE AS threshold, round((tp::DOUBLE / p + (n - fp)::DOUBLE / n) / 2, 6) AS balanced_accuracy FROM c ORDER BY (tp::DOUBLE / p + (n - fp)::DOUBLE / n) / 2 DESC, i LIMIT 1")
def k05_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select(F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (F.col("user_id") % 2 == 0).alias("y"))
    return rounded(P.best_threshold(s, "score", F.col("y")), "balanced_accuracy")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE user_id % 2 = 0) SELECT event_type, value AS threshold, n AS positives FROM r WHERE r = greatest(n - ceil(n * 0.9::DOUBLE)::BIGINT + 1, 1)")
def k06_recall_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.recall_threshold(table(spark, sf_dir, "events"), "value", F.col("user_id") % 2 == 0, 0.9, "event_type")


@query()
def k07_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "feature_rows").filter("class_id IS NOT NULL").withColumn("s", F.lower(F.trim("probe_split"))).dropDuplicates(["id"])
    out = None
    for name, vector in (("first_half", F.slice("features", 1, 8)), ("whole", F.col("features"))):
        v = f.withColumn("v", vector)
        probe = P.linear_probe(v.filter("s = 'probe_train'"), v.filter("s = 'probe_test'"), "id", "v", "class_id").join(f.select("id", "class_id"), "id")
        one = probe.agg(F.avg((F.col("predicted") == F.col("class_id")).cast("double")).alias("accuracy")).withColumn("representation", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT m.label, round(sum(m.m / n.n) , 5) AS total, count(*) AS width FROM m JOIN n USING (label) GROUP BY m.label")
def k08_mean_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = P.mean_pooled(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return pooled.select("label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("embedding").cast("long").alias("width"))


@query("WITH p AS (SELECT l_orderkey, avg(l_extendedprice) AS m FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey) SELECT round(avg(m), 4) AS batch_loss, count(*) AS examples FROM p")
def k09_example_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.example_mean_loss(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", F.col("l_returnflag") != "R"), "batch_loss", places=4)


@query("SELECT p_partkey, list_transform(range(p_size % 5 + 2), lambda i: CASE WHEN i * 5 < p_size % 9 + 7 AND p_size % 9 + 3 < i * 5 + 5 THEN 'head' WHEN i * 5 < p_size % 9 + 12 AND p_size % 9 + 8 < i * 5 + 5 THEN 'tail' ELSE 'other' END) AS groups FROM part")
def k10_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = F.transform(F.sequence(F.lit(0), F.col("p_size") % 5 + 1), lambda i: F.struct((i * 5).alias("start"), (i * 5 + 5).alias("end")))
    span = lambda name, a, b: F.struct(F.lit(name).alias("name"), (F.col("p_size") % 9 + a).alias("start"), (F.col("p_size") % 9 + b).alias("end"))
    return table(spark, sf_dir, "part").select("p_partkey", P.token_groups(offsets, F.array(span("head", 3, 7), span("tail", 8, 12))).alias("groups"))


def _echo(prompts: list[str]) -> list[str]:
    return [f"answer to {p}" for p in prompts]


@query("SELECT class_id, 'answer to ' || class_name AS raw_text FROM class_catalog")
def k11_model_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.predicted_with(table(spark, sf_dir, "class_catalog"), "class_id", "class_name", _echo)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images made of the embeddings' numbers, eight by eight, enlarged four times."""
    e = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.round(v.cast("double") * 400 + 128).cast("int"))))
    line = lambda y: F.flatten(F.transform(F.slice("e", y * 8 + 1, F.lit(8)), lambda v: F.array_repeat(v, 4)))
    wide = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.flatten(F.array_repeat(line(y), 4))))
    text = F.array_join(F.transform("w", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")
    return table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")).select("vec_id", wide.alias("w")).select("vec_id", F.lit(32).alias("width"), F.lit(32).alias("height"), F.unhex(text).alias("data"))


@query()
def k12_perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in ("blank", "blur", "shuffle", "noise"):
        one = P.perturbed(_images(spark, sf_dir), "vec_id", kind).select("vec_id", F.lit(kind).alias("kind"), F.sha2("data", 256).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def h05_perceptual_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.perceptual_hashes(_images(spark, sf_dir), "vec_id")


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT a.vec_id, round(corr(a.v, b.v), 6) AS correlation FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id")
def h07_structural_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    b = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.posexplode("embedding").alias("i", "y"))
    c = a.join(b, ["vec_id", "i"]).groupBy("vec_id").agg(F.corr(F.col("x").cast("double"), F.col("y").cast("double")).alias("r"), F.bool_and(F.col("x") == F.col("y")).alias("same"))
    return c.select("vec_id", F.round(F.coalesce("r", F.col("same").cast("double")), 6).alias("correlation"))


@query()
def h30_h31_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geometry import mask_stats

    return mask_stats(_images(spark, sf_dir).withColumnRenamed("data", "mask"), "vec_id", threshold=160)
