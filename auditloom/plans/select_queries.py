"""Queries of ranking, sampling by rank, quotas and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import select as S
from ..session import table
from .base import FIRST, OUTCOMES, PLAIN, first_rows, outcomes, plain_rows, rounded
from .registry import query

_RANK = "row_number() OVER (PARTITION BY {0} ORDER BY sha256('{1}/' || {2}), {2})"


@query(f"WITH {FIRST}, k AS (SELECT id, query_class_id, {_RANK.format('query_class_id', 'probe', 'id')} AS hash_rank FROM r WHERE role = 'positive') SELECT id, query_class_id FROM k WHERE hash_rank <= 12")
def f01_hash_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hash_top_k(first_rows(spark, sf_dir).filter("role = 'positive'").select("id", "query_class_id"), "id", ["query_class_id"], 12, "probe")


@query(f"WITH {FIRST}, t AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS turn FROM r WHERE source IS NOT NULL) SELECT id, source, turn::INT AS turn FROM t ORDER BY turn, source LIMIT 100")
def f02_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.round_robin(first_rows(spark, sf_dir).filter("source IS NOT NULL").select("id", "source"), "source", "id", 100)


@query(f"WITH {FIRST}, c AS (SELECT near_duplicate_component_id, min(query_class_id) AS query_class_id, arg_min(id, sha256('rep/' || id)) AS id FROM r WHERE role = 'positive' GROUP BY near_duplicate_component_id HAVING count(DISTINCT query_class_id) = 1) SELECT * FROM c")
def f03_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_rows(spark, sf_dir).filter("role = 'positive'")
    return S.representatives(rows, "near_duplicate_component_id", "query_class_id", "id", "rep").select("near_duplicate_component_id", "query_class_id", "id")


@query(f"WITH {FIRST}, k AS (SELECT id, query_class_id, {_RANK.format('query_class_id', 'fill', 'id')} AS hash_rank FROM r WHERE role = 'positive') SELECT id, query_class_id, hash_rank::INT AS hash_rank, CASE WHEN hash_rank <= 12 THEN 'train' WHEN hash_rank <= 15 THEN 'val' WHEN hash_rank <= 20 THEN 'dev' END AS split FROM k WHERE hash_rank <= 20")
def f04_split_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = S.hash_rank(first_rows(spark, sf_dir).filter("role = 'positive'").select("id", "query_class_id"), "id", ["query_class_id"], "fill")
    return S.split_fill(ranked, "hash_rank", [("train", 12), ("val", 3), ("dev", 5)])


@query(f"WITH {PLAIN}, c AS (SELECT component, min(query_class_id) AS class_id, bool_or(split = 'excluded') AS excluded FROM pl WHERE component IS NOT NULL GROUP BY component), k AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY sha256('mod/' || component), component) AS hash_rank FROM c) SELECT component, class_id, CASE WHEN coalesce(excluded, false) THEN 'excluded' WHEN (hash_rank - 1) % 10 = 0 THEN 'dev' WHEN (hash_rank - 1) % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM k")
def f05_modulo_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = plain_rows(spark, sf_dir).filter("component IS NOT NULL").groupBy("component").agg(F.min("query_class_id").alias("class_id"), F.coalesce(F.bool_or(F.col("split") == "excluded"), F.lit(False)).alias("excluded"))
    return S.modulo_split(S.hash_rank(c, "component", ["class_id"], "mod"), "hash_rank", F.col("excluded")).select("component", "class_id", "split")


@query("WITH c AS (SELECT query_class_id, count(*) AS n FROM provenance WHERE query_class_id IS NOT NULL GROUP BY query_class_id), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, query_class_id) - 1 AS i, count(*) OVER () AS a FROM c) SELECT query_class_id, n, CASE WHEN i::DOUBLE / a < 1.0::DOUBLE / 3 THEN 'head' WHEN i::DOUBLE / a < 2.0::DOUBLE / 3 THEN 'medium' ELSE 'tail' END AS band FROM k")
def f06_class_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.class_bands(table(spark, sf_dir, "provenance"), "query_class_id")


@query("WITH k AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey FROM k WHERE list_contains(list_transform(range(8), lambda j: (j * (n - 1)) // 7), i)")
def f07_even_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.even_picks(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], ["p_retailprice", "p_partkey"], 8).select("p_brand", "p_partkey")


@query("WITH c AS (SELECT p.query_class_id, k.band, count(*) AS n FROM provenance p JOIN class_catalog k ON k.class_id = p.query_class_id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY n DESC, query_class_id) AS place FROM c) SELECT query_class_id, band, n, place::INT AS place FROM r WHERE place <= 5")
def f08_top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = table(spark, sf_dir, "class_catalog").select(F.col("class_id").alias("query_class_id"), "band")
    counts = table(spark, sf_dir, "provenance").groupBy("query_class_id").agg(F.count("*").alias("n")).join(band, "query_class_id")
    return S.top_classes(counts, "query_class_id", "n", "band", 5).select("query_class_id", "band", "n", "place")


@query("WITH b AS (SELECT family_id, query_class_id AS pest_id, (gt_bbox[3] - gt_bbox[1]) * (gt_bbox[4] - gt_bbox[2]) AS area FROM manifest WHERE gt_bbox IS NOT NULL AND family_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY area DESC, pest_id) AS rn FROM b) SELECT family_id, pest_id FROM r WHERE rn = 1")
def f09_largest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "manifest").filter("gt_bbox IS NOT NULL AND family_id IS NOT NULL").select("family_id", F.array(F.struct(F.col("gt_bbox").alias("box"), F.col("query_class_id").alias("pest_id"))).alias("b"))
    return S.largest_box_per(boxes, "family_id", "b").select("family_id", "largest.pest_id")


@query("WITH e AS (SELECT id, feature_index, unnest(features)::DOUBLE AS v, generate_subscripts(features, 1) - 1 AS i FROM feature_rows), r AS (SELECT id, feature_index, i, v, row_number() OVER (PARTITION BY id, feature_index ORDER BY v DESC, i) AS rn FROM e) SELECT id, feature_index, max(i) FILTER (WHERE rn = 1)::INT AS top1, max(i) FILTER (WHERE rn = 2)::INT AS top2, round(max(v) FILTER (WHERE rn = 1), 6) AS confidence, round(max(v) FILTER (WHERE rn = 1) - max(v) FILTER (WHERE rn = 2), 6) AS margin FROM r GROUP BY id, feature_index")
def f10_top_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "feature_rows").select("id", "feature_index", S.top_two(F.col("features")).alias("t")).select("id", "feature_index", "t.*")
    return rounded(t, "confidence", "margin")


@query("WITH e AS (SELECT vec_id, label, unnest(embedding[1:10])::DOUBLE AS score, generate_subscripts(embedding[1:10], 1) - 1 AS cand FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cand) AS rk FROM e), t AS (SELECT vec_id, min(rk) FILTER (WHERE cand = label)::INT AS truth_rank FROM r GROUP BY vec_id) SELECT vec_id, truth_rank, coalesce(truth_rank <= 1, false) AS top1, coalesce(truth_rank <= 3, false) AS top3, coalesce(truth_rank <= 5, false) AS top5 FROM t")
def f11_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 10)).alias("cand", "score"))
    return S.ranked_candidates(e.withColumn("score", F.col("score").cast("double")), "vec_id", "cand", "score", "label")


@query(f"WITH {OUTCOMES}, c AS (SELECT id, CASE WHEN NOT parsed THEN 'syntax' WHEN NOT schema_ok THEN 'schema' WHEN role <> 'positive' AND evidence_present THEN 'false_alarm' WHEN role = 'positive' AND NOT evidence_present THEN 'miss' END AS case_type FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY id) AS place FROM c WHERE case_type IS NOT NULL) SELECT id, case_type, place::INT AS place FROM r WHERE place <= 5")
def f12_first_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.when(~F.col("parsed"), "syntax").when(~F.col("schema_ok"), "schema").when((F.col("role") != "positive") & F.col("evidence_present"), "false_alarm").when((F.col("role") == "positive") & ~F.col("evidence_present"), "miss")
    return S.first_per_case(outcomes(spark, sf_dir), case, ["id"]).select("id", "case_type", "place")


@query(f"WITH {FIRST}, e AS (SELECT unnest(string_split(array_to_string(present_class_ids, '|'), '|'))::INT AS c, source_image_sha256 AS sha FROM r WHERE source_image_sha256 IS NOT NULL) SELECT c, min(sha) AS sha FROM e GROUP BY c")
def f13_class_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.col("present_class_ids").cast("array<string>"), "|")
    return first_rows(spark, sf_dir).filter("source_image_sha256 IS NOT NULL").select(F.explode(F.split(joined, r"\|")).alias("c"), F.col("source_image_sha256").alias("sha")).select(F.col("c").cast("int").alias("c"), "sha").groupBy("c").agg(F.min("sha").alias("sha"))


@query("WITH p AS (SELECT class_id, row_number() OVER (ORDER BY class_id) - 1 AS i, count(*) OVER () AS n FROM class_catalog) SELECT s.step, ['positive', 'semantic_negative', 'visual_counterfactual'][(s.step % 3) + 1] AS schedule_role, p.class_id FROM (SELECT unnest(range(1000)) AS step) s JOIN p ON p.i = (s.step // 3) % p.n")
def f14_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "class_catalog").select("class_id")
    return S.cyclic_schedule(pool, ["class_id"], 1000, ("positive", "semantic_negative", "visual_counterfactual")).select("step", "schedule_role", "class_id")


_QUOTAS = {"head": 2, "medium": 1, "tail": 1}
_PASSES = f"""WITH {PLAIN}, x AS (SELECT id, min(family_id) AS family_id, min(role) AS role, min(query_class_id) AS q FROM pl WHERE split = 'train' AND id IS NOT NULL AND family_id IS NOT NULL GROUP BY id),
u AS (SELECT x.id, x.family_id, x.role, y.c, band FROM x JOIN (SELECT family_id, min(q) AS c FROM x WHERE role = 'positive' GROUP BY family_id) y USING (family_id) JOIN class_catalog ON class_id = y.c),
w AS (SELECT c, band, family_id FROM u GROUP BY c, band, family_id HAVING count(DISTINCT role) = 3),
k AS (SELECT c, row_number() OVER (PARTITION BY band ORDER BY sha256('class-' || band || '/' || c), c) AS n, band FROM (SELECT c, band FROM w GROUP BY c, band HAVING count(*) >= 2)),
p AS (SELECT c FROM k WHERE n <= CASE band WHEN 'head' THEN 2 ELSE 1 END),
f AS (SELECT family_id FROM (SELECT family_id, row_number() OVER (PARTITION BY c ORDER BY sha256('family/' || family_id), family_id) AS n FROM w WHERE c IN (SELECT c FROM p)) WHERE n <= 2),
l AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY sha256('exposure/' || id), id) - 1 AS i, count(*) OVER (PARTITION BY role) AS n FROM u WHERE family_id IN (SELECT family_id FROM f)),
s AS (SELECT step, ['positive', 'semantic_negative', 'visual_counterfactual'][step % 3 + 1] AS role, step // 3 AS turn FROM (SELECT unnest(range(512)) AS step))
SELECT s.step, s.role AS schedule_role, l.id, l.family_id, l.c, l.band, substr(sha256('exposure|' || s.step || '|' || l.id), 1, 32) AS exposure_id FROM s JOIN l ON l.role = s.role AND l.i = s.turn % l.n"""


@query(_PASSES)
def f14_class_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole families of a quota of classes per band, passed through role by role to 512 exposures."""
    bands = table(spark, sf_dir, "class_catalog").select(F.col("class_id").alias("query_class_id"), "band")
    rows = plain_rows(spark, sf_dir).filter("split = 'train' AND id IS NOT NULL AND family_id IS NOT NULL").groupBy("id").agg(F.min("family_id").alias("family_id"), F.min("role").alias("role"), F.min("query_class_id").alias("q"))
    of_family = rows.filter("role = 'positive'").groupBy("family_id").agg(F.min("q").alias("query_class_id")).join(bands, "query_class_id").select("family_id", F.col("query_class_id").alias("c"), "band")
    return S.class_quota_schedule(rows.drop("q").join(of_family, "family_id"), "family_id", "c", "band", "role", "id", _QUOTAS, 2, ("positive", "semantic_negative", "visual_counterfactual"), 512, strict=False)


@query()
def f15_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.python_random_sample(table(spark, sf_dir, "feature_rows").filter("class_id IS NOT NULL"), "class_id", "id", 5, 17)


@query("SELECT id, row_number() OVER (PARTITION BY family_id ORDER BY condition, id, prompt_view, role) AS place FROM (SELECT DISTINCT family_id, condition, id, prompt_view, role FROM manifest)")
def f16_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    m = table(spark, sf_dir, "manifest").select("family_id", "condition", "id", "prompt_view", "role").distinct()
    return m.select("id", F.row_number().over(Window.partitionBy("family_id").orderBy("condition", "id", "prompt_view", "role")).cast("long").alias("place"))


@query(f"WITH {FIRST}, k AS (SELECT id, role, {_RANK.format('role', 'smoke', 'id')} AS k FROM r), p AS (SELECT id, role FROM k WHERE (role = 'positive' AND k <= 24) OR (role = 'semantic_negative' AND k <= 12)) SELECT id, role, row_number() OVER (ORDER BY sha256('smoke1/' || id), id) AS place FROM p")
def f17_smoke_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = S.hash_rank(first_rows(spark, sf_dir).select("id", "role"), "id", ["role"], "smoke", "k").filter("(role = 'positive' AND k <= 24) OR (role = 'semantic_negative' AND k <= 12)").drop("k")
    return S.hash_rank(ranked.withColumn("one", F.lit(1)), "id", ["one"], "smoke1", "place").select("id", "role", F.col("place").cast("long").alias("place"))


@query(f"WITH {OUTCOMES}, s AS (SELECT source, round(avg(semantic::INT::DOUBLE), 6) AS sound, count(*) AS n FROM o WHERE source IS NOT NULL GROUP BY source) SELECT * FROM s ORDER BY sound DESC, n DESC, source LIMIT 1")
def f18_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = outcomes(spark, sf_dir).filter("source IS NOT NULL").groupBy("source").agg(F.round(F.avg(F.col("semantic").cast("double")), 6).alias("sound"), F.count("*").alias("n"))
    return S.winner(s, [F.desc("sound"), F.desc("n"), F.col("source")])


@query("WITH f AS (SELECT DISTINCT class_name || CASE WHEN f.class_id % 2 = 0 THEN '-lavra' ELSE '' END AS klass, image AS path FROM feature_rows f JOIN class_catalog c USING (class_id)), k AS (SELECT klass, path, row_number() OVER (PARTITION BY klass ORDER BY sha256('cap/' || path), path) AS place FROM f) SELECT klass, path, place::INT AS place, CASE WHEN regexp_matches(replace(lower(klass), 'lavra', 'larva'), '^(.*)-([^-]+)$') THEN regexp_extract(replace(lower(klass), 'lavra', 'larva'), '^(.*)-([^-]+)$', 1) ELSE lower(klass) END AS species, nullif(regexp_extract(replace(lower(klass), 'lavra', 'larva'), '^(.*)-([^-]+)$', 2), '') AS stage FROM k WHERE place <= 7")
def f19_capped_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "class_catalog").select("class_id", "class_name")
    files = table(spark, sf_dir, "feature_rows").join(names, "class_id").select(F.concat("class_name", F.when(F.col("class_id") % 2 == 0, "-lavra").otherwise("")).alias("klass"), F.col("image").alias("path")).distinct()
    return S.capped_taxonomy(files, "klass", "path", 7, "cap")


@query("WITH s AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS s FROM part), t AS (SELECT p_partkey, p_brand, s, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('half/' || p_partkey), p_partkey) AS h FROM s WHERE s > 5) SELECT p_partkey, p_brand, 'score' AS picked FROM s WHERE s <= 5 UNION ALL SELECT p_partkey, p_brand, 'sample' FROM t WHERE h <= 5")
def f20_half_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.half_by_score(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice")], "p_partkey", 10, "half").select("p_partkey", "p_brand", "picked")
