"""Queries of the joins, set operations, graphs and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import expanded
from ..functions.hashing import hash_bucket
from ..functions.stats import dot
from ..functions import spelling
from ..operators import gates, graph
from ..operators import outcomes as O
from ..operators import joins as J
from ..session import table
from ..sources import sinks
from .base import ANSWERS, FIRST, MANIFEST, OUTCOMES, PLAIN, SQL_ID, first_rows, latest_answers, manifest_rows, outcomes, plain_rows, rounded
from .registry import query

_IMAGE = "nullif(regexp_extract(upper({0}), '(?:^|[^0-9A-Z])(IP[0-9]{{9}})', 1), '')"


def _image(c: str) -> F.Column:
    found = F.regexp_extract(F.upper(c), r"(?:^|[^0-9A-Z])(IP[0-9]{9})", 1)
    return F.when(found != "", found)


@query("SELECT o_orderkey, o_custkey, n FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) USING (o_orderkey) WHERE true")
def d01_strict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    held = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines.select("o_orderkey"), "o_orderkey", "left_semi")
    return J.strict_join(held, lines, "o_orderkey")


@query(f"WITH {MANIFEST}, {ANSWERS} SELECT id, n_left, n_right FROM (SELECT coalesce(x.id, y.id) AS id, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM (SELECT id, count(*) AS n_left FROM manifest GROUP BY id) x FULL JOIN (SELECT id, count(*) AS n_right FROM predictions GROUP BY id) y ON x.id = y.id) WHERE n_left <> 1 OR n_right <> 1")
def d01_key_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.key_gaps(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "predictions"), "id")


_SEED = "s AS (SELECT query_class_id, split_part(source, '_', 2) AS seed, split_part(source, '_', 1) AS model, count(*) AS n, count(*) FILTER (WHERE parsed) AS good FROM o WHERE source IS NOT NULL GROUP BY ALL)"


@query(f"WITH {OUTCOMES}, {_SEED}, c AS (SELECT query_class_id || '/' || seed AS cell, model, n, good FROM s) SELECT b.cell, b.n AS base_n, b.good AS base_good, m.n AS model_n, m.good AS model_good FROM c b JOIN c m USING (cell) WHERE b.model = 'baseline' AND m.model = 'control'")
def d02_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir).filter("source IS NOT NULL").groupBy(F.concat_ws("/", F.col("query_class_id").cast("string"), F.split("source", "_")[1]).alias("cell"), F.split("source", "_")[0].alias("model")).agg(F.count("*").alias("n"), F.count_if("parsed").alias("good"))
    return J.paired(o.filter("model = 'baseline'"), o.filter("model = 'control'"), "cell", ["n", "good"], ("base", "model"))


@query(f"WITH {OUTCOMES}, w AS (SELECT family_id, max(CASE WHEN condition = 'original' THEN parsed::INT END) AS original, max(CASE WHEN condition = 'blank' THEN parsed::INT END) AS blank, max(CASE WHEN condition = 'blur' THEN parsed::INT END) AS blur, max(CASE WHEN condition = 'shuffle' THEN parsed::INT END) AS shuffle FROM o GROUP BY family_id) SELECT * FROM w WHERE original IS NOT NULL AND blank IS NOT NULL AND blur IS NOT NULL AND shuffle IS NOT NULL")
def d03_complete_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.complete_matrix(outcomes(spark, sf_dir), "family_id", "condition", ["original", "blank", "blur", "shuffle"], F.col("parsed").cast("int"))


@query("WITH d AS (SELECT class_id, min(trim(lower(class_band))) AS lo, max(trim(lower(class_band))) AS hi FROM feature_rows WHERE class_band IS NOT NULL GROUP BY class_id) SELECT c.class_id, CASE WHEN lo = hi THEN lo END AS band_seen, CASE WHEN lo IS NULL THEN 'missing' WHEN lo <> hi THEN 'conflict' ELSE 'ok' END AS lookup FROM class_catalog c LEFT JOIN d USING (class_id)")
def d05_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "feature_rows").filter("class_band IS NOT NULL").select("class_id", F.trim(F.lower("class_band")).alias("band_seen"))
    return J.lookup_join(table(spark, sf_dir, "class_catalog").select("class_id"), seen, "class_id", ["band_seen"])


@query("SELECT DISTINCT id FROM manifest WHERE id NOT IN (SELECT id FROM predictions WHERE id IS NOT NULL)")
def d06_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pending(table(spark, sf_dir, "manifest").select("id"), table(spark, sf_dir, "predictions"), "id")


@query(f"WITH {PLAIN} SELECT id, CASE WHEN image IN (SELECT source_image_id FROM prior_positives) THEN 'image' WHEN digest IN (SELECT source_image_sha256 FROM prior_positives) THEN 'digest' WHEN component IN (SELECT near_duplicate_component_id FROM prior_positives) THEN 'component' END AS excluded_by FROM pl")
def d07_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = table(spark, sf_dir, "prior_positives")
    sets = {"image": ("image", prior.select(spelling.plain_image(F.col("source_image_id")).alias("image"))), "digest": ("digest", prior.select(spelling.plain_digest(F.col("source_image_sha256")).alias("digest"))), "component": ("component", prior.select(spelling.plain_component(F.col("near_duplicate_component_id")).alias("component")))}
    return J.exclusion_reasons(plain_rows(spark, sf_dir), sets).select("id", "excluded_by")


@query("SELECT id, source_id FROM manifest WHERE source_id IN (SELECT id FROM feature_rows)")
def d08_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "feature_rows").select(F.col("id").alias("source_id"))
    return table(spark, sf_dir, "manifest").select("id", "source_id").join(kept, "source_id", "left_semi").select("id", "source_id")


@query("WITH f AS (SELECT DISTINCT family_id, query_class_id FROM provenance WHERE role = 'positive' AND family_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_class_id ORDER BY family_id) - 1 AS i, count(*) OVER (PARTITION BY query_class_id) AS n, count(*) OVER () AS a FROM f), z AS (SELECT query_class_id, n, coalesce(sum(n) OVER (ORDER BY query_class_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (SELECT DISTINCT query_class_id, n FROM r)), g AS (SELECT r.*, z.off, z.off + r.i AS g FROM r JOIN z USING (query_class_id)), d AS (SELECT family_id, t.draw, off, n, ('0x' || substr(sha256('partner/' || family_id || '/' || t.draw), 1, 15))::BIGINT % (a - n) AS k FROM g, (SELECT unnest([1, 2]) AS draw) t WHERE a > n) SELECT d.family_id, d.draw::INT AS draw, g.family_id AS partner, g.query_class_id AS partner_class FROM d JOIN g ON g.g = CASE WHEN d.k >= d.off THEN d.k + d.n ELSE d.k END")
def d09_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.partners(table(spark, sf_dir, "provenance").filter("role = 'positive'"), "family_id", "query_class_id")


@query("SELECT p_partkey, c AS condition, s::INT AS seed FROM part, (SELECT unnest(['blank', 'blur', 'shuffle']) AS c), (SELECT unnest([17, 29, 43]) AS s)")
def d10_d11_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.each_with(J.each_with(table(spark, sf_dir, "part").select("p_partkey"), "condition", ["blank", "blur", "shuffle"]), "seed", [17, 29, 43])


def _sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs of all 64 numbers as a hash."""
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, 1).bitwiseOR(F.when(v > 0, 1).otherwise(0).cast("long")))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("part"), bits.alias("h"))


@query("WITH h AS (SELECT vec_id, label % 2 AS part, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda v: (v > 0)::HUGEINT)), lambda a, b: a * 2 + b) AS h FROM embeddings), c AS (SELECT h, part, min(vec_id) AS cls FROM h GROUP BY h, part) SELECT a.cls AS \"left\", b.cls AS \"right\", bit_count(xor(a.h, b.h))::INT AS distance FROM c a JOIN c b ON a.cls < b.cls AND a.part <> b.part WHERE bit_count(xor(a.h, b.h)) <= 4")
def d12_near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal hashes over all 64 signs, at distance up to 4."""
    return J.near_hash_pairs(_sign_hashes(spark, sf_dir), "vec_id", "h", "part")[0]


@query("WITH h AS (SELECT vec_id, label % 2 AS part, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda v: (v > 0)::HUGEINT)), lambda a, b: a * 2 + b) AS h FROM embeddings), c AS (SELECT h, part, min(vec_id) AS cls, count(*) AS n FROM h GROUP BY h, part), l AS (SELECT a.cls, sum(b.n) AS links FROM c a JOIN c b ON a.part <> b.part AND bit_count(xor(a.h, b.h)) <= 4 GROUP BY a.cls) SELECT h.vec_id, c.cls AS class, coalesce(l.links, 0)::BIGINT AS links FROM h JOIN c USING (h, part) LEFT JOIN l ON l.cls = c.cls")
def d12_near_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its class of equal hashes and the number of rows linked to it: all 64 signs, distance up to 4."""
    return J.near_hash_members(_sign_hashes(spark, sf_dir), "vec_id", "h", "part")


@query(f"WITH q AS (SELECT {_IMAGE.format('left_id')} AS l, {_IMAGE.format('right_id')} AS r, phash_distance, structural_correlation FROM pair_matches), k AS (SELECT DISTINCT {_IMAGE.format('source_image_id')} AS i FROM provenance) SELECT count(*) AS pairs, count(*) FILTER (WHERE x.i IS NULL OR y.i IS NULL) AS unresolved, count(*) FILTER (WHERE phash_distance <= 8 AND structural_correlation >= 0.9) AS confident FROM q LEFT JOIN k x ON x.i = q.l LEFT JOIN k y ON y.i = q.r")
def d13_reviewed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "provenance").select(_image("source_image_id").alias("i")).filter("i IS NOT NULL").distinct()
    q = table(spark, sf_dir, "pair_matches").select(_image("left_id").alias("l"), _image("right_id").alias("r"), "phash_distance", "structural_correlation")
    j = q.join(known.select(F.col("i").alias("l"), F.lit(True).alias("has_l")), "l", "left").join(known.select(F.col("i").alias("r"), F.lit(True).alias("has_r")), "r", "left")
    return j.agg(F.count("*").alias("pairs"), F.count_if(F.col("has_l").isNull() | F.col("has_r").isNull()).alias("unresolved"), F.count_if((F.col("phash_distance") <= 8) & (F.col("structural_correlation") >= 0.9)).alias("confident"))


_DOT = "list_aggregate(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE), 'sum')"


@query(f"WITH s AS (SELECT q.vec_id, c.vec_id AS neighbour, c.label AS neighbour_label, {_DOT.format('q.embedding', 'c.embedding')} / sqrt({_DOT.format('q.embedding', 'q.embedding')} * {_DOT.format('c.embedding', 'c.embedding')}) AS sim FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, neighbour) AS rank FROM s) SELECT vec_id, rank::INT AS rank, neighbour, neighbour_label, round(sim, 6) AS similarity FROM r WHERE rank <= 3")
def d14_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return rounded(J.nearest_rows(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", "label", k=3), "similarity")


@query("WITH n AS (SELECT a.vec_id, list_concat(a.embedding, b.embedding) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id) SELECT vec_id, len(v) AS width, round(list_aggregate(list_transform(v, lambda x: (x::DOUBLE / sqrt(2)) ** 2), 'sum'), 4) AS norm2 FROM n")
def d15_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return J.concat_features(e, e, "vec_id", "embedding").select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(dot(F.col("embedding"), F.col("embedding")), 4).alias("norm2"))


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'REJECT' ELSE 'PASS' END END AS a, CASE WHEN doc_id % 5 = 0 THEN 'REJECT' ELSE 'PASS' END AS b, CASE WHEN doc_id % 30 = 3 THEN 'PASS' END AS z FROM documents) SELECT doc_id, a AS decision_a, b AS decision_b, z AS adjudicated, CASE WHEN a IS NULL THEN 'missing' WHEN a = b AND z IS NOT NULL THEN 'extra' WHEN a = b THEN 'agreed' WHEN z IS NOT NULL THEN 'adjudicated' ELSE 'open' END AS state FROM d")
def d16_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    part = lambda c, where: d.filter(where).select("doc_id", c.alias("decision"))
    a = part(F.when(F.col("doc_id") % 3 == 0, "REJECT").otherwise("PASS"), "doc_id % 11 <> 0")
    b = part(F.when(F.col("doc_id") % 5 == 0, "REJECT").otherwise("PASS"), "true")
    return J.review_join(d, a, b, part(F.lit("PASS"), "doc_id % 30 = 3"), "doc_id")


@query(f"WITH {MANIFEST}, c AS (SELECT id, (i % 4)::INT AS col, (i // 4)::INT AS row, (i % 4) * 250.0 AS x, (i // 4) * 250.0 AS y, gt_bbox AS b FROM m, range(16) t(i) WHERE gt_bbox IS NOT NULL) SELECT id, col, row FROM c WHERE NOT (x < b[3] AND b[1] < x + 250 AND y < b[4] AND b[2] < y + 250)")
def d17_clear_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = manifest_rows(spark, sf_dir).filter("gt_bbox IS NOT NULL").select("id", F.array("gt_bbox").alias("boxes"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    crops = cells.withColumns({"col": F.col("i") % 4, "row": F.floor(F.col("i") / 4).cast("int")}).withColumn("crop", F.array((F.col("col") * 250).cast("double"), (F.col("row") * 250).cast("double"), ((F.col("col") + 1) * 250).cast("double"), ((F.col("row") + 1) * 250).cast("double")))
    return J.clear_of_boxes(crops, "boxes", "crop").select("id", "col", "row")


@query(f"WITH {FIRST}, i AS (SELECT id, query_class_id, (query_class_id + 1) % 102 AS absent FROM r WHERE role = 'positive'), e AS (SELECT id, x.role AS role, x.q AS query_class_id, x.e AS evidence_present FROM (SELECT id, unnest([{{'role': 'positive', 'q': query_class_id, 'e': true}}, {{'role': 'semantic_negative', 'q': absent, 'e': false}}, {{'role': 'visual_counterfactual', 'q': query_class_id, 'e': false}}]) AS x FROM i)) SELECT id, role, query_class_id, evidence_present, substr(sha256('role/' || id || '/' || role), 1, 32) AS role_id FROM e")
def d18_family_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = first_rows(spark, sf_dir).filter("role = 'positive'").select("id", "query_class_id", ((F.col("query_class_id") + 1) % 102).alias("absent"))
    return J.family_roles(images, "id", "query_class_id", "absent")


@query(f"WITH {FIRST} SELECT id, query_class_id, true AS evidence FROM r WHERE role = 'positive' UNION ALL SELECT id, query_class_id, false FROM r WHERE role = 'semantic_negative' AND (('0x' || substr(sha256(id), 1, 16))::UBIGINT % 10) < 3")
def d19_positive_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = first_rows(spark, sf_dir)
    pos = r.filter("role = 'positive'").select("id", "query_class_id", F.lit(True).alias("evidence"))
    return pos.unionByName(r.filter((F.col("role") == "semantic_negative") & (hash_bucket(F.col("id"), 10) < 3)).select("id", "query_class_id", F.lit(False).alias("evidence")))


@query(f"WITH {PLAIN}, d AS (SELECT id, min(role) AS role FROM pl WHERE id IS NOT NULL GROUP BY id HAVING min(split) = 'dev') SELECT id || '/canonical' AS view_id, role FROM d UNION ALL SELECT id || '/' || v, role FROM d, (SELECT unnest(['native_0', 'native_1', 'native_2', 'unseen_alpha', 'unseen_beta', 'blank', 'blur', 'shuffle']) AS v) WHERE role = 'positive'")
def d20_evaluation_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = plain_rows(spark, sf_dir).filter("id IS NOT NULL").groupBy("id").agg(F.min("role").alias("role"), F.min("split").alias("split")).filter("split = 'dev'").select("id", "role")
    extra = J.each_with(d.filter("role = 'positive'"), "v", ["native_0", "native_1", "native_2", "unseen_alpha", "unseen_beta", "blank", "blur", "shuffle"])
    return d.withColumn("v", F.lit("canonical")).unionByName(extra).select(F.concat_ws("/", "id", "v").alias("view_id"), "role")


@query(f"WITH {PLAIN} SELECT DISTINCT digest FROM pl WHERE digest IS NOT NULL AND digest NOT IN (SELECT source_image_sha256 FROM prior_positives)")
def a18_hash_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "prior_positives").select(spelling.plain_digest(F.col("source_image_sha256")).alias("digest"))
    return plain_rows(spark, sf_dir).select("digest").filter("digest IS NOT NULL").distinct().join(seen, "digest", "left_anti")


@query("SELECT id, class_id, feature_index, len(features) AS width FROM feature_rows WHERE len(list_filter(features, lambda x: NOT isfinite(x))) = 0")
def a17_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.forall("features", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, sf_dir, "feature_rows").filter(finite).select("id", "class_id", "feature_index", F.size("features").cast("long").alias("width"))


@query("SELECT (SELECT count(*) FROM predictions WHERE raw_text IS NOT NULL) AS finalized, EXISTS (SELECT id FROM manifest WHERE id NOT IN (SELECT id FROM predictions WHERE raw_text IS NOT NULL AND id IS NOT NULL)) AS refused")
def b11_finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of the answered questions are finalized; with a question left open the same call is refused."""
    answers = table(spark, sf_dir, "predictions").filter("raw_text IS NOT NULL")
    asked = table(spark, sf_dir, "manifest").select("id")
    done = sinks.finalize(asked.join(answers.select("id"), "id", "left_semi"), answers, "id").count()
    try:
        sinks.finalize(asked, answers, "id").count()
        refused = False
    except Exception as e:  # how a task's failure is wrapped depends on the plan
        if "have no prediction" not in str(e):
            raise
        refused = True
    return spark.createDataFrame([(done, refused)], "finalized long, refused boolean")


@query("SELECT doc_id, 'documents' AS part, sha256('mix/' || doc_id) AS place_key FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 'notes', sha256('mix/' || doc_id) FROM documents WHERE source = 'scout_app'")
def g01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return graph.union_shuffled({"documents": d.filter("lang = 'de'").select("doc_id"), "notes": d.filter("source = 'scout_app'").select("doc_id")}, "doc_id", "mix")


@query("SELECT id, 'missing' AS side FROM (SELECT id FROM manifest EXCEPT SELECT id FROM predictions) UNION ALL SELECT id, 'extra' FROM (SELECT id FROM predictions EXCEPT SELECT id FROM manifest)")
def g02_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.differences(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "predictions"), "id")


@query(f"WITH {PLAIN}, s AS (SELECT DISTINCT digest AS v, split AS g FROM pl WHERE split IN ('train', 'val', 'dev') AND digest IS NOT NULL), p AS (SELECT 'dev' AS \"left\", 'train' AS \"right\" UNION ALL SELECT 'dev', 'val' UNION ALL SELECT 'train', 'val') SELECT \"left\", \"right\", (SELECT count(*) FROM s a JOIN s b ON a.v = b.v WHERE a.g = p.\"left\" AND b.g = p.\"right\") AS shared FROM p")
def g03_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pairwise_overlap(plain_rows(spark, sf_dir), "digest", "split", ["train", "val", "dev"])


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT {_IMAGE.format('left_id')} AS a, {_IMAGE.format('right_id')} AS b FROM pair_matches WHERE coalesce(high_confidence, true)), u AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL), w(node, seen) AS (SELECT a, a FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.seen) SELECT node, min(seen) AS component FROM w GROUP BY node")
def g04_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "pair_matches").filter(F.coalesce("high_confidence", F.lit(True))).select(_image("left_id").alias("a"), _image("right_id").alias("b"))
    return graph.components(e)


@query()
def g05_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "provenance").filter("role = 'positive'").select(F.lower(F.trim("split")).alias("split"), "template_id", F.col("family_id").alias("family"), F.col("query_class_id").alias("positive"), F.col("present_class_ids").alias("present"))
    return graph.exact_absent_assignment(p, ["split", "template_id"])


@query(f"WITH {FIRST}, a AS (SELECT id, list_filter(range(102), lambda x: NOT list_contains(present_class_ids, x::INT)) AS l FROM r) SELECT id, l[(('0x' || substr(sha256(id), 1, 15))::BIGINT % len(l)) + 1]::INT AS absent FROM a")
def g06_absent_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(spark, sf_dir).select("id", graph.absent_class(list(range(102)), F.col("present_class_ids"), F.col("id")).alias("absent"))


@query("WITH d AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN md5(text) END AS h FROM documents), k AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL) SELECT doc_id, CASE WHEN h IN (SELECT h FROM k) THEN 'prior_content' WHEN h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 THEN 'exact_content_duplicate' END AS dropped_as FROM d")
def g07_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return graph.dedup_by_content(d, "h", ["doc_id"], d.filter("doc_id % 50 = 0").select("h")).select("doc_id", "dropped_as")


@query(f"WITH {FIRST} SELECT id, CASE WHEN role = 'semantic_negative' AND c.class_id IS NOT NULL THEN c.class_id ELSE query_class_id END AS query_class_id FROM r LEFT JOIN (SELECT class_id FROM class_catalog WHERE band = 'tail') c ON c.class_id = r.query_class_id + 1")
def g08_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = first_rows(spark, sf_dir).select("id", "role", "query_class_id")
    tail = table(spark, sf_dir, "class_catalog").filter("band = 'tail'").select("class_id")
    changes = r.join(tail, F.col("class_id") == F.col("query_class_id") + 1).select("id", F.col("class_id").alias("query_class_id"))
    return graph.repaired(r, "id", changes, "query_class_id", F.col("role") == "semantic_negative").select("id", "query_class_id")


@query(f"WITH {PLAIN} SELECT 'repeated_id' AS rule, true AS hard, id AS subject FROM pl WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'digest_across_splits', true, digest FROM pl WHERE digest IS NOT NULL AND split IS NOT NULL GROUP BY digest HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'component_across_splits', false, component FROM pl WHERE component IS NOT NULL AND split IS NOT NULL GROUP BY component HAVING count(DISTINCT split) > 1")
def l01_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.leakage_rules(plain_rows(spark, sf_dir), "id", "split", "digest", "component")


_ROLES = ("positive", "semantic_negative", "visual_counterfactual")
_VISIBLE = f"v AS (SELECT {SQL_ID} AS id, CASE lower(trim(probe_split)) WHEN 'probe_train' THEN 'train' WHEN 'probe_val' THEN 'val' WHEN 'probe_test' THEN 'dev' END AS split FROM feature_rows)"
_UNEVEN = "SELECT '{0}_uneven', {0}::VARCHAR, 'positive:' || a || ',semantic_negative:' || b || ',visual_counterfactual:' || c FROM (SELECT {0}, count(*) FILTER (WHERE role = 'positive') AS a, count(*) FILTER (WHERE role = 'semantic_negative') AS b, count(*) FILTER (WHERE role = 'visual_counterfactual') AS c FROM pl GROUP BY {0}) WHERE a <> b OR a <> c"
_SEVERAL = "SELECT '{0}_in_several_splits', {0}, string_agg(DISTINCT split, ',' ORDER BY split) FROM pl WHERE {0} IS NOT NULL AND split IS NOT NULL GROUP BY {0} HAVING count(DISTINCT split) > 1"
_FREEZE = f"""WITH {PLAIN}, {OUTCOMES}, {_VISIBLE},
two AS (SELECT coalesce(x.id, y.id) AS id, x.id AS xi, y.id AS yi, x.s AS xs, y.s AS ys FROM (SELECT id, min(split) AS s FROM v GROUP BY id) x FULL JOIN (SELECT id, min(split) AS s FROM pl GROUP BY id) y ON x.id = y.id)
SELECT 'visible_key' AS rule, 'class_id' AS subject, NULL AS detail
UNION ALL SELECT 'id_not_opaque', id, NULL FROM v WHERE id IS NULL OR NOT regexp_full_match(id, '[0-9a-f]{{32}}')
UNION ALL SELECT 'id_repeated_visible', id, count(*)::VARCHAR FROM v WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'id_repeated_private', id, count(*)::VARCHAR FROM pl WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'id_on_one_side', id, CASE WHEN xi IS NULL THEN 'private' ELSE 'visible' END FROM two WHERE xi IS NULL OR yi IS NULL
UNION ALL SELECT 'split_differs', id, NULL FROM two WHERE xi IS NOT NULL AND yi IS NOT NULL AND xs IS DISTINCT FROM ys
UNION ALL {_SEVERAL.format('image')} UNION ALL {_SEVERAL.format('digest')} UNION ALL {_SEVERAL.format('component')}
UNION ALL SELECT 'family_roles', family_id, count(*)::VARCHAR FROM pl WHERE family_id IS NOT NULL GROUP BY family_id HAVING count(*) <> 3 OR count(DISTINCT role) <> 3
UNION ALL {_UNEVEN.format('template_id')} UNION ALL {_UNEVEN.format('length_bucket')}
UNION ALL SELECT 'transform', id, transform_id FROM pl WHERE CASE WHEN role = 'visual_counterfactual' THEN NOT coalesce(split = 'dev' AND transform_id IN ('tile_swap', 'blur') OR split IN ('train', 'val') AND transform_id IN ('erase', 'blur'), false) ELSE transform_id IS NOT NULL END
UNION ALL SELECT 'answer', id, CASE WHEN NOT parsed THEN 'syntax' WHEN NOT schema_ok THEN 'schema' ELSE 'semantic' END FROM o WHERE NOT (parsed AND schema_ok AND semantic)"""


@query(_FREEZE)
def l02_freeze_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever the tables break of a freeze's rules: one row per violation."""
    probe = F.lower(F.trim("probe_split"))
    split = F.when(probe == "probe_train", "train").when(probe == "probe_val", "val").when(probe == "probe_test", "dev")
    visible = table(spark, sf_dir, "feature_rows").select(spelling.plain_id(F.col("id")).alias("id"), split.alias("split"), "image", "class_id")
    answers = outcomes(spark, sf_dir).select("id", F.col("parsed").alias("syntax"), "schema_ok", "semantic")
    return O.freeze_violations(visible, plain_rows(spark, sf_dir), answers, ["id", "image"], list(_ROLES), {"train": ["erase", "blur"], "val": ["erase", "blur"], "dev": ["tile_swap", "blur"]})


@query("WITH c AS (SELECT family_id, role || ':' || count(*) AS part FROM provenance WHERE family_id IS NOT NULL GROUP BY family_id, role) SELECT family_id, list(part ORDER BY part) AS parts FROM c GROUP BY family_id HAVING list(part ORDER BY part) <> ['positive:1', 'semantic_negative:1', 'visual_counterfactual:1']")
def l03_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.incomplete_groups(table(spark, sf_dir, "provenance"), "family_id", "role", ["positive", "semantic_negative", "visual_counterfactual"])


@query("SELECT class_id, count(*) AS available, 20 AS quota, greatest(20 - count(*), 0) AS missing, CASE WHEN count(*) < 20 THEN 'BLOCK' ELSE 'READY' END AS status FROM feature_rows WHERE class_id IS NOT NULL GROUP BY class_id")
def l04_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "feature_rows").filter("class_id IS NOT NULL").groupBy("class_id").agg(F.count("*").alias("n"))
    return gates.quota_check(counts, ["class_id"], "n", 20)


_GATES = [("parse_rate", ">=", 0.5), ("null_fpr", "<", 0.6), ("coverage", ">=", 0.99), ("absent_metric", ">", 0.0)]
_JUDGED = f"{OUTCOMES}, v AS (SELECT 'parse_rate' AS gate, avg(parsed::INT::DOUBLE) AS value FROM o UNION ALL SELECT 'null_fpr', avg(coalesce(evidence_present, true)::INT::DOUBLE) FROM o WHERE role <> 'positive' UNION ALL SELECT 'coverage', avg((pest_id IS NOT NULL)::INT::DOUBLE) FROM o), t AS (SELECT * FROM (VALUES ('parse_rate', '>=', 0.5::DOUBLE), ('null_fpr', '<', 0.6::DOUBLE), ('coverage', '>=', 0.99::DOUBLE), ('absent_metric', '>', 0.0::DOUBLE)) g(gate, op, threshold)), w AS (SELECT t.gate, round(value, 6) AS observed, op, threshold, coalesce(CASE op WHEN '>=' THEN value >= threshold WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold END, false) AS passed FROM t LEFT JOIN v USING (gate))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir)
    values = o.agg(F.avg(F.col("parsed").cast("double")).alias("p"), F.avg(F.when(F.col("role") != "positive", F.coalesce("evidence_present", F.lit(True)).cast("double"))).alias("f"), F.avg(F.col("pest_id").isNotNull().cast("double")).alias("c"))
    metrics = values.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(c).alias("value")) for n, c in (("parse_rate", "p"), ("null_fpr", "f"), ("coverage", "c"))])).alias("m")).select("m.*")
    return gates.judged(metrics, gates.gates_table(spark, _GATES))


@query(f"WITH {_JUDGED} SELECT * FROM w")
def l05_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_judged(spark, sf_dir), "observed")


@query(f"WITH {_JUDGED} SELECT CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS decision, string_agg(gate, ',' ORDER BY gate) FILTER (WHERE NOT passed) AS failed FROM w")
def l06_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.decision(_judged(spark, sf_dir))


_RUN = """WITH j AS (SELECT id, sha256(coalesce(family_id, '')) AS h FROM manifest),
a AS (SELECT p.id, coalesce(m.h, sha256('')) AS h, length(p.raw_text)::DOUBLE AS n FROM predictions p LEFT JOIN (SELECT id, sha256(coalesce(min(family_id), '')) AS h FROM manifest GROUP BY id) m USING (id)),
s AS (SELECT x.id AS xi, y.id AS yi, x.h AS xh, y.h AS yh FROM (SELECT id, min(h) AS h FROM j WHERE id IS NOT NULL GROUP BY id) x FULL JOIN (SELECT id, min(h) AS h FROM a WHERE id IS NOT NULL GROUP BY id) y ON x.id = y.id)
SELECT 'job_count' AS "check", count(*) = 1000 AS passed, count(*)::DOUBLE AS observed FROM j
UNION ALL SELECT 'unique_job_ids', count(*) = count(DISTINCT id), (count(*) - count(DISTINCT id))::DOUBLE FROM j
UNION ALL SELECT 'unique_answer_ids', count(*) = count(DISTINCT id), (count(*) - count(DISTINCT id))::DOUBLE FROM a
UNION ALL SELECT 'answered', count(*) = 0, count(*)::DOUBLE FROM s WHERE yi IS NULL
UNION ALL SELECT 'no_foreign_answers', count(*) = 0, count(*)::DOUBLE FROM s WHERE xi IS NULL
UNION ALL SELECT 'digests_equal', count(*) = 0, count(*)::DOUBLE FROM s WHERE xi IS NOT NULL AND yi IS NOT NULL AND xh IS DISTINCT FROM yh
UNION ALL SELECT 'finite_n', count(*) = 0, count(*)::DOUBLE FROM a WHERE n IS NULL
UNION ALL SELECT 'budget', true, 1200.5"""


@query(_RUN)
def l06_run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ids, digests, finite numbers and budget of the run that answered the manifest."""
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    m = table(spark, sf_dir, "manifest").select("id", "family_id")
    jobs = m.select("id", digest(F.col("family_id")).alias("h"))
    seen = m.groupBy("id").agg(F.min("family_id").alias("family_id"))
    answers = table(spark, sf_dir, "predictions").join(seen, "id", "left").select("id", digest(F.col("family_id")).alias("h"), F.length("raw_text").cast("double").alias("n"))
    return O.run_checks(jobs, answers, "id", "h", ["n"], 1000, 1200.5, 1800.0)


_REVIEW = "c AS (SELECT doc_id, [CASE WHEN lang IS NULL OR lang = '' THEN 'FAIL' ELSE 'PASS' END, CASE WHEN text IS NULL THEN NULL WHEN length(text) < 10 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN source IS NULL THEN 'OPEN' ELSE 'PASS' END] AS x FROM documents)"


@query(f"WITH {_REVIEW} SELECT doc_id, CASE WHEN list_contains(x, 'FAIL') THEN 'REJECT' WHEN len(list_filter(x, lambda v: v IS NOT DISTINCT FROM 'PASS')) = 3 THEN 'PASS' ELSE 'UNCERTAIN' END AS verdict FROM c")
def l07_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = F.array(F.when(F.col("lang").isNull() | (F.col("lang") == ""), "FAIL").otherwise("PASS"), F.when(F.col("text").isNull(), None).when(F.length("text") < 10, "FAIL").otherwise("PASS"), F.when(F.col("source").isNull(), "OPEN").otherwise("PASS"))
    return table(spark, sf_dir, "documents").select("doc_id", gates.review_verdict(criteria).alias("verdict"))


@query("SELECT doc_id, CASE WHEN doc_id % 30 = 3 THEN 'EXCLUDE' WHEN (doc_id % 3 = 0) = (doc_id % 5 = 0) THEN CASE WHEN doc_id % 3 = 0 THEN 'REJECT' ELSE 'PASS' END ELSE 'OPEN' END AS label FROM documents")
def l08_final_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    v = lambda n: F.when(k % n == 0, "REJECT").otherwise("PASS")
    return table(spark, sf_dir, "documents").select("doc_id", gates.final_label(v(3), v(5), F.when(k % 30 == 3, "EXCLUDE")).alias("label"))


@query(f"WITH {MANIFEST}, c AS (SELECT id, gt_bbox AS b, [greatest(0.0, floor(gt_bbox[1] - (gt_bbox[3] - gt_bbox[1]) * 0.1::DOUBLE)), greatest(0.0, floor(gt_bbox[2] - (gt_bbox[4] - gt_bbox[2]) * 0.1::DOUBLE)), least(1000.0, ceil(gt_bbox[3] + (gt_bbox[3] - gt_bbox[1]) * 0.1::DOUBLE)), least(1000.0, ceil(gt_bbox[4] + (gt_bbox[4] - gt_bbox[2]) * 0.1::DOUBLE))] AS e FROM m WHERE gt_bbox IS NOT NULL), g AS (SELECT id, count(*) FILTER (WHERE NOT ((i % 4) * 250.0 < e[3] AND e[1] < (i % 4) * 250.0 + 250 AND (i // 4) * 250.0 < e[4] AND e[2] < (i // 4) * 250.0 + 250)) AS clear FROM c, range(16) t(i) GROUP BY id) SELECT id, clear, CASE WHEN clear >= 4 THEN 'eligible' WHEN clear > 0 THEN 'few_crops' ELSE 'covered' END AS status FROM g")
def l11_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geometry import touches

    rows = manifest_rows(spark, sf_dir).filter("gt_bbox IS NOT NULL").select("id", expanded(F.col("gt_bbox"), 0.1, 1000, 1000).alias("e"))
    cell = lambda i: F.array((i % 4 * 250).cast("double"), (F.floor(i / 4) * 250).cast("double"), (i % 4 * 250 + 250).cast("double"), (F.floor(i / 4) * 250 + 250).cast("double"))
    clear = F.size(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: ~touches(cell(i), F.col("e")))).cast("long")
    return rows.select("id", clear.alias("clear")).withColumn("status", F.when(F.col("clear") >= 4, "eligible").when(F.col("clear") > 0, "few_crops").otherwise("covered"))


@query(f"WITH {FIRST} SELECT id, role AS label, v.view AS view, v.txt AS text FROM (SELECT id, role, unnest([{{'view': 'template', 'txt': template_id}}, {{'view': 'class', 'txt': query_class_id::VARCHAR}}, {{'view': 'transform', 'txt': transform_id}}]) AS v FROM r)")
def l13_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.aligned_views(first_rows(spark, sf_dir).withColumn("label", F.col("role")), "id", "label", {"template": F.col("template_id"), "class": F.col("query_class_id").cast("string"), "transform": F.col("transform_id")})


_CROPS = f"WITH {PLAIN}, k AS (SELECT id, min(query_class_id) AS place, min(CASE role WHEN 'positive' THEN 'identity_full_frame' WHEN 'visual_counterfactual' THEN 'effective_crop' ELSE role END) AS crop_mode, min(digest) AS source_sha256, min(derived_image_sha256) AS crop_sha256 FROM pl WHERE id IS NOT NULL GROUP BY id), c AS (SELECT *, CASE WHEN crop_mode = 'identity_full_frame' THEN source_sha256 WHEN place % 7 = 0 THEN 'changed' ELSE crop_sha256 END AS local_sha256 FROM k), s AS (SELECT id, CASE WHEN min(query_class_id) % 11 = 0 THEN 'drifted' ELSE min(digest) END AS full_sha256 FROM pl WHERE id IS NOT NULL AND split <> 'excluded' GROUP BY id), g AS (SELECT c.*, s.full_sha256, CASE WHEN s.id IS NULL THEN 'missing_source' WHEN full_sha256 IS DISTINCT FROM source_sha256 THEN 'source_drift' WHEN crop_mode = 'identity_full_frame' AND local_sha256 IS DISTINCT FROM full_sha256 THEN 'identity_changed' WHEN crop_mode = 'effective_crop' AND local_sha256 IS DISTINCT FROM crop_sha256 THEN 'crop_drift' WHEN coalesce(crop_mode NOT IN ('identity_full_frame', 'effective_crop'), true) THEN 'unknown_mode' END AS broken FROM c LEFT JOIN s USING (id))"


@query(f"{_CROPS} SELECT id, place AS pair_index, 'full' AS input_condition, full_sha256 AS view_sha256, NULL AS broken FROM g WHERE broken IS NULL UNION ALL SELECT id, place, 'local', local_sha256, NULL FROM g WHERE broken IS NULL UNION ALL SELECT id, NULL, NULL, NULL, broken FROM g WHERE broken IS NOT NULL")
def d04_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops aligned with their sources as full and local views under one index; broken ones with what broke."""
    r = plain_rows(spark, sf_dir).filter("id IS NOT NULL")
    mode = F.when(F.col("role") == "positive", "identity_full_frame").when(F.col("role") == "visual_counterfactual", "effective_crop").otherwise(F.col("role"))
    k = r.groupBy("id").agg(F.min("query_class_id").alias("place"), F.min(mode).alias("crop_mode"), F.min("digest").alias("source_sha256"), F.min("derived_image_sha256").alias("crop_sha256"))
    crops = k.withColumn("local_sha256", F.when(F.col("crop_mode") == "identity_full_frame", F.col("source_sha256")).when(F.col("place") % 7 == 0, "changed").otherwise(F.col("crop_sha256")))
    sources = r.filter("split <> 'excluded'").groupBy("id").agg(F.when(F.min("query_class_id") % 11 == 0, "drifted").otherwise(F.min("digest")).alias("full_sha256"))
    full, local, broken = O.aligned_pairs(crops, sources, "id")
    return full.unionByName(local).unionByName(broken, allowMissingColumns=True).select("id", "pair_index", "input_condition", "view_sha256", "broken")