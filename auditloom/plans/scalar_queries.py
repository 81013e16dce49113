"""Queries of the scalar functions and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, hashing, json_contract, stats, text
from ..operators import outcomes as O
from ..session import table
from .base import ANSWERS, FIRST, MANIFEST, OUTCOMES, first_rows, latest_answers, manifest_rows, outcomes, rounded
from .registry import query

_USER = "(SELECT string_agg(x, chr(10) ORDER BY i) FROM (SELECT unnest(messages) AS mm, generate_subscripts(messages, 1) AS mi) q)"


@query("SELECT o_custkey, round(CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 0.0 ELSE count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE / count(*) FILTER (WHERE o_orderstatus = 'F') END, 6) AS open_per_filled, round(avg((o_orderstatus = 'F')::INT), 6) AS filled_share FROM orders GROUP BY o_custkey")
def c01_safe_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return rounded(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(text.safe_divide(flag("O"), flag("F")).alias("open_per_filled"), text.share(F.col("o_orderstatus") == "F").alias("filled_share")), "open_per_filled", "filled_share")


@query(f"WITH {OUTCOMES} SELECT id, coalesce(len(region) = 4 AND region[3] > region[1] AND region[4] > region[2], false) AS box_ok, coalesce(len(region) = 4 AND region[3] > region[1] AND region[4] > region[2] AND region[1] >= 0 AND region[2] >= 0 AND region[3] <= 900 AND region[4] <= 900, false) AS in_frame FROM o")
def c02_valid_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("region")
    return outcomes(spark, sf_dir).select("id", geometry.valid_box(b).alias("box_ok"), geometry.valid_box(b, 900, 900).alias("in_frame"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 24 AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A', 'R')")
def c03_conjunctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity >= 24 AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A', 'R')").select("l_orderkey", "l_linenumber")


@query("SELECT class_id, 'IP' || lpad(class_id::VARCHAR, 3, '0') AS label FROM class_catalog")
def c04_class_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "class_catalog").select("class_id", text.class_label(F.col("class_id"), list(range(102))).alias("label"))


@query("SELECT id, list_transform(list_filter(messages, lambda x: x.role = 'user'), lambda x: x.role) AS roles, len(messages) AS n FROM manifest WHERE messages IS NOT NULL")
def c05_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest").filter("messages IS NOT NULL").select("id", F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["role"]).alias("roles"), F.size("messages").cast("long").alias("n"))


@query()
def c05_inference_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested messages a model may see: system and user with all their parts, without the answer."""
    return table(spark, sf_dir, "manifest").filter("messages IS NOT NULL").select("id", F.filter("messages", lambda m: m["role"].isin("system", "user")).alias("messages"))


@query("SELECT doc_id, coalesce(nullif(lang, ''), nullif(source, ''), site_key) AS label FROM documents")
def c06_first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.first_filled(F.col("lang"), F.col("source"), F.col("site_key")).alias("label"))


@query("SELECT p_partkey, p_size AS width, (p_partkey % 700)::INT AS height FROM part")
def c07_image_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("x", F.col("p_size").cast("string"), (F.col("p_partkey") % 700).cast("string")).alias("size"))
    return made.select("p_partkey", text.image_size(F.col("size")).alias("s")).select("p_partkey", "s.*")


@query("SELECT id, regexp_matches(lower(image), '\\.(jpg|jpeg|png|webp)$') AS media FROM feature_rows")
def c08_media_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://example.org/"), F.trim("image"), F.lit("?size=a.gif"))
    return table(spark, sf_dir, "feature_rows").select("id", text.has_media_suffix(url).alias("media"))


@query("SELECT source, list_sort(list_distinct(list(trim(lang)) FILTER (WHERE trim(lang) <> ''))) AS labels FROM documents GROUP BY source")
def c09_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.trim("lang")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set(F.when(lang != "", lang))).alias("labels"))


@query("SELECT id, sha256(id) AS sha, md5(id) AS md5 FROM predictions")
def h01_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions").select("id", hashing.sha256_hex(F.col("id")).alias("sha"), F.md5(F.col("id").cast("binary")).alias("md5"))


@query("SELECT id, (('0x' || substr(sha256(id), 1, 16))::UBIGINT % 97)::INT AS bucket FROM provenance")
def h02_hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "provenance").select("id", hashing.hash_bucket(F.col("id"), 97).alias("bucket"))


@query("SELECT id, substr(sha256(id || ':' || role), 1, 32) AS opaque FROM provenance")
def h03_opaque_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "provenance").select("id", hashing.opaque_id(F.col("id"), F.col("role")).alias("opaque"))


@query("SELECT sha256('{\"names\":[\"b\",\"a\"],\"seed\":17}') AS spec_hash, count(*) AS n FROM provenance")
def h04_spec_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "provenance").agg(F.lit(hashing.spec_hash({"seed": 17, "names": ["b", "a"]})).alias("spec_hash"), F.count("*").alias("n"))


@query("SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey))::INT AS distance FROM orders")
def h06_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.hamming(F.col("o_orderkey"), F.col("o_custkey")).alias("distance"))


@query("SELECT class_id, nullif(lower(regexp_replace(trim('  ' || class_name || '  x '), '\\s+', ' ', 'g')), '') AS name FROM class_catalog")
def h08_normalized_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "class_catalog").select("class_id", text.normalized_name(F.concat(F.lit("  "), F.col("class_name"), F.lit("  x "))).alias("name"))


_QUESTION = "q AS (SELECT id, mm.role AS role, unnest(mm.content, recursive := false) AS c FROM (SELECT id, unnest(messages) AS mm FROM manifest)), u AS (SELECT id, string_agg(DISTINCT c.text, '|' ORDER BY c.text) AS txt FROM q WHERE role = 'user' AND c.type = 'text' AND c.text IS NOT NULL GROUP BY id)"


@query(f"WITH {_QUESTION} SELECT id, nullif(lower(trim(regexp_replace(regexp_extract(txt, '(?i)named ''([^'']+)''', 1), '\\s+', ' ', 'g'))), '') AS name FROM u")
def h09_quoted_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "manifest").select("id", F.explode("messages").alias("m")).filter("m.role = 'user'").select("id", F.explode("m.content").alias("c")).filter("c.type = 'text' AND c.text IS NOT NULL")
    joined = c.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("c.text")), "|").alias("txt"))
    return joined.select("id", text.quoted_name(F.col("txt")).alias("name"))


@query("SELECT class_id, 'Is the pest named ''' || class_name || ''' visible?' AS prompt FROM class_catalog")
def h10_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "class_catalog").select("class_id", text.render_prompt(F.lit("Is the pest named '{name}' visible?"), F.col("class_name")).alias("prompt"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS words FROM documents WHERE text IS NOT NULL AND lang = 'en'")
def h11_word_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL AND lang = 'en'").select("doc_id", F.size(text.word_set(F.col("text"))).cast("long").alias("words"))


@query()
def h11_all_word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every language; without SQL, as lower() of other scripts differs between engines."""
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.size(text.word_set(F.col("text"))).cast("long").alias("words"))


@query("SELECT event_id, ['k=' || (props->>'$.k')] AS lines FROM events")
def h12_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", json_contract.flattened(F.col("props")).alias("lines"))


@query("WITH t AS (SELECT id, list_filter(flatten(list_transform(list_filter(messages, lambda x: x.role = 'user'), lambda x: x.content)), lambda x: x.type = 'text' AND x.text IS NOT NULL) AS c FROM manifest WHERE messages IS NOT NULL) SELECT id, array_to_string(list_transform(c, lambda x: x.text), chr(10)) AS question FROM t")
def h13_message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest").filter("messages IS NOT NULL").select("id", text.message_text(F.col("messages"), ("user",)).alias("question"))


@query(f"WITH {OUTCOMES} SELECT id, parsed AS syntax, schema_ok, evidence_present, pest_id, status FROM o")
def h14_strict_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir)
    return o.select("id", "syntax", "schema_ok", "evidence_present", "pest_id", "status")


@query(f"WITH {OUTCOMES} SELECT source, count(*) AS n, count(*) FILTER (WHERE parsed) AS syntax, count(*) FILTER (WHERE schema_ok) AS schema_ok, count(*) FILTER (WHERE semantic) AS semantic FROM o GROUP BY source")
def h19_quality_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if("syntax").alias("syntax"), F.count_if("schema_ok").alias("schema_ok"), F.count_if("semantic").alias("semantic"))


@query("SELECT class_id, CASE WHEN class_id % 3 = 0 THEN NULL ELSE 'IP' || lpad(class_id::VARCHAR, 3, '0') END AS answer FROM class_catalog")
def h16_compact_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"pest_id":"'), text.class_label(F.col("class_id")), F.when(F.col("class_id") % 3 == 0, '"} ').otherwise('"}'))
    return table(spark, sf_dir, "class_catalog").select("class_id", json_contract.compact_class_answer(raw).alias("answer"))


@query()
def h17_tolerant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_contract.with_answers(latest_answers(spark, sf_dir), tolerant=True).select("id", "syntax", "schema_ok", "error", "evidence_present", "pest_id")


@query(f"WITH {ANSWERS} SELECT id, list_sort(list_distinct(regexp_extract_all(raw_text, '(supported|abstain|uncertain)', 1))) AS mentions FROM a")
def h18_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_answers(spark, sf_dir).select("id", text.mentions(F.col("raw_text"), "(supported|abstain|uncertain)").alias("mentions"))


@query("SELECT p_partkey, '{\"evidence_present\":true,\"evidence_region\":null,\"visible_attributes\":[\"' || p_brand || '\"],\"diagnosis\":{\"pest_id\":' || p_size || '},\"reliability\":\"supported\"}' AS answer, 120 AS padded FROM part")
def h20_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = json_contract.render_answer(F.lit(True), F.lit(None).cast("array<double>"), F.array("p_brand"), F.struct(F.col("p_size").alias("pest_id")), F.lit("supported"))
    return table(spark, sf_dir, "part").select("p_partkey", answer.alias("answer")).withColumn("padded", F.least(F.length(text.padded(F.col("answer"), 120)), F.lit(120)))


@query("SELECT event_id, strpos(props, '\"k\": ') + 4 AS start, strpos(props, '}') - 1 AS \"end\" FROM events")
def h21_value_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.value_span(F.col("props"), "k").alias("s")).select("event_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query(f"WITH {FIRST} SELECT id, CASE WHEN len(list_filter(present_class_ids, lambda x: x = query_class_id)) = 1 THEN list_position(present_class_ids, query_class_id) - 1 END AS place FROM r")
def h22_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(spark, sf_dir).select("id", text.unique_subsequence(F.col("present_class_ids"), F.array("query_class_id")).alias("place"))


@query(f"WITH {OUTCOMES} SELECT id, coalesce(semantic AND NOT evidence_present, false) AS refused, coalesce(pest_id IS NOT NULL AND parsed, false) AS specific, coalesce(role = 'positive' AND evidence_present AND pest_id = query_class_id, false) AS right_id FROM o")
def h23_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda c: F.coalesce(c, F.lit(False))
    return outcomes(spark, sf_dir).select("id", f(F.col("semantic") & ~F.col("evidence_present")).alias("refused"), f(F.col("pest_id").isNotNull() & F.col("parsed")).alias("specific"), f((F.col("role") == "positive") & F.col("evidence_present") & (F.col("pest_id") == F.col("query_class_id"))).alias("right_id"))


_IOU = "greatest(0.0, least(region[3], gt_bbox[3]) - greatest(region[1], gt_bbox[1])) * greatest(0.0, least(region[4], gt_bbox[4]) - greatest(region[2], gt_bbox[2]))"
_BOTH = "len(region) = 4 AND region[3] > region[1] AND region[4] > region[2] AND len(gt_bbox) = 4 AND gt_bbox[3] > gt_bbox[1] AND gt_bbox[4] > gt_bbox[2]"


@query(f"WITH {OUTCOMES} SELECT id, round(CASE WHEN {_BOTH} THEN {_IOU} / ((region[3] - region[1]) * (region[4] - region[2]) + (gt_bbox[3] - gt_bbox[1]) * (gt_bbox[4] - gt_bbox[2]) - {_IOU}) ELSE 0.0 END, 6) AS iou FROM o")
def h25_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes(spark, sf_dir).select("id", geometry.iou(F.col("region"), F.col("gt_bbox")).alias("iou")), "iou")


@query(f"WITH {OUTCOMES} SELECT id, coalesce({_BOTH} AND (region[1] + region[3]) / 2 BETWEEN gt_bbox[1] AND gt_bbox[3] AND (region[2] + region[4]) / 2 BETWEEN gt_bbox[2] AND gt_bbox[4], false) AS pointed FROM o")
def h26_pointing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).select("id", geometry.centre_inside(F.col("region"), F.col("gt_bbox")).alias("pointed"))


_FLAGGED = f"""{OUTCOMES},
x AS (SELECT *, coalesce(role = 'positive', false) AS positive, coalesce(condition = 'semantic_null', false) AS wrong, coalesce(schema_ok, false) AS valid FROM o),
y AS (SELECT *, valid AND coalesce(evidence_present, false) AS present, CASE WHEN valid THEN region END AS box, CASE WHEN valid THEN pest_id END AS pest, CASE WHEN valid THEN json_array_length(raw_text, '$.visible_attributes') END AS attributes FROM x),
z AS (SELECT *, coalesce(len(box) = 4 AND box[3] > box[1] AND box[4] > box[2], false) AS boxed, coalesce(CASE WHEN valid AND {_BOTH} THEN {_IOU} / ((region[3] - region[1]) * (region[4] - region[2]) + (gt_bbox[3] - gt_bbox[1]) * (gt_bbox[4] - gt_bbox[2]) - {_IOU}) ELSE 0.0 END, 0.0) AS overlap, valid AND NOT present AND box IS NULL AND pest IS NULL AND coalesce(status <> 'supported', false) AND coalesce(reliability = 'insufficient_visual_evidence', false) AS refusal FROM y),
q AS (SELECT *, positive AND coalesce(pest = query_class_id, false) AS correct, NOT positive AND wrong AND coalesce(pest = query_class_id, false) AS echo, (present AND boxed AND pest IS NOT NULL) OR (refusal AND coalesce(attributes = 0, false)) AS consistent FROM z)"""


@query(f"""WITH {_FLAGGED} SELECT id, positive, valid AS schema_valid, correct AS diagnosis_correct, valid AND present = positive AS presence_correct, NOT positive AND refusal AS refusal_correct, correct AND present AND overlap >= 0.5 AS supported, echo AS wrong_query_echo, consistent AS internally_consistent, consistent AND NOT echo AS prompt_compliant, present AS predicted_present, pest IS NOT NULL AS specific_diagnosis, box IS NOT NULL AS predicted_box, NOT positive AND present AS false_localization, NOT positive AND NOT refusal AS ebh, pest AS diagnosis_id, CASE WHEN positive THEN query_class_id END AS truth_diagnosis_id, CASE WHEN positive THEN round(overlap, 6) END AS iou, CASE WHEN positive THEN coalesce(valid AND {_BOTH} AND (region[1] + region[3]) / 2 BETWEEN gt_bbox[1] AND gt_bbox[3] AND (region[2] + region[4]) / 2 BETWEEN gt_bbox[2] AND gt_bbox[4], false) END AS pointing FROM q""")
def h24_outcome_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags of every answered question."""
    flagged = O.outcome_flags(outcomes(spark, sf_dir), F.col("role") == "positive", F.col("condition") == "semantic_null")
    return rounded(flagged.select("id", *O.FLAGS, "diagnosis_id", "truth_diagnosis_id", "iou", "pointing"), "iou")


@query(f"WITH {MANIFEST} SELECT id, [round(gt_bbox[1] * 0.64, 6), round(gt_bbox[2] * 0.48, 6), round(gt_bbox[3] * 0.64, 6), round(gt_bbox[4] * 0.48, 6)] AS pixels FROM m WHERE gt_bbox IS NOT NULL")
def h27_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_rows(spark, sf_dir).filter("gt_bbox IS NOT NULL").select("id", F.transform(geometry.scaled(F.col("gt_bbox"), 0.64, 0.48), lambda v: F.round(v, 6)).alias("pixels"))


@query(f"WITH {MANIFEST} SELECT id, [greatest(0.0, floor(gt_bbox[1] - (gt_bbox[3] - gt_bbox[1]) * 0.25::DOUBLE)), greatest(0.0, floor(gt_bbox[2] - (gt_bbox[4] - gt_bbox[2]) * 0.25::DOUBLE)), least(1000.0, ceil(gt_bbox[3] + (gt_bbox[3] - gt_bbox[1]) * 0.25::DOUBLE)), least(1000.0, ceil(gt_bbox[4] + (gt_bbox[4] - gt_bbox[2]) * 0.25::DOUBLE))] AS crop FROM m WHERE gt_bbox IS NOT NULL")
def h28_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_rows(spark, sf_dir).filter("gt_bbox IS NOT NULL").select("id", geometry.expanded(F.col("gt_bbox"), 0.25, 1000, 1000).alias("crop"))


@query(f"WITH {MANIFEST}, c AS (SELECT id, i, (i % 8 + 0.5::DOUBLE) * 125 AS x, (i // 8 + 0.5::DOUBLE) * 125 AS y, gt_bbox AS b FROM m, range(64) t(i) WHERE gt_bbox IS NOT NULL), s AS (SELECT *, x >= b[1] AND x < b[3] AND y >= b[2] AND y < b[4] AS inside, greatest(0.0, least(x + 62.5, b[3]) - greatest(x - 62.5, b[1])) * greatest(0.0, least(y + 62.5, b[4]) - greatest(y - 62.5, b[2])) AS overlap FROM c) SELECT id, CASE WHEN bool_or(inside) THEN list(i ORDER BY i) FILTER (WHERE inside) ELSE [arg_max(i, overlap * 1000 - i / 1000.0)] END AS cells FROM s GROUP BY id")
def h29_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_rows(spark, sf_dir).filter("gt_bbox IS NOT NULL").select("id", F.transform(geometry.grid_cells(F.col("gt_bbox"), 8, 8, 1000, 1000), lambda v: v.cast("long")).alias("cells"))


@query(f"WITH {OUTCOMES}, t AS (SELECT id, list_filter([CASE WHEN NOT parsed THEN 'not_parsed' END, CASE WHEN region IS NOT NULL AND NOT coalesce(len(region) = 4 AND region[3] > region[1] AND region[4] > region[2], false) THEN 'bad_box' END, CASE WHEN list_max(region) > 900 THEN 'near_edge' END], lambda x: x IS NOT NULL) AS reasons FROM o) SELECT * FROM t")
def h32_coordinate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("region")
    reasons = F.filter(F.array(F.when(~F.col("parsed"), "not_parsed"), F.when(r.isNotNull() & ~geometry.valid_box(r), "bad_box"), F.when(F.array_max(r) > 900, "near_edge")), lambda x: x.isNotNull())
    return outcomes(spark, sf_dir).select("id", reasons.alias("reasons"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'trap|adults') THEN 'count' WHEN regexp_matches(lower(text), 'label|relabel') THEN 'label' ELSE 'other' END AS topic FROM documents WHERE text IS NOT NULL")
def h33_keyword_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", text.keyword_bucket(F.col("text"), {"count": ("trap", "adults"), "label": ("label", "relabel")}).alias("topic"))


@query(f"WITH {FIRST} SELECT id, CASE WHEN list_contains(present_class_ids, query_class_id) THEN 'n' || query_class_id END AS name FROM r")
def h34_name_at_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, names = F.array_join(F.col("present_class_ids").cast("array<string>"), "|"), F.array_join(F.transform("present_class_ids", lambda c: F.concat(F.lit("n"), c.cast("string"))), "|")
    return first_rows(spark, sf_dir).select("id", text.name_at_id(ids, names, F.col("query_class_id")).alias("name"))


@query(f"WITH {OUTCOMES} SELECT id, CASE WHEN role = 'positive' AND gt_bbox IS NULL THEN 'no_box' WHEN role <> 'positive' AND gt_bbox IS NOT NULL THEN 'box_of_null' WHEN query_class_id NOT BETWEEN 0 AND 101 THEN 'class' END AS broken FROM o")
def h35_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when((F.col("role") == "positive") & F.col("gt_bbox").isNull(), "no_box").when((F.col("role") != "positive") & F.col("gt_bbox").isNotNull(), "box_of_null").when(~F.col("query_class_id").between(0, 101), "class")
    return outcomes(spark, sf_dir).select("id", broken.alias("broken"))


@query("SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda x: abs(x::DOUBLE)), 'sum'), 4) AS l1, round(sqrt(list_aggregate(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), 'sum')), 4) AS l2 FROM embeddings")
def i14_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))), 4).alias("l1"), F.round(F.sqrt(stats.dot(e, e)), 4).alias("l2"))


@query()
def i14_pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and median cosine of each vector with the next one."""
    e = table(spark, sf_dir, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(following, "vec_id").select(stats.cosine(F.col("embedding"), F.col("other")).alias("c")).agg(F.min("c").alias("least"), F.median("c").alias("middle"), F.count("c").alias("pairs"))
