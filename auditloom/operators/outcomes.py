"""Outcome flags of single answers, and checks of whole runs and frozen data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import centre_inside, iou, valid_box

#: Overlap from which a found box supports a diagnosis.
SUPPORT_IOU = 0.5


def outcome_flags(df: DataFrame, positive: Column, wrong_query: Column) -> DataFrame:
    """One row of flags per answer; ``df`` has the fields of ``with_answers``, query_class_id and gt_bbox.

    ``positive`` marks rows whose image shows the queried class, ``wrong_query`` those
    that ask for a class the image does not show. An answer off the contract has none
    of its fields; every flag is true or false, never null. ``iou`` and ``pointing``
    are those of positives, else null.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    valid = yes(F.col("schema_ok"))
    pos = yes(positive)
    present, box, pest = valid & yes(F.col("evidence_present")), F.when(valid, F.col("region")), F.when(valid, F.col("pest_id"))
    specific = pest.isNotNull()
    refusal = valid & ~present & box.isNull() & ~specific & yes(F.col("status") != "supported") & yes(F.col("reliability") == "insufficient_visual_evidence")
    correct = pos & yes(pest == F.col("query_class_id"))
    echo = ~pos & yes(wrong_query) & yes(pest == F.col("query_class_id"))
    consistent = (present & valid_box(box) & specific) | (refusal & yes(F.size("attributes") == 0))
    return df.withColumns(
        {
            "positive": pos,
            "schema_valid": valid,
            "diagnosis_correct": correct,
            "presence_correct": valid & (present == pos),
            "refusal_correct": ~pos & refusal,
            "supported": correct & present & yes(iou(box, F.col("gt_bbox")) >= SUPPORT_IOU),
            "wrong_query_echo": echo,
            "internally_consistent": consistent,
            "prompt_compliant": consistent & ~echo,
            "predicted_present": present,
            "specific_diagnosis": specific,
            "predicted_box": box.isNotNull(),
            "false_localization": ~pos & present,
            "ebh": ~pos & ~refusal,
            "diagnosis_id": pest,
            "truth_diagnosis_id": F.when(pos, F.col("query_class_id")),
            "iou": F.when(pos, F.coalesce(iou(box, F.col("gt_bbox")), F.lit(0.0))),
            "pointing": F.when(pos, centre_inside(box, F.col("gt_bbox"))),
        }
    )


FLAGS = ("positive", "schema_valid", "diagnosis_correct", "presence_correct", "refusal_correct", "supported", "wrong_query_echo", "internally_consistent", "prompt_compliant", "predicted_present", "specific_diagnosis", "predicted_box", "false_localization", "ebh")


def uneven_by_role(rows: DataFrame, role: str, value: str, roles: list[str]) -> DataFrame:
    """(value, counts) of the values that the roles do not hold equally often; counts as ``role:count`` in order."""
    counts = rows.groupBy(value).agg(*[F.count_if(F.col(role) == r).alias(f"_{i}") for i, r in enumerate(roles)])
    same = F.lit(True)
    for i in range(1, len(roles)):
        same = same & (F.col(f"_{i}") == F.col("_0"))
    return counts.filter(~same).select(F.col(value).cast("string").alias("subject"), F.concat_ws(",", *[F.concat_ws(":", F.lit(r), F.col(f"_{i}").cast("string")) for i, r in enumerate(roles)]).alias("detail"))


def freeze_violations(visible: DataFrame, private: DataFrame, answers: DataFrame, allowed: list[str], roles: list[str], transforms: dict[str, list[str]]) -> DataFrame:
    """(rule, subject, detail): whatever a frozen data set breaks; none if it is sound.

    ``visible`` (id, split, and whatever else it shows), ``private`` (id, split,
    family_id, role, template_id, length_bucket, transform_id, image, digest,
    component) and ``answers`` (id, syntax, schema_ok, semantic) have one row per id and
    delivery. Rules: only ``allowed`` columns are visible; ids are 32 hex digits and
    come once; both sides have the same ids and splits; images, digests and components
    lie in one split; a family has each role once; templates and lengths are spread
    alike over the roles; transforms are those registered for the split, on
    counterfactuals only; and each answer passes syntax, schema and semantics, of which
    the first that fails is named. Null keys overlap with nothing.
    """
    spark, found = visible.sparkSession, []

    def add(rule: str, df: DataFrame, subject: Column | str = "subject", detail: Column | str | None = None) -> None:
        found.append(df.select(F.lit(rule).alias("rule"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"), (F.lit(None) if detail is None else F.col(detail) if isinstance(detail, str) else detail).cast("string").alias("detail")))

    add("visible_key", spark.createDataFrame([(c,) for c in visible.columns if c not in (*allowed, "split")], "subject string"))
    add("id_not_opaque", visible.filter("id IS NULL OR NOT id RLIKE '^[0-9a-f]{32}$'"), "id")
    for side, df in (("visible", visible), ("private", private)):
        add(f"id_repeated_{side}", df.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "id", "n")
    v, p = visible.groupBy("id").agg(F.min("split").alias("v")), private.groupBy("id").agg(F.min("split").alias("p"))
    both = v.withColumn("_v", F.lit(1)).join(p.withColumn("_p", F.lit(1)), "id", "full_outer")
    add("id_on_one_side", both.filter("_v IS NULL OR _p IS NULL"), "id", F.when(F.col("_v").isNull(), "private").otherwise("visible"))
    add("split_differs", both.filter("_v = 1 AND _p = 1 AND NOT v <=> p"), "id")
    for key in ("image", "digest", "component"):
        held = private.filter(f"{key} IS NOT NULL AND split IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_set("split")).alias("splits"))
        add(f"{key}_in_several_splits", held.filter(F.size("splits") > 1), key, F.array_join("splits", ","))
    per_role = private.filter("family_id IS NOT NULL").groupBy("family_id").agg(*[F.count_if(F.col("role") == r).alias(f"_{i}") for i, r in enumerate(roles)], F.count("*").alias("n"))
    add("family_roles", per_role.filter(" OR ".join([f"_{i} <> 1" for i in range(len(roles))] + [f"n <> {len(roles)}"])), "family_id", "n")
    for key in ("template_id", "length_bucket"):
        add(f"{key}_uneven", uneven_by_role(private, "role", key, roles), "subject", "detail")
    registered = F.lit(False)
    for split, names in transforms.items():
        registered = registered | ((F.col("split") == split) & F.col("transform_id").isin(names))
    counterfactual = F.col("role") == roles[-1]
    add("transform", private.filter(F.coalesce(F.when(counterfactual, ~F.coalesce(registered, F.lit(False))).otherwise(F.col("transform_id").isNotNull()), F.lit(False))), "id", "transform_id")
    level = F.when(~F.col("syntax"), "syntax").when(~F.col("schema_ok"), "schema").when(~F.col("semantic"), "semantic")
    add("answer", answers.withColumn("level", level).filter("level IS NOT NULL"), "id", "level")
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def run_checks(jobs: DataFrame, answers: DataFrame, key: str, digest: str, numbers: list[str], expected: int, seconds: Column | float, budget: float) -> DataFrame:
    """(check, passed, observed): counts, ids, digests, finite numbers and the time budget of a run.

    ``jobs`` and ``answers`` have the key and the digest of what they saw; ``numbers``
    are columns of ``answers`` that must be finite. ``expected`` is the number of jobs;
    the run's projected seconds must be at most ``budget``.
    """
    j = jobs.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
    a = answers.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), *[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(f"bad_{c}") for c in numbers]).first()
    one = lambda df: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(digest).alias(digest))
    side = one(jobs).select(key, F.col(digest).alias("_j"), F.lit(1).alias("_in_j")).join(one(answers).select(key, F.col(digest).alias("_a"), F.lit(1).alias("_in_a")), key, "full_outer")
    s = side.agg(F.count_if(F.col("_in_a").isNull()).alias("missing"), F.count_if(F.col("_in_j").isNull()).alias("extra"), F.count_if((F.col("_in_a") == 1) & (F.col("_in_j") == 1) & ~F.col("_j").eqNullSafe(F.col("_a"))).alias("drift")).first()
    rows = [("job_count", j["n"] == expected, float(j["n"])), ("unique_job_ids", j["n"] == j["d"], float(j["n"] - j["d"])), ("unique_answer_ids", a["n"] == a["d"], float(a["n"] - a["d"])), ("answered", s["missing"] == 0, float(s["missing"])), ("no_foreign_answers", s["extra"] == 0, float(s["extra"])), ("digests_equal", s["drift"] == 0, float(s["drift"]))]
    rows += [(f"finite_{c}", a[f"bad_{c}"] == 0, float(a[f"bad_{c}"])) for c in numbers]
    return jobs.sparkSession.createDataFrame([*rows, ("budget", 0 <= seconds <= budget, float(seconds))], "check string, passed boolean, observed double")


def aligned_pairs(crops: DataFrame, sources: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(full views, local views, broken rows) of crops joined to their source rows.

    ``crops``: key, place, crop_mode, source_sha256 as recorded, crop_sha256 as recorded
    and local_sha256 as found; ``sources``: key, full_sha256 as found. A crop is broken
    if its source is missing or has drifted, if an identity crop differs from its
    source or an effective crop from its record, or if its mode is another. The sound
    ones come out once per view under one pair_index, by place.
    """
    src = sources.groupBy(key).agg(F.min("full_sha256").alias("full_sha256"), F.lit(True).alias("_found"))
    joined = crops.join(src, key, "left")
    drift = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    reason = F.when(F.col("_found").isNull(), "missing_source").when(drift("full_sha256", "source_sha256"), "source_drift").when((F.col("crop_mode") == "identity_full_frame") & drift("local_sha256", "full_sha256"), "identity_changed").when((F.col("crop_mode") == "effective_crop") & drift("local_sha256", "crop_sha256"), "crop_drift").when(~F.coalesce(F.col("crop_mode").isin("identity_full_frame", "effective_crop"), F.lit(False)), "unknown_mode")
    judged = joined.withColumn("broken", reason)
    sound = judged.filter("broken IS NULL").select(key, F.col("place").alias("pair_index"), "crop_mode", "source_sha256", "full_sha256", "local_sha256")
    view = lambda name, c: sound.select(key, "pair_index", "crop_mode", "source_sha256", F.lit(name).alias("input_condition"), F.col(c).alias("view_sha256"))
    return view("full", "full_sha256"), view("local", "local_sha256"), judged.filter("broken IS NOT NULL").select(key, "broken")
