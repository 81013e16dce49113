"""Outcome flags, freeze and run checks, alignment, quota schedules, forests: small cases by hand."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import graph
from auditloom.operators import outcomes as O
from auditloom.operators import select as S

FIELDS = "id string, role string, wrong boolean, query_class_id int, gt_bbox array<double>, schema_ok boolean, evidence_present boolean, region array<double>, attributes array<string>, status string, pest_id int, reliability string, iou string"
BOX, OFF = [0.0, 0.0, 10.0, 10.0], [50.0, 50.0, 60.0, 60.0]
NULL = (False, None, [], "abstain", None, "insufficient_visual_evidence")


def test_outcome_flags(spark):
    rows = [
        ("hit", "positive", False, 3, BOX, True, True, BOX, ["x"], "supported", 3, "supported", "clash"),
        ("off", "positive", False, 3, BOX, True, True, OFF, [], "supported", 3, "supported", "clash"),
        ("wrong", "positive", False, 3, BOX, True, True, BOX, [], "supported", 4, "supported", "clash"),
        ("abstains", "positive", False, 3, BOX, True, *NULL, "clash"),
        ("refuses", "null", True, 3, None, True, *NULL, "clash"),
        ("echoes", "null", True, 3, None, True, True, BOX, [], "supported", 3, "supported", "clash"),
        ("seen", "null", False, 3, None, True, True, BOX, [], "supported", 3, "supported", "clash"),
        ("garbled", "null", None, None, None, False, True, BOX, None, None, 3, None, "clash"),
        ("none", None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    out = {r["id"]: r for r in O.outcome_flags(spark.createDataFrame(rows, FIELDS), F.col("role") == "positive", F.col("wrong")).collect()}
    true = {i: {f for f in O.FLAGS if r[f]} for i, r in out.items()}
    sound = {"schema_valid", "internally_consistent", "prompt_compliant"}
    found = {"predicted_present", "specific_diagnosis", "predicted_box"}
    assert true["hit"] == {"positive", "diagnosis_correct", "presence_correct", "supported"} | sound | found
    assert true["off"] == true["hit"] - {"supported"} and (out["off"]["iou"], out["off"]["pointing"]) == (0.0, False)
    assert true["wrong"] == true["hit"] - {"supported", "diagnosis_correct"} and out["wrong"]["diagnosis_id"] == 4
    assert true["abstains"] == {"positive"} | sound and true["refuses"] == {"presence_correct", "refusal_correct"} | sound
    assert true["echoes"] == {"schema_valid", "internally_consistent", "wrong_query_echo", "false_localization", "ebh"} | found
    assert true["seen"] == true["echoes"] - {"wrong_query_echo"} | {"prompt_compliant"}
    assert true["garbled"] == true["none"] == {"ebh"} and all(r[f] is not None for r in out.values() for f in O.FLAGS)
    assert out["hit"]["truth_diagnosis_id"] == 3 and out["refuses"]["iou"] is None


PRIVATE = "id string, split string, family_id string, role string, template_id string, length_bucket int, transform_id string, image string, digest string, component string"
ROLES = ["positive", "semantic_negative", "visual_counterfactual"]


def frozen(split, family, n):
    return [(f"{n + i:032x}", split, family, r, "t0", 64, "blur" if i == 2 else None, f"i{n}", f"d{n}", f"c{n}") for i, r in enumerate(ROLES)]


def violations(spark, private, visible=None, answers=(), columns="id string, split string, image string"):
    visible = [(r[0], r[1], "x") for r in private] if visible is None else visible
    found = O.freeze_violations(spark.createDataFrame(visible, columns), spark.createDataFrame(private, PRIVATE), spark.createDataFrame(list(answers), "id string, syntax boolean, schema_ok boolean, semantic boolean"), ["id", "image"], ROLES, {"train": ["blur"], "dev": ["blur"]})
    return {tuple(r) for r in found.collect()}


def test_freeze_violations(spark):
    sound = frozen("train", "f1", 16) + frozen("dev", "f2", 32)
    ids = [r[0] for r in sound]
    assert violations(spark, sound, answers=[(ids[0], True, True, True)]) == set()
    assert violations(spark, sound[:0]) == set()
    bad = sound[:2] + [(*sound[2][:6], "erase", *sound[2][7:])] + [(*sound[3][:7], "i16", "d16", "c32")] + sound[4:] + [sound[5]]
    got = violations(spark, bad, answers=[(ids[0], False, False, False), (ids[1], True, False, False), (ids[2], True, True, False)])
    assert got == {("transform", ids[2], "erase"), ("image_in_several_splits", "i16", "dev,train"), ("digest_in_several_splits", "d16", "dev,train"), ("id_repeated_visible", ids[5], "2"), ("id_repeated_private", ids[5], "2"), ("family_roles", "f2", "4"), ("template_id_uneven", "t0", "positive:2,semantic_negative:2,visual_counterfactual:3"), ("length_bucket_uneven", "64", "positive:2,semantic_negative:2,visual_counterfactual:3"), ("answer", ids[0], "syntax"), ("answer", ids[1], "schema"), ("answer", ids[2], "semantic")}
    shown = [(r[0], r[1], "x", "leak") for r in sound[:-1]] + [("plain", "dev", "x", "leak"), (sound[-1][0], "val", "x", "leak")]
    assert violations(spark, sound, shown, columns="id string, split string, image string, label string") == {("visible_key", "label", None), ("id_not_opaque", "plain", None), ("id_on_one_side", "plain", "visible"), ("split_differs", sound[-1][0], None)}


def test_run_checks(spark):
    jobs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "job string, sha string")
    sound = spark.createDataFrame([("a", "1", 0.5), ("b", "2", 1.0), ("c", "3", 2.0)], "job string, sha string, loss double")
    assert all(r["passed"] for r in O.run_checks(jobs, sound, "job", "sha", ["loss"], 3, 10.0, 1800.0).collect())
    bad = spark.createDataFrame([("a", "9", 0.5), ("a", "9", float("nan")), ("z", "2", None)], sound.schema)
    got = {r["check"]: (r["passed"], r["observed"]) for r in O.run_checks(jobs, bad, "job", "sha", ["loss"], 4, 2000.0, 1800.0).collect()}
    assert got == {"job_count": (False, 3.0), "unique_job_ids": (True, 0.0), "unique_answer_ids": (False, 1.0), "answered": (False, 2.0), "no_foreign_answers": (False, 1.0), "digests_equal": (False, 1.0), "finite_loss": (False, 2.0), "budget": (False, 2000.0)}


def test_aligned_pairs(spark):
    crops = spark.createDataFrame([("a", 0, "identity_full_frame", "s", None, "s"), ("b", 1, "effective_crop", "s", "k", "k"), ("c", 2, "effective_crop", "s", "k", "x"), ("d", 3, "identity_full_frame", "s", None, "x"), ("e", 4, "effective_crop", "old", "k", "k"), ("f", 5, "effective_crop", "s", "k", "k"), ("g", 6, "zoom", "s", "k", "k"), ("h", 7, None, "s", "k", "k")], "id string, place int, crop_mode string, source_sha256 string, crop_sha256 string, local_sha256 string")
    sources = spark.createDataFrame([(i, "s") for i in "abcdegh"], "id string, full_sha256 string")
    full, local, broken = O.aligned_pairs(crops, sources, "id")
    assert {(r["id"], r["pair_index"], r["view_sha256"]) for r in full.collect()} == {("a", 0, "s"), ("b", 1, "s")}
    assert {(r["id"], r["view_sha256"]) for r in local.collect()} == {("a", "s"), ("b", "k")}
    assert dict(map(tuple, broken.collect())) == {"c": "crop_drift", "d": "identity_changed", "e": "source_drift", "f": "missing_source", "g": "unknown_mode", "h": "unknown_mode"}


def test_class_quota_schedule(spark):
    rows = [(f"r{f}-{r}", f"f{f}", f // 4, "head" if f // 4 < 3 else "tail", r) for f in range(20) for r in ("p", "n")] + [("lone", "f99", 4, "tail", "p"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, fam string, cls int, band string, role string")
    make = lambda d, quotas, **k: S.class_quota_schedule(d, "fam", "cls", "band", "role", "id", quotas, 2, ("p", "n"), 23, **k)
    got = make(df, {"head": 2, "tail": 1}).orderBy("step").collect()
    assert [r["schedule_role"] for r in got] == ["p" if i % 2 == 0 else "n" for i in range(23)]
    assert len({r["cls"] for r in got if r["band"] == "head"}) == 2 and len({r["fam"] for r in got}) == 6
    assert {r["id"] for r in got[:12]} == {f"r{r['fam'][1:]}-{x}" for r in got for x in ("p", "n")} and [r["id"] for r in got[12:]] == [r["id"] for r in got[:11]]
    assert len({r["exposure_id"] for r in got}) == 23 and got == make(df.repartition(5), {"head": 2, "tail": 1}).orderBy("step").collect()
    with pytest.raises(Exception, match="band tail has 2 of 3 classes"):  # several stages may fail at once
        make(df, {"tail": 3}).collect()
    assert {r["cls"] for r in make(df, {"tail": 3}, strict=False).collect()} == {3, 4}


@pytest.mark.parametrize("bound", [400_000, 0])
def test_components_by_forests_and_by_stars(spark, bound):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200, 200)] + [(300, i) for i in range(301, 380)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([*edges, *edges[:9], (None, 1)], "a long, b int").repartition(4)
    assert dict(map(tuple, graph.components(df, edges_per_partition=bound).collect())) == label
    assert graph.components(df.limit(0), edges_per_partition=bound).count() == 0
