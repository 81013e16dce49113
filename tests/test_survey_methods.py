"""Parts of the survey's methods that had only stand-ins."""

import random

import pytest

from auditloom.operators import probe
from auditloom.plans import registry


def test_inference_messages_keep_their_parts(spark, tmp_path):
    part = [("image", None, "a.png"), ("text", "Is it there?", None)]
    rows = [("m", [("system", [("text", "Look.", None)]), ("user", part), ("assistant", [("text", "Yes.", None)])])]
    spark.createDataFrame(rows, "id string, messages array<struct<role string, content array<struct<type string, text string, image string>>>>").write.parquet(f"{tmp_path}/manifest.parquet")
    got = registry.queries()["c05_inference_messages"](spark, str(tmp_path)).first()["messages"]
    assert [m["role"] for m in got] == ["system", "user"] and [tuple(p) for p in got[1]["content"]] == part


def test_pair_cosine(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, -1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["i14_pair_cosine"](spark, str(tmp_path)).first()
    assert (got["least"], got["middle"], got["pairs"]) == pytest.approx((-1.0, 0.0, 3))


def test_controls_know_nothing(spark):
    rng = random.Random(1)
    rows = [(f"r{i:03d}", i % 2, [float(i % 2) + rng.gauss(0, 0.1), rng.gauss(0, 1)]) for i in range(160)]
    df = spark.createDataFrame(rows, "id string, y int, v array<double>")
    train, test = df.filter("id < 'r120'"), df.filter("id >= 'r120'")
    got = probe.probe_controls(train, test, "id", "v", "y", (17,)).collect()
    assert {r["control"] for r in got} == {"permuted_labels", "stratified_guess"} and all(r["n"] == 40 for r in got)
    assert {r["control"]: r["accuracy"] for r in got}["stratified_guess"] < 0.8
