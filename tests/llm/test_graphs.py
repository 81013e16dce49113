import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import families, groups, overlap
from auditloom.llm.ids import EMPTY_SHA256, plain_component, plain_digest, plain_image, plain_split

PROVENANCE = "id string, family_id string, split string, source string, source_image_id string, source_image_sha256 string, near_duplicate_component_id string, shard string, key string"


def row(i, split, digest=None, component=None, family=None, image=None, source="s"):
    return (i, family, split, source, image, digest, component, "clash", "clash")


def test_plain_spellings(spark):
    d = "ab12" * 16
    rows = [(d,), (d.upper(),), (f" {d}\n",), (f"sha256:{d}",), (f"SHA256={d.upper()}",), ("sha256-qxKrEqsSqxKrEqsSqxKrEqsSqxKrEqsSqxKrEqsSqxI=",), (d[:20] + "…",), (d[:32],), ("0" * 64,), (EMPTY_SHA256,), (EMPTY_SHA256[:24] + "…",), ("unknown",), ("",), (None,)]
    got = [r["x"] for r in spark.createDataFrame(rows, "d string").select(plain_digest(F.col("d")).alias("x")).collect()]
    assert got == [d] * 6 + [d[:20], d[:32]] + [None] * 6
    comps = [("0d172e702cdf4b5eaffe643e", "0d172e702cdf4b5eaffe643e"), ("cc:0D172E702CDF4B5EAFFE643E ", "0d172e702cdf4b5eaffe643e"), ("component/IP000000001", "IP000000001"), ("ip000000001\n", "IP000000001"), ("none", None), ("-1", None), ("0" * 24, None), (None, None)]
    assert [r["x"] for r in spark.createDataFrame(comps, "c string, w string").select(plain_component(F.col("c")).alias("x")).collect()] == [w for _, w in comps]
    images = [("./IP000000001.png", "IP000000001"), (" ip000000002", "IP000000002"), ("images/IP000000003.JPG", "IP000000003"), ("IP12", None), ("", None), (None, None)]
    assert [r["x"] for r in spark.createDataFrame(images, "c string, w string").select(plain_image(F.col("c")).alias("x")).collect()] == [w for _, w in images]
    assert [r["x"] for r in spark.createDataFrame([(" Training",), ("DEV",), ("valid",), ("huh",), (None,)], "c string").select(plain_split(F.col("c")).alias("x")).collect()] == ["train", "dev", "val", None, None]


def test_fm_index_equals_brute_force():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab0") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    keys, train = sorted(set(words[:30])), sorted(set(words[20:]))
    weights = np.array([rng.randint(1, 5) for _ in train])
    rows, spans = overlap.FmIndex(keys).match(train, weights)
    for k, n, s in zip(keys, rows, spans):
        hits = [(t, w) for t, w in zip(train, weights) if t.startswith(k) or k.startswith(t)]
        assert n == sum(w for _, w in hits)
        assert s == max([min(len(t), len(k)) for t, _ in hits], default=0)
    assert overlap.FmIndex(["a"]).match([], np.array([], int))[0].tolist() == [0]
    assert overlap.FmIndex(["abc"]).match(["zzz", "ab"], np.array([1, 1]))[0].tolist() == [1]


def test_overlap(spark):
    d, e, c = "a1" * 32, "b2" * 32, "c" * 23 + "1"
    rows = [row("t1", "train", d, c), row("t2", "Train ", e[:20] + "…"), row("t2", "train", e[:20]), row("e1", "val", d.upper()), row("e2", "dev", None, f"cc:{c}"), row("e3", "dev", e), row("e3", "dev", e), row("e4", "val", "f" * 64, "none"), row("e5", "excluded", d), row("e6", "dev", d[:24], c), row(None, "dev", d), row("e7", None, d), row("e8", "val", None, None, source=None)]
    rows += [row(f"h{i}", "dev", None, c) for i in range(300)]  # a hot component
    df = spark.createDataFrame(rows, PROVENANCE)
    want = {"e1": "exact", "e2": "near", "e3": "exact", "e6": "exact"} | {f"h{i}": "near" for i in range(300)}
    for per in (5, 60_000):
        assert {r["id"]: r["overlap"] for r in overlap.cross_split_overlap(df, per).collect()} == want
    report = {(r["split"], r["source"]): (r["ids"], r["exact_ids"], r["near_ids"]) for r in overlap.overlap_report(df).collect()}
    assert report == {("val", "s"): (2, 1, 0), ("dev", "s"): (303, 2, 301), ("val", None): (1, 0, 0)}
    assert overlap.cross_split_overlap(df.limit(0)).count() == 0


def brute(edges):
    nodes = {x for e in edges for x in e}
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 60):02d}", f"n{rng.randint(0, 60):02d}") for _ in range(45)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)] + [("hub", f"q{i:03d}") for i in range(80)]
    df = spark.createDataFrame(edges + edges[:5] + [(None, "x"), ("y", None)], "a string, b string").repartition(5)
    want = brute(edges)
    looped = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert dict(map(tuple, families.hash_to_min(df).collect())) == {k: v for k, v in want.items() if k not in looped}
    for bounds in ({}, {"nodes_per_forest": 7, "edges_per_partition": 9}):
        assert dict(map(tuple, groups.union_find_groups(df, **bounds).collect())) == want
    assert families.hash_to_min(df.limit(0)).count() == 0
    assert groups.union_find_groups(df.limit(0)).count() == 0


def test_rising_chain_in_random_order_ends(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(groups, "checkpoint", lambda df, plain=groups.checkpoint: seen.append(1) or (plain(df) if len(seen) < 30 else pytest.fail("the contraction makes no progress")))
    settings = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    ids = [f"IP{i:09d}" for i in range(2000)]
    edges = list(zip(ids, ids[1:], strict=False))
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string").repartition(12)
    try:
        found = dict(map(tuple, groups.union_find_groups(df, nodes_per_forest=400, edges_per_partition=400).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == dict.fromkeys(ids, ids[0])


def test_assignment_keeps_groups_together(spark):
    rng = random.Random(5)
    rows = []
    for f in range(600):
        image = f"IP{f:09d}"
        comp = f"{'abcdef'[f % 6]}{f // 4:023x}" if f % 3 else "none"
        for r in range(3):
            rows.append(row(f"r{f}-{r}", rng.choice(["train", "val", "dev"]), f"{f:064x}" if f % 7 else None, comp, f"fam{f}" if rng.random() > 0.1 else None, image))
    rows += [row(f"big{i}", "train", None, "d" * 23 + "0", f"bigfam{i}", f"IP{900000 + i:09d}") for i in range(600)]
    rows += [rows[0], row("lonely", "dev"), row(None, "dev", None, None, "fam1")]
    df = spark.createDataFrame(rows, PROVENANCE)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.5)], "split_name string, target_share double")
    got = {r["id"]: (r["group_id"], r["split"]) for r in families.assign_splits(df, targets).collect()}
    assert len(got) == len({r[0] for r in rows if r[0]})
    by = {}
    for i, family, _, _, image, digest, comp, *_ in rows:
        for key in (family, image, comp if comp and comp != "none" else None, digest):
            if i and key:
                by.setdefault(key, set()).add(got[i][1])
    assert all(len(s) == 1 for s in by.values())
    share = {s: sum(v[1] == s for v in got.values()) / len(got) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.06 and share["validation"] > 0.05 and share["test"] > 0.05
    again = {r["id"]: (r["group_id"], r["split"]) for r in families.assign_splits(df.repartition(7), targets).collect()}
    assert again == got
    assert families.assign_splits(df.limit(0), targets).count() == 0
    assert {r["split"] for r in families.assign_splits(df.limit(3), targets.limit(0)).collect()} <= {None}


def test_torn_groups(spark):
    c = "e" * 23 + "5"
    rows = [row("1", "train", None, c, "f1", "IP000000001"), row("2", "dev", None, None, "f1", "IP000000001"), row("3", "val", None, f"component/{c.upper()}", "f2", "IP000000002"), row("4", "excluded", None, "IP000000009", "f3", "IP000000003"), row("5", "train", None, "IP000000009", "f3", "IP000000003"), row("6", "dev", None, "IP000000009", None, "IP000000004"), row("7", None, None, None, None, None)]
    assert {tuple(r) for r in families.torn_groups(spark.createDataFrame(rows, PROVENANCE)).collect()} == {("family", "f1"), ("component", c)}
    late = [row("1", "train", None, None, "F1 ", "IP000000001"), row("2", "dev", None, None, None, "images/IP000000001.jpg"), row("3", "val", None, None, None, "IP000000001"), row("4", "train", None, None, "f2", "IP000000002"), row("5", "excluded", None, None, None, "IP000000002"), row("6", "dev", None, c, None, "IP000000003"), row("7", "train", None, c, None, "IP000000004")]
    assert {tuple(r) for r in families.torn_groups(spark.createDataFrame(late, PROVENANCE)).collect()} == {("family", "f1"), ("component", c)}
    hot = [row(f"h{i}", "train" if i % 2 else "dev", None, f"{i:023x}f", f"fam{i // 2}", "IP000000005") for i in range(300)]
    assert {tuple(r) for r in families.torn_groups(spark.createDataFrame(hot, PROVENANCE)).collect()} == {("family", f"fam{i}") for i in range(150)}
    assert families.torn_groups(spark.createDataFrame([], PROVENANCE)).count() == 0


def test_image_groups(spark):
    pm = spark.createDataFrame([("images/IP000000001.jpg", "ip000000002", True), ("IP000000002", "IP000000001", None), ("IP000000003", "IP000000004", False), ("IP000000005", "IP000000005", True), (None, "IP000000006", True), ("", "IP000000006", True)], "left_id string, right_id string, high_confidence boolean")
    pv = spark.createDataFrame([("IP000000002", "a" * 23 + "b"), ("IP000000007", f"cc:{'a' * 23}b"), ("IP000000008", "none"), ("IP000000009", "IP000000009"), (None, "a" * 23 + "b")], "source_image_id string, near_duplicate_component_id string")
    pp = spark.createDataFrame([("IP000000010", "a" * 23 + "b")], pv.schema)
    got = dict(map(tuple, groups.image_groups(pm, pv, pp).collect()))
    assert got == {f"IP{i:09d}": "IP000000001" for i in (1, 2, 7, 10)}
    assert groups.image_groups(pm.limit(0), pv.limit(0), pp.limit(0)).count() == 0


def test_rendezvous_moves_little(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    pick = lambda w: {r["k"]: r["s"] for r in keys.select("k", families.rendezvous(F.col("k"), w, 1).alias("s")).collect()}
    a, b = pick({"x": 0.8, "y": 0.2}), pick({"x": 0.7, "y": 0.3})
    assert abs(sum(v == "x" for v in a.values()) / 4000 - 0.8) < 0.03
    assert all(b[k] == "y" for k, v in a.items() if v == "y")
    assert set(pick({}).values()) == {None}
    assert len(list(itertools.islice(a, 3))) == 3
