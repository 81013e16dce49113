import datetime as dt
import random

from pyspark.sql import functions as F

from auditloom.llm import sampling

FEATURES = "id string, family_id string, class_id int, class_band string, probe_split string, source_image_id string, batch_no int, bucket string, h string"


def features(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        c = rng.choice([1] * 6 + [2, 3])
        rows.append((f"id{i:04d}", f"fam{i // 3}" if i % 9 else None, c, "head", rng.choice(["probe_train", " PROBE_TRAIN", "probe_val"]), f"IP{i // 3:09d}", 1 + i % 8, "x", "y"))
    rows += [(" ID0000 ", None, None, None, None, None, 9, "x", "y"), ("nul", None, None, None, "null_test", None, 1, "x", "y"), (None, None, 1, None, "probe_val", None, 1, "x", "y"), ("late", None, 3, None, None, None, None, "x", "y"), ("late", None, None, None, "probe_val", None, 2, "x", "y")]
    return spark.createDataFrame(rows, FEATURES)


TARGETS = [(1, "head", "probe_train", 0.1, 2), (1, "head", "probe_val", 0.2, 2), (2, "tail", "probe_train", 0.5, 2), (2, "tail", "probe_val", 0.1, 2), (3, "tail", "probe_val", 0.1, 2), (7, "tail", "probe_val", 0.0, 3)]


def test_allocation_passes_quota_to_siblings_then_cousins():
    quota = {("t", 1, "a"): 50.0, ("t", 1, "b"): 10.0, ("t", 2, "a"): 20.0, ("h", 3, "a"): 20.0}
    room = {("t", 1, "a"): 10, ("t", 1, "b"): 100, ("t", 2, "a"): 100, ("h", 3, "a"): 100}
    drawn = lambda given: {k: a.drawn for k, a in given.items()}
    got = sampling.allocate(quota, {}, room, 100)
    assert drawn(got) == {("t", 1, "a"): 10, ("t", 1, "b"): 50, ("t", 2, "a"): 20, ("h", 3, "a"): 20}
    assert [a.unmet for a in got.values()] == [40.0, 0.0, 0.0, 0.0]
    room[("t", 1, "b")] = 5
    got = sampling.allocate(quota, {}, room, 100)
    assert drawn(got) == {("t", 1, "a"): 10, ("t", 1, "b"): 5, ("t", 2, "a"): 65, ("h", 3, "a"): 20}
    assert [a.unmet for a in got.values()] == [40.0, 5.0, 0.0, 0.0]
    small = sampling.allocate({k: v * 0.4 for k, v in quota.items()}, {("h", 3, "a"): 30, ("t", 1, "b"): 9}, room, 40)
    assert small[("h", 3, "a")].drawn >= 30 and sum(drawn(small).values()) == 40 and small[("t", 1, "b")].unmet == 4.0
    assert sampling.allocate({}, {}, {}, 10) == {}


def test_category_sample(spark):
    f = features(spark)
    targets = spark.createDataFrame(TARGETS, "class_id int, class_band string, probe_split string, target_share double, min_rows int")
    ids = {r["id"]: (r["class_id"], r["probe_split"]) for r in sampling.labelled_ids(f).collect()}
    assert len(ids) == 901 and ids["late"] == (3, "probe_val") and "nul" not in ids
    plan = {(r["class_id"], r["probe_split"]): r for r in sampling.category_plan(f, targets, part=2).collect()}
    for k, r in plan.items():
        assert r["available"] == sum(v == k for v in ids.values()) and r["drawn"] <= r["available"]
    assert plan[7, "probe_val"]["short_by"] == 3.0
    short = {tuple(r) for r in sampling.short_categories(f, targets, part=2).collect()}
    assert short == {k for k, r in plan.items() if r["available"] < r["wanted"]} and (7, "probe_val") in short
    drawn = sampling.draw_sample(f, targets, part=2).collect()
    count = {}
    for r in drawn:
        count[r["class_id"], r["probe_split"]] = count.get((r["class_id"], r["probe_split"]), 0) + 1
    assert all(count.get(k, 0) == r["drawn"] for k, r in plan.items())
    assert {r["id"] for r in sampling.draw_sample(f.repartition(9), targets, part=2).collect()} == {r["id"] for r in drawn}
    assert sampling.draw_sample(f.limit(0), targets).count() == 0 and sampling.short_categories(f, targets.limit(0)).count() == 0


def test_stable_sample_keeps_its_members(spark):
    f = features(spark)
    p = f.filter("id LIKE 'id%'").select("id", "family_id", "source_image_id")
    whole = {r["id"]: r["family_key"] for r in sampling.stable_sample(f, p, 0.3).collect()}
    assert 0.15 < len(whole) / 903 < 0.45
    keys = sampling.family_keys(f, p).collect()
    for b in (2, 5):
        part = {r["id"] for r in sampling.stable_sample(f.filter(F.col("batch_no") <= b), p, 0.3).collect()}
        assert part == set(whole) & {r["id"] for r in keys if r["first_batch"] and r["first_batch"] <= b}
    less = {r["id"] for r in sampling.stable_sample(f.repartition(5), p, 0.1).collect()}
    assert less <= set(whole)
    members = {}
    for r in keys:
        members.setdefault(r["family_key"], set()).add(r["id"])
    assert all(ids <= set(whole) or not ids & set(whole) for ids in members.values())
    positions = spark.range(40_000).select(sampling.bucket_position(F.col("id"), 8).alias("p")).groupBy("p").count()
    assert positions.count() == 256
    assert sampling.stable_sample(f.limit(0), p).count() == 0
    assert {r["first_batch"] for r in sampling.growth_report(f, p).collect()} >= set(range(1, 9))


DELIVERED = "id string, family_id string, source_image_id string, batch_no int, extracted_at timestamp, family string"
KNOWN = "id string, family_id string, source_image_id string, ingested_at timestamp, image string"


def deliveries(rng):
    """Feature rows and provenance rows of 8 batches: families, images and provenance come late, change, or come again."""
    day = lambda b, s=0: dt.datetime(2025, b, 1, 0, 0, s)
    feats, known = [], []
    for i in range(600):
        fam, image, b = f"f{i // 3}", f"IP{i // 3 % 150:09d}" if i % 4 else "IP000000777", rng.randint(1, 8)
        feats.append((f"id{i}", fam if rng.random() < 0.4 else None, image if rng.random() < 0.7 else None, b, day(b, 30), "x"))
        for _ in range(rng.choice((0, 1, 1, 2))):  # repeated, with another family or image
            late = rng.randint(b, 8)
            feats.append((f" ID{i}", rng.choice([fam, "other", None]), rng.choice([image, "IP000000999"]), late, day(late, 30), "x"))
        if rng.random() < 0.8:
            g = rng.randint(1, 8)
            known.append((f"id{i}", rng.choice([fam, None]), image, day(g, rng.choice((10, 40))), "y"))
            known.append((f"id{i}", fam, image, day(rng.randint(g, 8), 50), "y"))
    feats += [("late", None, None, None, None, "x"), ("late", "f1", None, 2, day(2), "x")]
    return feats, known, day


def test_members_stay_whatever_comes_late(spark):
    feats, known, day = deliveries(random.Random(1))
    before, ledger, undated = {}, None, {}
    for b in (1, 3, 8):
        f = spark.createDataFrame([r for r in feats if (r[3] or 8) <= b], DELIVERED)
        p = spark.createDataFrame([r for r in known if r[3] < day(b, 45)], KNOWN)
        now = {r["id"]: r["family_key"] for r in sampling.family_keys(f, p).collect()}
        assert now.items() >= before.items() and len(now) == len({r[0].strip().lower() for r in feats if (r[3] or 8) <= b})
        assert {r["id"] for r in sampling.stable_sample(f, p, 0.2).collect()} >= {r["id"] for r in sampling.stable_sample(f.filter(F.col("batch_no") <= 1), p, 0.2).collect()}
        before = now
        # without any arrival times the ledger of the last run alone holds the keys
        bare = sampling.family_keys(f.drop("extracted_at"), p.drop("ingested_at"), ledger)
        kept = bare.collect()
        ledger = spark.createDataFrame(kept, bare.schema)
        assert len(kept) == len(now) and {r["id"]: r["family_key"] for r in kept}.items() >= undated.items()
        undated = {r["id"]: r["family_key"] for r in kept}


def test_later_name_takes_on_the_key_seen_before(spark):
    rows = [("a", None, "IP000000001", 1), ("b", "f1", "IP000000001", 2), ("c", "f1", None, 3), ("d", "f2", "IP000000002", 1), ("e", None, "IP000000002", 2), ("g", None, None, 1)]
    provenance = spark.createDataFrame([], "id string, family_id string, source_image_id string")
    make = lambda r: spark.createDataFrame(r, "id string, family_id string, source_image_id string, batch_no int")
    want = {"a": "IP000000001", "b": "IP000000001", "c": "IP000000001", "d": "f2", "e": "f2", "g": "g"}
    assert {r["id"]: r["family_key"] for r in sampling.family_keys(make(rows), provenance).collect()} == want
    ledger = None
    for b in (1, 2, 3):
        out = sampling.family_keys(make([r for r in rows if r[3] <= b]), provenance, ledger)
        ledger = spark.createDataFrame(out.collect(), out.schema)
    assert {r["id"]: r["family_key"] for r in ledger.collect()} == want


def test_late_family_moves_no_id(spark):
    rows = [("a", None, "IP000000001", 1), ("b", "f2", None, 1), ("c", None, None, 2), ("d", None, None, 3), ("d", "f4", None, 3)]
    late = [("a", "f1", "IP000000000", 2), ("b", "f0", None, 3), ("c", "f3", "IP000000002", 4)]
    provenance = spark.createDataFrame([], "id string, family_id string, source_image_id string")
    keys = lambda r: {x["id"]: x["family_key"] for x in sampling.family_keys(spark.createDataFrame(r, "id string, family_id string, source_image_id string, batch_no int"), provenance).collect()}
    before = keys(rows)
    assert keys(rows + late) == before and before["d"] == "f4"


def test_ranks_are_dense_whatever_the_buckets(spark, monkeypatch):
    f = spark.createDataFrame([(f"a{i}", 1, "probe_train", 1) for i in range(500)], "id string, class_id int, probe_split string, batch_no int")
    targets = spark.createDataFrame([(1, "head", "probe_train", 1.0, 0)], "class_id int, class_band string, probe_split string, target_share double, min_rows int")
    draw = lambda: {r["draw_rank"]: r["id"] for r in sampling.draw_sample(f, targets, part=2).collect()}
    whole = draw()
    monkeypatch.setattr(sampling, "RANKED_IDS", 3)
    assert draw() == whole and set(whole) == set(range(1, 251))


def test_report_tells_what_is_not_drawn(spark):
    rows = [(f"a{i}", 1, "probe_train", 1) for i in range(30)] + [(f"b{i}", 2, "probe_train", 1) for i in range(30)]
    f = spark.createDataFrame(rows, "id string, class_id int, probe_split string, batch_no int")
    targets = spark.createDataFrame([(1, "head", "probe_train", 0.5, 6), (2, "tail", "probe_train", 0.5, 0)], "class_id int, class_band string, probe_split string, target_share double, min_rows int")
    report = {(r["class_band"], r["class_id"]): (r["available"], r["wanted"], r["drawn"], r["short_by"], r["undrawn"]) for r in sampling.category_report(f, targets).collect()}
    assert report == {("head", 1): (30, 6.0, 6, 0.0, 0.0), ("tail", 2): (30, 3.0, 0, 0.0, 3.0), ("head", None): (30, 6.0, 6, 0.0, 0.0), ("tail", None): (30, 3.0, 0, 0.0, 3.0)}
