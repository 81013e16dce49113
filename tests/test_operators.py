import itertools
import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from auditloom.functions import geometry, hashing, json_contract, stats, text
from auditloom.operators import aggregate, bootstrap, gates, graph, joins, probe, select, skew
from auditloom.operators.rank import auroc, running_before, spearman


def test_strict_join_fails_on_repeats_and_gaps(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, b string")
    assert {tuple(r) for r in joins.strict_join(a, b, "k").collect()} == {(1, "x", "p"), (2, "y", "q")}
    for bad in ([(1, "p")], [(1, "p"), (2, "q"), (2, "q")], [(1, "p"), (2, "q"), (3, "r")], [(1, "p"), (2, "q"), (None, "r")]):
        with pytest.raises(PySparkException):
            joins.strict_join(a, spark.createDataFrame(bad, "k int, b string"), "k").collect()
    assert joins.strict_join(a.limit(0), b.limit(0), "k").count() == 0


def test_salted_join_keeps_all_rows(spark):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), (None, 2), ("none", 3)], "k string, v int")
    small = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("cold", "c")], "k string, w string")
    hot = skew.hot_keys(big.groupBy("k").agg(F.count("*").alias("n")).filter("n > 100"), "k", "n", 503)
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(repr, skew.salted_join(big, small, "k", hot, F.col("v"), how).select("k", "v").collect())) == sorted(map(repr, big.join(small, "k", how).select("k", "v").collect()))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(200)]
    star = [("z", f"s{i:03d}") for i in range(100)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(chain + star + [("q", "q"), (None, "x")], "a string, b string")).collect()))
    assert {got[x] for e in chain for x in e} == {"n0000"}
    assert {got[x] for e in star for x in e} == {"s000"}
    assert "x" not in got
    digest = {r["component"]: (r["component_id"], r["size"]) for r in graph.component_digest(spark.createDataFrame([("a", "a"), ("b", "a")], "node string, component string")).collect()}
    import hashlib

    assert digest == {"a": (hashlib.sha256(b"a\nb").hexdigest()[:24], 2)}


def test_exact_assignment_balances_or_reports(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        positive = rng.choice([1, 2, 3, 4])
        rows.append(("train", "t0", f"f{i:03d}", positive, sorted({positive, rng.choice([1, 2, 3, 4])})))
    rows += [("dev", "t0", "x", 1, [1]), ("dev", "t0", "y", 1, [1])]
    out = graph.exact_absent_assignment(spark.createDataFrame(rows, "split string, template string, family string, positive int, present array<int>"), ["split", "template"]).collect()
    train = [r for r in out if r["split"] == "train"]
    if all(r["status"] == "assigned" for r in train):
        shown = {r[2]: set(r[4]) for r in rows}
        assert all(r["absent_class"] not in shown[r["family"]] for r in train)
        assert sorted(r["absent_class"] for r in train) == sorted(r[3] for r in rows if r[0] == "train")
    assert [(r["status"], r["family"], r["deficit"]) for r in out if r["split"] == "dev"] == [("infeasible", None, 2)]


def test_near_hash_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 0, 2, 4, 5)]
    rows = [(i, v - (1 << 64) if v >= 1 << 63 else v, i % 2) for i, v in enumerate(values)]
    pairs, members = joins.near_hash_pairs(spark.createDataFrame(rows + [(99, None, 0)], "id int, h long, g int"), "id", "h", "g")
    cls = dict(map(tuple, members.collect()))
    want = {tuple(sorted((cls[i], cls[j]))) for (i, a, g), (j, b, k) in itertools.combinations(rows, 2) if g != k and (a ^ b) & (2**64 - 1) and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    same = {tuple(sorted((cls[i], cls[j]))) for (i, a, g), (j, b, k) in itertools.combinations(rows, 2) if g != k and a == b}
    assert {(r["left"], r["right"]) for r in pairs.collect()} == want | same


def test_nearest_rows_in_blocks(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(m)] + [(60, None, 0)], "id int, v array<double>, label int")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in joins.nearest_rows(df.filter("id % 20 = 0"), df, "id", "v", "label", k=2, block=2).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        order = [j for j in np.argsort(-(unit @ unit[q])) if j != q][:2]
        assert [got[q, 1], got[q, 2]] == order
    assert joins.nearest_rows(df.limit(0), df, "id", "v", "label").count() == 0


def test_bootstrap_equals_plain_python(spark):
    rng = random.Random(4)
    rows = [(f"c{i % 7}", rng.random() < 0.4) for i in range(80)]
    df = spark.createDataFrame(rows, "c string, hit boolean")
    got = bootstrap.rate_interval(df, "c", F.col("hit"), reps=50, seed=9).first()
    names = sorted({c for c, _ in rows})
    r, rates = random.Random(9), []
    for _ in range(50):
        drawn = [x for name in [r.choice(names) for _ in names] for c, x in rows if c == name]
        rates.append(sum(drawn) / len(drawn))
    assert got["estimate"] == pytest.approx(sum(h for _, h in rows) / 80)
    assert got["low"] == pytest.approx(np.quantile(rates, 0.025)) and got["high"] == pytest.approx(np.quantile(rates, 0.975))
    weights = bootstrap.poisson_draws(spark.range(300).withColumnRenamed("id", "k"), "k", 20, 1).agg((F.sum("weight") / 6000).alias("m")).first()["m"]
    assert weights == pytest.approx(1.0, abs=0.05)


def test_exact_tests():
    assert stats.mcnemar_p(0, 0) == 1.0
    assert stats.mcnemar_p(1, 9) == pytest.approx(2 * (1 + 10) / 1024)
    assert stats.clopper_pearson(0, 10) == (0.0, pytest.approx(0.30849711))
    assert stats.clopper_pearson(10, 10)[1] == 1.0
    low, high = stats.clopper_pearson(24, 290)
    assert (low, high) == (pytest.approx(0.0537, abs=1e-3), pytest.approx(0.1206, abs=1e-3))


def test_auroc_and_spearman_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(round(rng.random(), 1), rng.random() < 0.5) for _ in range(60)]
    got = auroc(spark.createDataFrame(rows + [(None, True)], "s double, y boolean"), "s", "y").first()["auroc"]
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert got == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)))
    assert auroc(spark.createDataFrame([(0.1, True)], "s double, y boolean"), "s", "y").first()["auroc"] is None
    same = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)], "x double, y double")
    assert spearman(same, "x", "y").first()["spearman"] == pytest.approx(1.0)


def test_running_before(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.randint(0, 5)) for i in rng.sample(range(500), 300)]
    df = spark.createDataFrame(rows, "g string, v int, w int")
    got = {r["v"]: r["before"] for r in running_before(df, ["g"], ["v"], F.col("w")).collect()}
    assert got == {v: sum(w2 for g2, v2, w2 in rows if g2 == g and v2 < v) for g, v, _ in rows}
    down = {r["v"]: r["before"] for r in running_before(df, [], [F.desc("v")]).collect()}
    assert down == {v: sum(v2 > v for _, v2, _ in rows) for _, v, _ in rows}
    assert running_before(df.limit(0), ["g"], ["v"]).count() == 0


def test_macro_f1_variants(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, None), (None, 3)], "t int, p int")
    own = aggregate.macro_f1(df, "t", "p").first()
    assert own["labels"] == 2 and own["macro_f1"] == pytest.approx((2 / 3 + 1 / 2) / 2)
    fixed = aggregate.macro_f1(df, "t", "p", labels=spark.createDataFrame([(1,), (2,), (7,)], "c int")).first()
    assert fixed["labels"] == 3 and fixed["macro_f1"] == pytest.approx((2 / 3 + 1 / 2) / 3)


ANSWER = '{"evidence_present":true,"evidence_region":[1,2,3,4],"visible_attributes":[],"diagnosis":{"status":"supported","pest_id":3,"pest_name":"x","species":null,"stage":null},"reliability":"supported"}'


@pytest.mark.parametrize(
    ("text_", "levels"),
    [
        (ANSWER, (True, True, True)), (ANSWER + " trailing", (False, False, False)), (ANSWER.replace('"', "'"), (False, False, False)), (None, (False, False, False)), ("[1]", (False, False, False)),
        (ANSWER.replace('"evidence_present":true,', "") , (True, False, False)), (ANSWER.replace("[1,2,3,4]", "[3,2,1,4]"), (True, True, False)), (ANSWER.replace("true", "1"), (True, False, False)), (ANSWER.replace('"pest_id":3', '"pest_id":true'), (True, True, False)),
        ('{"reliability":"supported",' + ANSWER[1:].replace(',"reliability":"supported"', ""), (True, False, False)),
    ],
)
def test_strict_levels(text_, levels):
    r = json_contract.parse_answer(text_)
    assert (r["syntax"], r["schema_ok"], r["semantic"]) == levels
    assert json_contract.parse_answer(f"prose {ANSWER} tail", tolerant=True)["semantic"]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(text.safe_divide(F.lit(1), F.lit(0))) == 0.0
    assert value(text.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("z"))) == "z"
    assert value(text.strip_fence(F.lit("```json\n{}\n```"))) == "{}"
    assert value(text.has_media_suffix(F.lit("https://a.b/c.JPG?x=.gif"))) is True
    assert value(text.image_size(F.lit("12x"))) is None
    assert value(text.unique_subsequence(F.array(*map(F.lit, [1, 2, 1, 2])), F.array(F.lit(1), F.lit(2)))) is None
    assert value(text.unique_subsequence(F.array(*map(F.lit, [3, 1, 2])), F.array(F.lit(1), F.lit(2)))) == 1
    raw = '{"a":1,"pest":"x y","b":2}'
    span = value(text.value_span(F.lit(raw), "pest"))
    assert raw[span["start"] : span["end"]] == '"x y"'
    assert value(text.name_at_id(F.lit("4|7"), F.lit("a|b"), F.lit(7))) == "b"
    assert value(text.class_label(F.lit(7))) == "IP007"
    with pytest.raises(PySparkException):
        value(text.class_label(F.lit(7), [1]))
    assert value(hashing.git_blob_sha1(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert json_contract.flatten_json('{"a":{"b":[1,2]},"c":"x"}') == ["a.b=[1,2]", "c=x"]


def test_geometry(spark):
    one = spark.range(1)
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(geometry.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert value(geometry.iou(box(0, 0, 0, 2), box(1, 1, 3, 3))) == 0.0
    assert value(geometry.valid_box(F.lit(None).cast("array<double>"))) is False
    assert value(geometry.centre_inside(box(0, 0, 2, 2), box(1, 1, 3, 3))) is True
    assert value(geometry.touches(box(0, 0, 1, 1), box(1, 0, 2, 1))) is False
    assert value(geometry.grid_cells(box(0, 0, 1, 1), 4, 4, 100, 100)) == [0]
    assert value(geometry.expanded(box(10, 10, 20, 20), 0.5, 22, 100)) == [5, 5, 22, 25]
    on = np.zeros((6, 6), bool)
    on[0, 0] = on[2, 2] = on[3, 3] = on[4, 2] = True
    assert geometry.largest_component_box(on) == [2, 2, 4, 5]


def test_selection(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "v int, g int")
    for parts in (1, 7):
        assert sorted(map(tuple, select.hash_top_k(df.repartition(parts), "v", ["g"], 4, "n").collect())) == sorted(map(tuple, select.hash_top_k(df, "v", ["g"], 4, "n").collect()))
    assert sorted(r["v"] for r in select.even_picks(df.filter("g = 0"), ["g"], ["v"], 3).collect()) == [0, 12, 27]
    assert [r["v"] for r in select.even_picks(df.filter("g = 0"), ["g"], ["v"], 1).collect()] == [12]
    assert [r["v"] for r in select.round_robin(df, "g", "v", 4).collect()] == [0, 1, 2, 3]
    assert {r["v"] for r in select.python_random_sample(df, "g", "v", 2, 5).filter("g = 1").collect()} == set(random.Random("5:1").sample(list(range(1, 30, 3)), 2))


def test_gates(spark):
    g = gates.gates_table(spark, [("a", ">=", 1.0), ("b", "<", 2.0)])
    for values, want in ((((1.0), (1.9)), ("PASS", "")), (((0.9), (1.9)), ("FAIL", "a")), (((1.0), (2.0)), ("FAIL", "b"))):
        m = spark.createDataFrame([("a", values[0]), ("b", values[1])], "gate string, value double")
        assert tuple(gates.decision(gates.judged(m, g)).first()) == want
    assert gates.decision(gates.judged(m.limit(0), g)).first()["decision"] == "FAIL"
    assert gates.decision(gates.judged(m, g.limit(0))).first()["decision"] == "FAIL"
    rows = spark.createDataFrame([("r1", "train", "d1", "c1"), ("r1", "train", "d1", "c1"), ("r2", "dev", "d2", "c1")], "id string, split string, digest string, component string")
    found = gates.leakage_rules(rows, "id", "split", "digest", "component")
    assert sorted(map(tuple, found.collect())) == [("component_across_splits", False, "c1"), ("repeated_id", True, "r1")]
    with pytest.raises(PySparkException):
        gates.enforced(rows, found).collect()
    assert gates.enforced(rows, found.filter("NOT hard")).count() == 3
    assert gates.run_state(3, 2, 0) == "WAITING" and gates.run_state(3, 3, 0) == "READY" and gates.run_state(3, 3, 1) == "BLOCKED"
    assert gates.check_config({"seed": True, "x": 1}, {"seed": int, "rate": float}, {}) == ["missing rate", "type seed", "unknown x"]


def test_probes(spark):
    rows = [(i, "leak word" if i % 2 else "plain word", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, label int")
    got = {r["id"]: r["predicted"] for r in probe.naive_bayes(df.filter("id < 30"), df.filter("id >= 30"), "id", "text", "label").collect()}
    assert got == {i: i % 2 for i in range(30, 40)}
    scored = probe.tfidf_logistic(df.filter("id < 30"), df.filter("id >= 30"), "id", "text", "label")
    assert all((r["score"] > 0.5) == (r["id"] % 2 == 1) for r in scored.collect())
    v = spark.createDataFrame([(i, [float(i % 3 == k) + 0.01 * i for k in range(3)], i % 3 + 5) for i in range(60)], "id int, v array<double>, y int")
    assert all(r["predicted"] == r["id"] % 3 + 5 for r in probe.linear_probe(v, v, "id", "v", "y", c=100.0).collect())
    s = spark.createDataFrame([(0.2, False), (0.4, False), (0.6, True), (0.9, True)], "s double, y boolean")
    best = probe.best_threshold(s, "s", F.col("y")).first()
    assert best["threshold"] == pytest.approx(0.41) and best["balanced_accuracy"] == 1.0
    pooled = probe.mean_pooled(spark.createDataFrame([("a", [3.0, 0.0]), ("a", [3.0, 8.0]), ("b", None), ("z", [0.0, 0.0])], "k string, v array<double>"), "k", "v")
    assert {r["k"]: r["v"] for r in pooled.collect()} == {"a": [pytest.approx(0.6), pytest.approx(0.8)], "z": None}


def test_perceptual_hashes_move_little(spark):
    rng = np.random.default_rng(5)
    a = np.kron(rng.integers(0, 255, (8, 9)), np.ones((8, 8), int)).astype(np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-2, 3, a.shape), 0, 255).astype(np.uint8)
    c = rng.integers(0, 255, a.shape).astype(np.uint8)
    df = spark.createDataFrame([(i, 72, 64, bytearray(x.tobytes())) for i, x in enumerate((a, b, c))] + [(3, 72, 64, None)], "id int, width int, height int, data binary")
    h = {r["id"]: r for r in probe.perceptual_hashes(df, "id").collect()}
    far = lambda x, y: bin((h[x]["dhash"] ^ h[y]["dhash"]) & (2**64 - 1)).count("1")
    assert far(0, 1) <= 6 < far(0, 2)
    assert h[3]["dhash"] is None
    kinds = {k: {r["id"]: r["data"] for r in probe.perturbed(df.limit(3), "id", k).collect()} for k in ("blank", "blur", "shuffle", "noise")}
    assert len(set(kinds["blank"][0])) == 1 and sorted(kinds["shuffle"][0]) == sorted(a.tobytes())


def test_message_text_handles_nulls(spark):
    rows = [(1, json.dumps([{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "image": "x"}, {"type": "text", "text": None}]}])), (2, None)]
    m = spark.createDataFrame(rows, "id int, j string").select("id", F.from_json("j", "array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>").alias("m"))
    assert {r["id"]: r["t"] for r in m.select("id", text.message_text(F.col("m"), ("user",)).alias("t")).collect()} == {1: "a", 2: None}
