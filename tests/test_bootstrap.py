"""The registered bootstraps: 1,000 repetitions over families, alike with drawn and with Poisson weights."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import bootstrap
from auditloom.plans import registry, statistic_queries


def test_every_interval_has_a_thousand_repetitions(spark, sf_dir):
    for name, q in registry.queries().items():
        if name[:3] in {f"j0{n}" for n in range(1, 8)}:
            assert {r["reps"] for r in q(spark, sf_dir).select("reps").collect()} == {1000}, name


def test_clusters_are_families(spark, sf_dir):
    o = statistic_queries._with_cluster(spark, sf_dir).select("id", "cluster", "family_id", "query_class_id", F.col("parsed").cast("double").alias("l"), F.col("schema_ok").cast("double").alias("r")).toPandas()
    assert o.id.is_unique and o.cluster.notna().all()
    assert (o.cluster == o.family_id)[o.family_id.notna()].all()
    names, rng, values = sorted(o.cluster.unique()), random.Random(29), []
    sums = o.assign(d=o.r - o.l).groupby("cluster").agg(d=("d", "sum"), n=("d", "size"))
    for _ in range(1000):
        picked = sums.loc[[rng.choice(names) for _ in names]]
        values.append(picked.d.sum() / picked.n.sum())
    got = registry.queries()["j02_paired_delta"](spark, sf_dir).first()
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.percentile(values, [2.5, 97.5])))


def test_each_group_draws_from_its_own_clusters(spark):
    rows = [(f"c{i}", "a", i % 3 == 0) for i in range(9)] + [(f"c{i}", "b", i % 2 == 0) for i in range(3, 7)]
    df = spark.createDataFrame(rows, "c string, k string, hit boolean")
    both = {r["k"]: (r["low"], r["high"]) for r in bootstrap.rate_interval(df, "c", F.col("hit"), "k", reps=60, seed=4).collect()}
    for k in "ab":
        alone = bootstrap.rate_interval(df.filter(F.col("k") == k), "c", F.col("hit"), reps=60, seed=4).first()
        assert both[k] == pytest.approx((alone["low"], alone["high"]))


def test_many_clusters_get_poisson_weights(spark, monkeypatch):
    df = spark.range(600).select(F.col("id").cast("string").alias("c"), (F.col("id") % 3 == 0).alias("hit"))
    drawn = bootstrap.rate_interval(df, "c", F.col("hit"), reps=1000, seed=1).first()
    monkeypatch.setattr(bootstrap, "MOST_DRAWS", 1000)
    monkeypatch.setattr(bootstrap, "draw_table", None)
    poisson = bootstrap.rate_interval(df, "c", F.col("hit"), reps=1000, seed=1).first()
    assert poisson["reps"] == 1000 and poisson["estimate"] == drawn["estimate"]
    assert (poisson["low"], poisson["high"]) == pytest.approx((drawn["low"], drawn["high"]), abs=0.012)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_choices_are_those_of_the_plain_generator(n):
    rng = random.Random(n + 5)
    assert bootstrap.python_choices(n, 3000, n + 5).tolist() == [rng.choice(range(n)) for _ in range(3000)]
