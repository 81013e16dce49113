"""Resampling by cluster: rows are summed per cluster first, then weighed per repetition."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import checkpoint

#: Draws that the driver makes at most (clusters of all groups times repetitions); beyond, weights are Poisson.
MOST_DRAWS = 3_000_000


def draw_table(clusters: DataFrame, cluster: str, reps: int, seed: int, *keys: str) -> DataFrame:
    """(keys, rep, cluster, weight): how often each of the sorted clusters of a group is drawn in a repetition.

    Draws are those of Python's generator over the group's sorted list of clusters,
    made on the driver; for evaluations of bounded size (reps times clusters rows).
    """
    lists: dict[tuple, list] = {}
    for r in clusters.select(*keys, cluster).filter(f"{cluster} IS NOT NULL").distinct().orderBy(cluster).collect():
        lists.setdefault(tuple(r)[:-1], []).append(r[-1])
    kinds = [*((k, clusters.schema[k].dataType) for k in keys), ("rep", IntegerType()), (cluster, clusters.schema[cluster].dataType), ("weight", IntegerType())]
    schema = to_arrow_schema(StructType([StructField(n, t) for n, t in kinds]))
    tables = []
    for key, names in lists.items():
        n = len(names)
        held = np.bincount((np.arange(reps)[:, None] * n + python_choices(n, reps * n, seed).reshape(reps, n)).ravel(), minlength=reps * n)
        at = np.flatnonzero(held)
        columns = [*(pa.repeat(pa.scalar(v, schema.field(k).type), len(at)) for k, v in zip(keys, key, strict=True)), pa.array(at // n, pa.int32()), pa.array(names, schema.field(cluster).type).take(pa.array(at % n)), pa.array(held[at], pa.int32())]
        tables.append(pa.Table.from_arrays(columns, schema=schema))
    return clusters.sparkSession.createDataFrame(pa.concat_tables(tables) if tables else schema.empty_table())


def python_choices(n: int, count: int, seed: int) -> np.ndarray:
    """The first ``count`` places that ``random.Random(seed).choice`` draws among ``n``, made at once.

    The generator takes as many high bits of a 32-bit word as n has, and draws again while they are n or more.
    """
    state = random.Random(seed).getstate()[1]
    words, bits, out, have = np.random.RandomState(), n.bit_length(), [], 0
    words.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    while have < count:
        raw = words._bit_generator.random_raw(int((count - have) * 2**bits / n) + 64) >> np.uint64(32 - bits)
        out.append(raw[raw < n])
        have += len(out[-1])
    return np.concatenate(out)[:count].astype(np.int64) if out else np.zeros(0, np.int64)


def poisson_draws(sums: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """``sums`` with (rep, weight): Poisson(1) weights from hashes, for any number of clusters and without the driver."""
    u = (F.pmod(F.xxhash64(F.col(cluster), F.col("rep"), F.lit(seed)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    steps, total, term = F.lit(0), 0.0, float(np.exp(-1))
    for k in range(12):
        total += term
        steps = steps + F.when(u > total, 1).otherwise(0)
        term /= k + 1
    # a few sums make many rows: they are spread over all cores first
    spread = sums.repartition(max(sums.sparkSession.sparkContext.defaultParallelism, 8), cluster)
    return spread.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("weight", steps).filter("weight > 0")


def weighed(sums: DataFrame, cluster: str, reps: int, seed: int, *keys: str) -> DataFrame:
    """``sums`` (rows per cluster and keys) with (rep, weight): the driver's draws, or Poisson weights beyond MOST_DRAWS.

    Every group of the keys draws from its own clusters; under one seed equal lists get
    equal draws. Rows without a cluster are in no draw.
    """
    sums = sums.filter(F.col(cluster).isNotNull())
    if sums.select(*keys, cluster).distinct().count() * reps <= MOST_DRAWS:
        draws = draw_table(sums, cluster, reps, seed, *keys)
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in (*keys, cluster)]
        return sums.alias("s").join(draws.alias("d"), same).select("s.*", "d.rep", "d.weight")
    return poisson_draws(sums, cluster, reps, seed)


def interval(values: DataFrame, value: str, *keys: str, level: float = 0.95) -> DataFrame:
    """Percentile interval with linear interpolation."""
    a = (1 - level) / 2
    return values.groupBy(*keys).agg(F.percentile(value, a).alias("low"), F.percentile(value, 1 - a).alias("high"), F.count(value).alias("reps"))


def rate_interval(df: DataFrame, cluster: str, flag: Column, *keys: str, reps: int = 1000, seed: int = 0, draws: DataFrame | None = None) -> DataFrame:
    """(keys, estimate, low, high, reps) of a rate, resampling clusters.

    Per cluster only hits and rows are kept; the estimate is over the rows as they are.
    """
    sums = checkpoint(df.groupBy(cluster, *keys).agg(F.count_if(flag).alias("h"), F.count("*").alias("n")))
    drawn = weighed(sums, cluster, reps, seed, *keys) if draws is None else sums.join(draws, cluster)
    rates = drawn.groupBy("rep", *keys).agg((F.sum(F.col("h") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("rate"))
    estimate = sums.groupBy(*keys).agg((F.sum("h") / F.sum("n")).alias("estimate"))
    ci = interval(rates, "rate", *keys)
    return estimate.join(ci, list(keys)) if keys else estimate.crossJoin(ci)


def paired_delta_interval(pairs: DataFrame, cluster: str, left: Column, right: Column, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Interval of the difference of two rates under the same draws: estimate is right minus left."""
    sums = checkpoint(pairs.groupBy(cluster).agg(F.sum(right.cast("double") - left.cast("double")).alias("d"), F.count("*").alias("n")))
    values = weighed(sums, cluster, reps, seed).groupBy("rep").agg((F.sum(F.col("d") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("delta"))
    return sums.agg((F.sum("d") / F.sum("n")).alias("estimate")).crossJoin(interval(values, "delta"))


def macro_f1_interval(df: DataFrame, cluster: str, truth: str, predicted: str, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Interval of macro F1: confusion cells per cluster are weighed, so rows are read once."""
    from .aggregate import safe_divide

    cells = checkpoint(df.groupBy(cluster, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n")))
    drawn = weighed(cells, cluster, reps, seed).withColumn("n", F.col("n") * F.col("weight"))
    both = drawn.unionByName(cells.withColumn("rep", F.lit(-1)).withColumn("weight", F.lit(1)))
    side = F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("a"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(True).alias("truth")), F.struct(F.col("p").alias("c"), F.col("n").alias("a"), F.lit(0).cast("long").alias("tp"), F.lit(False).alias("truth"))))
    per = both.select("rep", side.alias("s")).filter("s.c IS NOT NULL").groupBy("rep", "s.c").agg(F.sum("s.a").alias("a"), F.sum("s.tp").alias("tp"), F.sum(F.when(F.col("s.truth"), F.col("s.a")).otherwise(0)).alias("t")).filter("t > 0")
    scores = per.groupBy("rep").agg(F.avg(safe_divide(2 * F.col("tp"), F.col("a"))).alias("v"))
    return scores.agg(F.max(F.when(F.col("rep") < 0, F.col("v"))).alias("estimate"), F.percentile(F.when(F.col("rep") >= 0, F.col("v")), 0.025).alias("low"), F.percentile(F.when(F.col("rep") >= 0, F.col("v")), 0.975).alias("high"), F.count_if(F.col("rep") >= 0).alias("reps"))


def two_population_interval(a: DataFrame, b: DataFrame, cluster: str, flag_a: Column, flag_b: Column, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Interval of the difference of two rates with independent draws for each population."""
    sums = lambda df, flag: checkpoint(df.groupBy(cluster).agg(F.count_if(flag).alias("h"), F.count("*").alias("n")))
    rate = lambda s, at, name: weighed(s, cluster, reps, at).groupBy("rep").agg((F.sum(F.expr("h * weight")) / F.sum(F.expr("n * weight"))).alias(name))
    sa, sb = sums(a, flag_a), sums(b, flag_b)
    ra, rb = rate(sa, seed, "x"), rate(sb, seed + 1, "y")
    estimate = sa.agg((F.sum("h") / F.sum("n")).alias("_a")).crossJoin(sb.agg((F.sum("h") / F.sum("n")).alias("_b"))).select((F.col("_a") - F.col("_b")).alias("estimate"))
    return estimate.crossJoin(interval(ra.join(rb, "rep").withColumn("d", F.col("x") - F.col("y")), "d"))


def bootstrap_statistic(df: DataFrame, columns: list[str], statistic: Callable[[pd.DataFrame], float], reps: int = 1000, seed: int = 0, per_task: int = 50) -> DataFrame:
    """(rep, value) of any statistic over resampled rows; repetitions are spread over tasks, rows must fit one.

    The generic form for statistics that no sums express, on evaluation tables of
    bounded size; the rows are broadcast.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(df.select(*columns).toPandas().sort_values(columns, ignore_index=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = shared.value
        for pdf in batches:
            out = []
            for rep in pdf["rep"]:
                pick = np.random.default_rng((seed, int(rep))).integers(0, len(data), len(data)) if len(data) else []
                out.append(float(statistic(data.iloc[pick])) if len(data) else None)
            yield pd.DataFrame({"rep": pdf["rep"], "value": out})

    tasks = max(1, -(-reps // per_task))
    return spark.range(reps, numPartitions=tasks).select(F.col("id").cast("int").alias("rep")).mapInPandas(run, "rep int, value double")
