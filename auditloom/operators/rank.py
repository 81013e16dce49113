"""Ranks and running sums of ordered groups, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint


def running_before(df: DataFrame, keys: list[str], order: list[str | Column], weight: Column | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` (1 per row by default) over the rows that come before in its group.

    Rows are range-partitioned by group and order, each range is summed, and the sums
    of earlier ranges of the group are added: a group of any size is spread over
    tasks, where a plain window would sort it in one. Order columns should be unique
    within a group; of equal ones the order is open. Null keys are a group.
    """
    g = [f"__rb_g{i}" for i in range(len(keys))]
    prepared = df.withColumns({"__rb_w": F.lit(1) if weight is None else weight, **{n: F.col(k) for n, k in zip(g, keys)}})
    sort = [c if isinstance(c, Column) else F.col(c) for c in order]
    ranged = checkpoint(prepared.repartitionByRange(*[F.col(n) for n in g], *sort).withColumn("__rb_p", F.spark_partition_id()))
    parts = ranged.groupBy(*g, "__rb_p").agg(F.sum("__rb_w").alias("__rb_s"))
    earlier = Window.partitionBy(*g).orderBy("__rb_p").rowsBetween(Window.unboundedPreceding, -1)
    prior = parts.select(*[F.col(n).alias(f"{n}r") for n in g], F.col("__rb_p").alias("__rb_pr"), F.coalesce(F.sum("__rb_s").over(earlier), F.lit(0)).alias("__rb_before"))
    on = F.col("__rb_p") == F.col("__rb_pr")
    for n in g:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}r"))
    inside = Window.partitionBy(*g, "__rb_p").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(prior, on).withColumn(name, F.col("__rb_before") + F.coalesce(F.sum("__rb_w").over(inside), F.lit(0)))
    return out.drop("__rb_w", "__rb_p", "__rb_pr", "__rb_before", *g, *[f"{n}r" for n in g])


def midranks(df: DataFrame, value: str, *keys: str, name: str = "rank") -> DataFrame:
    """(keys, value, rank) of each distinct value: the mean of the ranks its rows have; nulls are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return running_before(counts, list(keys), [value], F.col("_n"), "_b").select(*keys, value, (F.col("_b") + (F.col("_n") + 1) / 2).alias(name))


def auroc(df: DataFrame, score: str, label: str, *groups: str) -> DataFrame:
    """Area under the ROC curve per group from midranks; null where one class is missing. Equal scores are counted first."""
    per = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*groups, score).agg(F.count_if(F.col(label)).alias("_p"), F.count_if(~F.col(label)).alias("_n"))
    below = running_before(per, list(groups), [score], F.col("_n"), "_below")
    agg = below.groupBy(*groups).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_w"), F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    return agg.select(*groups, F.try_divide("_w", F.col("_ps") * F.col("_ns")).alias("auroc"))


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Per key the correlation of midranks and the number of rows; null without variance.

    Rows of equal pairs are counted first and ranks are joined by value.
    """
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = known.groupBy(*keys, x, y).agg(F.count("*").alias("_c"))
    rx, ry = midranks(known, x, *keys, name="_rx"), midranks(known, y, *keys, name="_ry")
    r = cells.join(rx, [*keys, x]).join(ry, [*keys, y])
    n, sx, sy = F.sum("_c"), F.sum(F.expr("_c * _rx")), F.sum(F.expr("_c * _ry"))
    cov = F.sum(F.expr("_c * _rx * _ry")) - sx * sy / n
    var = F.sqrt((F.sum(F.expr("_c * _rx * _rx")) - sx * sx / n) * (F.sum(F.expr("_c * _ry * _ry")) - sy * sy / n))
    return r.groupBy(*keys).agg(F.try_divide(cov, var).alias("spearman"), n.alias("n"))
