"""Counts, overlaps, confusion and the composite metrics of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import safe_divide, share


def nested_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def length_summary(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Per key: n, least, greatest, mean and median length, and the number of lengths; null texts do not count."""
    size = F.length(text)
    return df.filter(f"{text} IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.min(size).alias("min_len"), F.max(size).alias("max_len"), F.avg(size).alias("mean_len"), F.percentile(size, 0.5).alias("median_len"), F.count_distinct(size).alias("n_len"))


def overlap_across(df: DataFrame, value: str, group: str) -> DataFrame:
    """Values in more than one group: value, groups, pairs (the number of group pairs that share it)."""
    n = F.count_distinct(group)
    return df.filter(f"{value} IS NOT NULL AND {group} IS NOT NULL").groupBy(value).agg(n.alias("groups")).filter("groups > 1").withColumn("pairs", (F.col("groups") * (F.col("groups") - 1) / 2).cast("long"))


def confusion(df: DataFrame, truth: str, predicted: str, *keys: str) -> DataFrame:
    """Counts of truth and prediction; a null prediction is INVALID."""
    return df.groupBy(*keys, F.col(truth).cast("string").alias("truth"), F.coalesce(F.col(predicted).cast("string"), F.lit("INVALID")).alias("predicted")).agg(F.count("*").alias("n"))


def macro_f1(df: DataFrame, truth: str, predicted: str, *keys: str, labels: DataFrame | None = None) -> DataFrame:
    """Macro F1 per key from one confusion aggregate.

    Without ``labels`` the classes that occur as truth count; with ``labels`` (one
    column) exactly those, absent ones as 0. Null predictions are wrong; null truths
    support no class but count against the predicted one.
    """
    cells = df.groupBy(*keys, F.col(truth).alias("_t"), F.col(predicted).alias("_p")).agg(F.count("*").alias("_n"))
    side = F.explode(F.array(F.struct(F.col("_t").alias("c"), F.col("_n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(0).alias("tp")), F.struct(F.col("_p").alias("c"), F.lit(0).cast("long").alias("t"), F.col("_n").alias("p"), F.lit(0).cast("long").alias("tp"))))
    per = cells.select(*keys, side.alias("s")).filter("s.c IS NOT NULL").groupBy(*keys, F.col("s.c").alias("label")).agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum("s.tp").alias("tp"))
    if labels is None:
        per = per.filter("t > 0")
    else:
        name = labels.columns[0]
        base = labels.select(F.col(name).alias("label")).distinct()
        grid = base if not keys else df.select(*keys).distinct().crossJoin(F.broadcast(base))
        per = grid.join(per, [*keys, "label"], "left")
    f1 = safe_divide(2 * F.col("tp"), F.col("t") + F.col("p"))
    return per.groupBy(*keys).agg(F.avg(f1).alias("macro_f1"), F.count("*").alias("labels"))


def presence_metrics(df: DataFrame, truth: Column, predicted: Column, *keys: str) -> DataFrame:
    """Per key: tp, fn, fp, tn, precision, recall, f1, balanced accuracy; a null prediction of a positive is a miss, of a negative an alarm."""
    said = F.coalesce(predicted, ~truth)
    tp, fn, fp, tn = (F.count_if(c) for c in (truth & said, truth & ~said, ~truth & said, ~truth & ~said))
    agg = df.groupBy(*keys).agg(tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"))
    p, r, s = safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("tp") + F.col("fn")), safe_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    return agg.select("*", p.alias("precision"), r.alias("recall"), safe_divide(2 * p * r, p + r).alias("f1"), ((r + s) / 2).alias("balanced_accuracy"))


def seed_summary(df: DataFrame, value: str, *keys: str, lower_is_worse: bool = True) -> DataFrame:
    """Mean, sample and population deviation (0.0 of one), and the worst value over seeds."""
    worst = F.min(value) if lower_is_worse else F.max(value)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("pop_std"), worst.alias("worst"), F.count(value).alias("n"))


def concentration(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Per key: distinct values, normalized entropy, share of the most frequent and of the five most frequent."""
    counts = df.filter(f"{value} IS NOT NULL").groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("p", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), value)))
    k = F.count("*")
    entropy = F.when(k > 1, F.sum(-F.col("p") * F.log("p")) / F.log(k)).otherwise(0.0)
    return ranked.groupBy(*keys).agg(k.alias("values"), entropy.alias("entropy"), F.sum(F.when(F.col("r") == 1, F.col("p"))).alias("top1_share"), F.sum(F.when(F.col("r") <= 5, F.col("p"))).alias("top5_share"))


def modal_share(df: DataFrame, name: str, ident: str) -> DataFrame:
    """Share of named rows whose id is the name's most frequent one."""
    counts = df.filter(f"{name} IS NOT NULL AND {ident} IS NOT NULL").groupBy(name, ident).agg(F.count("*").alias("n"))
    per = counts.groupBy(name).agg(F.max("n").alias("best"), F.sum("n").alias("all"))
    return per.agg(safe_divide(F.sum("best"), F.sum("all")).alias("modal_share"), F.coalesce(F.sum("all"), F.lit(0)).alias("pairs"))


def dependency_breaks(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of one column that go with several of the other, both ways: side, value, partners."""
    one = lambda x, y: df.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL").groupBy(F.col(x).cast("string").alias("value")).agg(F.count_distinct(y).alias("partners")).filter("partners > 1").select(F.lit(f"{x} -> {y}").alias("side"), "value", "partners")
    return one(a, b).unionByName(one(b, a))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def complementarity(df: DataFrame, left: Column, right: Column, *keys: str) -> DataFrame:
    """Per key the four cells of two arms being right."""
    return df.groupBy(*keys).agg(F.count_if(left & right).alias("both"), F.count_if(left & ~right).alias("only_left"), F.count_if(~left & right).alias("only_right"), F.count_if(~left & ~right).alias("neither"))


def quantiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Exact minimum, median, 95th percentile and maximum."""
    return df.groupBy(*keys).agg(F.min(value).alias("least"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("most"))


def grouping_report(df: DataFrame, sets: list[list[str]], columns: list[str], *aggregates: Column) -> DataFrame:
    """The same aggregates over several groupings in one pass; columns outside a grouping are null."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("level"), *aggregates)


def mass_shares(df: DataFrame, role: str, tokens: str) -> DataFrame:
    """Per role: samples, least, greatest, mean and sum of tokens, and the shares of samples and tokens."""
    per = df.groupBy(role).agg(F.count("*").alias("samples"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"), F.avg(tokens).alias("mean_tokens"), F.sum(tokens).alias("sum_tokens"))
    all_ = Window.partitionBy()
    return per.select("*", (F.col("samples") / F.sum("samples").over(all_)).alias("sample_share"), (F.col("sum_tokens") / F.sum("sum_tokens").over(all_)).alias("token_share"))


def null_rates(df: DataFrame, *keys: str) -> DataFrame:
    """The readings of a false alarm on rows without evidence, side by side.

    Wants parsed, evidence_present, pest_id, semantic. ``said_present``: anything but a
    clear no, malformed answers included; ``named_parsed``: a class is named in a
    parsed answer; ``named_semantic``: in a semantically sound one.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("n"), share(~F.coalesce(~F.col("evidence_present"), F.lit(False))).alias("said_present"), share(F.coalesce(F.col("parsed") & F.col("pest_id").isNotNull(), F.lit(False))).alias("named_parsed"), share(F.coalesce(F.col("semantic") & F.col("pest_id").isNotNull(), F.lit(False))).alias("named_semantic"))


def hierarchical_delta(df: DataFrame, step: str, low: int, high: int, *values: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Differences of metrics between two steps, per key, and how many rose."""
    at = lambda v, s: F.max(F.when(F.col(step) == s, F.col(v)))
    wide = df.groupBy(*keys).agg(*[(at(v, high) - at(v, low)).alias(f"{v}_delta") for v in values])
    return wide.withColumn("rising", sum((F.coalesce((F.col(f"{v}_delta") > 0).cast("int"), F.lit(0)) for v in values), F.lit(0)))
