"""Equi-joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the weighed rows on, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.005


def hot_keys(weights: DataFrame, key: str, weight: str, total: int | None = None) -> DataFrame:
    """Keys that bear at least HOT_SHARE of all rows: at most 200, whatever the data.

    ``weights`` has one row per key; ``weight`` is its number of rows. Without
    ``total`` the weights are summed first, so give a table that is written already.
    Null keys are never hot, as they join nothing. An empty table gives no keys.
    """
    if total is None:
        total = weights.agg(F.sum(weight)).first()[0] or 0
    return weights.filter((F.col(weight) >= F.lit(total * HOT_SHARE)) & F.col(key).isNotNull()).select(key)


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner", salts: int = 32) -> DataFrame:
    """``big`` join ``small`` on ``key``, with each hot key spread over ``salts`` tasks.

    ``hot`` holds the hot keys (see ``hot_keys``; its size is bounded, so it is
    broadcast). Rows of ``big`` with a hot key get a salt from the hash of
    ``spread``; the rows of ``small`` for that key are repeated once per salt.
    Rows of ``big`` without a key match nothing and are spread likewise. All rows
    are kept; ``how`` may be inner, left, left_semi or left_anti.
    """
    mark = F.broadcast(hot.select(F.col(key).alias("_hot_key")).distinct())
    left = big.join(mark, F.col(key) == F.col("_hot_key"), "left").withColumn("_salt", F.when(F.col("_hot_key").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot_key")
    right = small.join(mark, F.col(key) == F.col("_hot_key"), "left").withColumn("_salt", F.explode(F.when(F.col("_hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot_key")
    return left.join(right, [key, "_salt"], how).drop("_salt")
