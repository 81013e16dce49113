"""Learned and calibrated operators: text probes, linear probe, calibration, thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import safe_divide, word_set


def naive_bayes(train: DataFrame, test: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, log_odds, predicted): Bernoulli naive Bayes over word sets with Laplace smoothing.

    Each class starts from the log odds of all words absent; a word that occurs adds
    its difference. Words unseen in training do not count. Counts are joined, never
    gathered; the vocabulary is a table.
    """
    words = lambda df, *c: df.filter(f"{text} IS NOT NULL").select(key, *c, F.explode(word_set(F.col(text))).alias("word"))
    n = train.filter(f"{text} IS NOT NULL AND {label} IS NOT NULL").agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    counts = words(train.filter(f"{label} IS NOT NULL"), label).groupBy("word").agg(F.count_if(F.col(label) == 1).alias("c1"), F.count_if(F.col(label) == 0).alias("c0"))
    p1, p0 = (F.col("c1") + 1) / (F.col("n1") + 2), (F.col("c0") + 1) / (F.col("n0") + 2)
    weights = counts.crossJoin(F.broadcast(n)).select("word", (F.log(p1) - F.log(p0) - F.log(1 - p1) + F.log(1 - p0)).alias("delta"), (F.log(1 - p1) - F.log(1 - p0)).alias("absent"))
    base = weights.agg(F.coalesce(F.sum("absent"), F.lit(0.0)).alias("a")).crossJoin(n).select((F.col("a") + F.log((F.col("n1") + 1) / (F.col("n0") + 1))).alias("base"))
    scores = words(test).join(weights.select("word", "delta"), "word").groupBy(key).agg(F.sum("delta").alias("s"))
    out = test.select(key).distinct().join(scores, key, "left").crossJoin(F.broadcast(base))
    odds = F.coalesce("s", F.lit(0.0)) + F.col("base")
    return out.select(key, odds.alias("log_odds"), (odds >= 0).cast("int").alias("predicted"))


def tfidf_logistic(train: DataFrame, test: DataFrame, key: str, text: str, label: str, features: int = 1 << 14, reg: float = 1e-3) -> DataFrame:
    """(key, score): a balanced logistic model over hashed words, word pairs and character n-grams with smoothed IDF.

    Built from Spark ML; characters stay within words. Both labels must occur.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    def terms(df: DataFrame) -> DataFrame:
        w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(\w+)"), F.lit(1))
        chars = lambda n: F.flatten(F.transform(w, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) + 3 - n, F.lit(1))), lambda i: F.concat(F.lit("c:"), F.substring(F.concat(F.lit(" "), t, F.lit(" ")), i, F.lit(n))))))
        pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
        return df.withColumn("_terms", F.concat(w, pairs, chars(3), chars(4), chars(5)))

    ready = terms(train.filter(f"{label} IS NOT NULL"))
    count = {r[label]: r["count"] for r in ready.groupBy(label).count().collect()}
    total = sum(count.values())
    weight = F.lit(0.0)
    for value, n in count.items():
        weight = F.when(F.col(label) == value, total / (len(count) * n)).otherwise(weight)
    model = Pipeline(stages=[HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x", minDocFreq=2), LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=reg, maxIter=50)]).fit(ready.withColumn("_w", weight))
    return model.transform(terms(test).drop(label)).select(key, vector_to_array("probability")[1].alias("score"))


def linear_probe(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, c: float = 1.0) -> DataFrame:
    """(key, predicted, probabilities, confidence) of a balanced multinomial logistic model on frozen vectors.

    regParam is 1 / (C times the sum of weights), which is the penalty of the usual
    objective; labels are ordered numbers.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = train.filter(f"{label} IS NOT NULL AND {vector} IS NOT NULL")
    counts = {int(r[label]): r["count"] for r in known.groupBy(label).count().orderBy(label).collect()}
    total, place = sum(counts.values()), {v: i for i, v in enumerate(sorted(counts))}
    to_index = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    weights = F.create_map(*[F.lit(x) for v, n in counts.items() for x in (v, total / (len(counts) * n))])
    ready = known.select(to_index[F.col(label).cast("int")].cast("double").alias("_y"), weights[F.col(label).cast("int")].alias("_w"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_x"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", standardization=False, regParam=1.0 / (c * total), maxIter=2000).fit(ready)
    back = F.create_map(*[F.lit(x) for v, i in place.items() for x in (i, v)])
    scored = model.transform(test.filter(f"{vector} IS NOT NULL").withColumn("_x", array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
    p = vector_to_array("probability")
    return scored.select(key, back[F.col("prediction").cast("int")].alias("predicted"), p.alias("probabilities"), F.array_max(p).alias("confidence"))


def probe_controls(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, seeds: tuple[int, ...]) -> DataFrame:
    """(seed, control, accuracy, n): what ``linear_probe`` reaches on permuted training labels, and guesses drawn in the training shares.

    The labels are dealt anew in the order of a hash of key and seed; the guess of a
    test row is the label of the training row that its own hash selects.
    """
    place = lambda df, by: df.withColumn("_i", F.row_number().over(Window.orderBy(by, key)) - 1)
    known = train.filter(f"{label} IS NOT NULL AND {vector} IS NOT NULL").select(key, vector, label)
    asked = test.filter(f"{label} IS NOT NULL AND {vector} IS NOT NULL").select(key, vector, label)
    n, out = known.count(), None
    ordered = place(known, F.col(key))
    for seed in seeds:
        dealt = place(known, F.xxhash64(key, F.lit(seed))).select("_i", F.col(label).alias("_dealt"))
        shuffled = ordered.join(dealt, "_i").select(key, vector, F.col("_dealt").alias(label))
        permuted = linear_probe(shuffled, asked, key, vector, label).select(key, "predicted")
        guessed = asked.withColumn("_i", F.pmod(F.xxhash64(key, F.lit(seed), F.lit("guess")), F.lit(n)).cast("int")).join(ordered.select("_i", F.col(label).alias("predicted")), "_i").select(key, "predicted")
        for name, guess in (("permuted_labels", permuted), ("stratified_guess", guessed)):
            one = guess.join(asked.select(key, label), key).agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n")).select(F.lit(seed).alias("seed"), F.lit(name).alias("control"), "accuracy", "n")
            out = one if out is None else out.unionByName(one)
    return out


def scaled_probabilities(p: Column, temperature: Column | float) -> Column:
    """Probabilities after dividing their logs by a temperature, cut at 1e-12 and normalized."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    e = F.transform(p, lambda v: F.exp(F.log(F.greatest(v.cast("double"), F.lit(1e-12))) / t))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def fit_temperature(df: DataFrame, probabilities: str, truth_place: str, points: int = 81) -> DataFrame:
    """(temperature, nll) of the least mean negative log likelihood over a grid of log temperatures from -4 to 4, in one job."""
    grid = F.array(*[F.lit(float(np.exp(-4 + 8 * i / (points - 1)))) for i in range(points)])
    rows = df.filter(f"{truth_place} IS NOT NULL").select(probabilities, truth_place, F.explode(grid).alias("temperature"))
    loss = -F.log(F.greatest(F.get(scaled_probabilities(F.col(probabilities), F.col("temperature")), F.col(truth_place)), F.lit(1e-12)))
    return rows.groupBy("temperature").agg(F.avg(loss).alias("nll")).orderBy("nll", "temperature").limit(1)


def best_threshold(df: DataFrame, score: str, label: Column, steps: int = 101) -> DataFrame:
    """(threshold, balanced_accuracy) of the best of ``steps`` thresholds from 0 to 1; ties go to the lower.

    Scores are counted per step first, so the sweep reads ``steps`` rows.
    """
    place = F.least(F.greatest(F.floor(F.round(F.col(score) * (steps - 1), 9)), F.lit(-1)), F.lit(steps - 1))
    counts = df.filter(F.col(score).isNotNull() & label.isNotNull()).groupBy(place.alias("i")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n"))
    grid = df.sparkSession.range(-1, steps).select(F.col("id").alias("i"))
    full = grid.join(counts, "i", "left").select("i", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    up = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    swept = full.select("i", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(all_).alias("ps"), F.sum("n").over(all_).alias("ns")).filter("i >= 0")
    ba = (safe_divide(F.col("tp"), F.col("ps")) + safe_divide(F.col("ns") - F.col("fp"), F.col("ns"))) / 2
    return swept.select((F.col("i") / (steps - 1)).alias("threshold"), ba.alias("balanced_accuracy")).orderBy(F.desc("balanced_accuracy"), "threshold").limit(1)


def recall_threshold(df: DataFrame, score: str, label: Column, recall: float, *keys: str) -> DataFrame:
    """Per key the score at ascending rank n - ceil(recall * n) of the positives (counted from 1, at least 1)."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = df.filter(label & F.col(score).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(score))).withColumn("_n", F.count("*").over(w))
    return ranked.filter(F.col("_r") == F.greatest(F.col("_n") - F.ceil(F.col("_n") * recall) + 1, F.lit(1))).select(*keys, F.col(score).alias("threshold"), F.col("_n").alias("positives"))


def mean_pooled(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): mean of a key's vectors, scaled to unit length; null vectors do not count, zero means give null."""
    parts = df.filter(f"{vector} IS NOT NULL").select(key, F.posexplode(vector).alias("i", "v")).groupBy(key, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["m"] * x["m"]))
    return whole.select(key, F.when(norm > 0, F.transform("s", lambda x: x["m"] / norm)).alias(vector))


def example_mean_loss(tokens: DataFrame, example: str, loss: str, keep: Column) -> DataFrame:
    """Mean over examples of the mean loss of their kept tokens (not the mean over tokens)."""
    per = tokens.filter(keep).groupBy(example).agg(F.avg(loss).alias("m"))
    return per.agg(F.avg("m").alias("batch_loss"), F.count("*").alias("examples"))


def token_groups(offsets: Column, spans: Column) -> Column:
    """For each token (start, end): the name of the first span (name, start, end) it overlaps, else other."""
    return F.transform(offsets, lambda t: F.coalesce(F.get(F.filter(spans, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])), F.lit(0))["name"], F.lit("other")))


def perturbed(images: DataFrame, key: str, kind: str, seed: int = 0, patch: int = 8) -> DataFrame:
    """``images`` (key, width, height, data: gray bytes) blanked, blurred, patch-shuffled or with noise, seeded by content."""

    def change(data: bytes, w: int, h: int) -> bytes:
        import zlib

        a = np.frombuffer(data, np.uint8).reshape(h, w).astype(np.int32)
        rng = np.random.default_rng((seed, zlib.crc32(data)))
        if kind == "blank":
            a = np.full_like(a, int(a.mean()) if a.size else 0)
        elif kind == "blur":
            p = np.pad(a, 1, mode="edge")
            a = sum(p[i : i + h, j : j + w] for i in range(3) for j in range(3)) // 9
        elif kind == "shuffle":
            hh, ww = h - h % patch, w - w % patch
            tiles = a[:hh, :ww].reshape(hh // patch, patch, ww // patch, patch).swapaxes(1, 2).reshape(-1, patch, patch)
            tiles = tiles[rng.permutation(len(tiles))]
            a = a.copy()
            a[:hh, :ww] = tiles.reshape(hh // patch, ww // patch, patch, patch).swapaxes(1, 2).reshape(hh, ww)
        elif kind == "noise":
            a = a + rng.integers(-16, 17, a.shape)
        else:
            raise ValueError(f"unknown kind {kind}")
        return np.clip(a, 0, 255).astype(np.uint8).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["data"] = [change(bytes(d), int(w), int(h)) if d is not None and len(d) == w * h else None for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"])]
            yield pdf

    k = images.schema[key].dataType.simpleString()
    return images.select(key, "width", "height", "data").mapInPandas(run, f"{key} {k}, width int, height int, data binary")


def perceptual_hashes(images: DataFrame, key: str) -> DataFrame:
    """(key, dhash, phash): 64-bit gradient and cosine-transform hashes of gray images (width, height, data).

    Images are reduced by area means; the hashes are not those of any imaging library,
    but small changes give small distances. Sizes that do not match give nulls.
    """

    def shrink(a: np.ndarray, h: int, w: int) -> np.ndarray:
        ys, xs = np.linspace(0, a.shape[0], h + 1).astype(int), np.linspace(0, a.shape[1], w + 1).astype(int)
        return np.array([[a[y0 : max(y1, y0 + 1), x0 : max(x1, x0 + 1)].mean() for x0, x1 in zip(xs, xs[1:])] for y0, y1 in zip(ys, ys[1:])])

    def pack(bits: np.ndarray) -> int:
        return int(np.packbits(bits.ravel()).view(">i8")[0])

    def both(data: bytes, w: int, h: int) -> tuple[int | None, int | None]:
        if data is None or len(data) != w * h or min(w, h) < 9:
            return None, None
        a = np.frombuffer(bytes(data), np.uint8).reshape(h, w).astype(float)
        small = shrink(a, 8, 9)
        square = shrink(a, 32, 32) if min(w, h) >= 32 else np.kron(shrink(a, 8, 8), np.ones((4, 4)))
        i = np.arange(32)
        basis = np.cos(np.pi * (2 * i[None, :] + 1) * i[:, None] / 64)
        low = np.round((basis @ square @ basis.T)[:8, :8], 6)
        middle = np.median(low.ravel()[1:])
        return pack(small[:, 1:] > small[:, :-1]), pack(low > middle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [both(d, int(w), int(h)) for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"])]
            yield pd.DataFrame({key: pdf[key], "dhash": pd.array([f[0] for f in found], "Int64"), "phash": pd.array([f[1] for f in found], "Int64")})

    k = images.schema[key].dataType.simpleString()
    return images.select(key, "width", "height", "data").mapInPandas(run, f"{key} {k}, dhash long, phash long")


def predicted_with(df: DataFrame, key: str, text: str, generate, output: str = "raw_text") -> DataFrame:
    """The seam to a model: ``generate`` maps a list of prompts to a list of answers, batch by batch."""
    k = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], output: generate(pdf[text].tolist())})

    return df.select(key, text).mapInPandas(run, f"{key} {k}, {output} string")
