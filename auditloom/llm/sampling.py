"""Problems 6 and 7: a sample by category targets, and a sample that stays as data grow."""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from ..session import checkpoint
from .ids import plain_id, plain_image

#: The sample is this part of the ids with known class and split.
SAMPLE_PART = 10
#: Ids of a category that one task ranks, about; the number of hash buckets follows from it.
RANKED_IDS = 20_000
#: Fine buckets of the growing sample, as a power of two.
BUCKET_BITS = 16
# Odd factor and offset of the permutation of the fine buckets.
PERMUTE_FACTOR, PERMUTE_OFFSET = 40_503, 12_289


def labelled_ids(feature_rows: DataFrame) -> DataFrame:
    """(id, class_id, probe_split) of each id with both known, in plain spelling.

    Of repeated ids the earliest delivery that knows a value counts.
    """
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct(F.col("batch_no").alias("b"), c.alias("v"))))["v"]
    split = plain_id(F.col("probe_split"))
    return feature_rows.select(plain_id(F.col("id")).alias("id"), "class_id", split.alias("split"), "batch_no").filter("id IS NOT NULL").groupBy("id").agg(first(F.col("class_id")).alias("class_id"), first(F.col("split")).alias("probe_split")).filter("class_id IS NOT NULL AND probe_split IS NOT NULL")


def _share_out(amount: int, weight: dict, room: dict) -> dict:
    """Shares of ``amount`` by weight, whole numbers up to each one's room; what one cannot take goes to the others."""
    given = dict.fromkeys(weight, 0)
    amount = min(amount, sum(room.values()))
    open_ = {k for k in weight if room[k] > 0}
    while amount > 0 and open_:
        total = sum(weight[k] for k in open_)
        exact = {k: amount * weight[k] / total if total > 0 else amount / len(open_) for k in open_}
        grant = {k: min(room[k] - given[k], int(exact[k])) for k in open_}
        left = amount - sum(grant.values())
        for k in sorted(open_, key=lambda k: (int(exact[k]) - exact[k], str(k))):  # largest remainders first
            if left and given[k] + grant[k] < room[k] and exact[k] < room[k] - given[k]:
                grant[k] += 1
                left -= 1
        if not any(grant.values()):
            grant[min(open_, key=lambda k: (-exact[k], str(k)))] = 1
        for k, n in grant.items():
            given[k] += n
            amount -= n
        open_ = {k for k in open_ if given[k] < room[k]}
    return given


class Allocation(NamedTuple):
    """What the allocation gives one leaf: rows to draw, and the part of its own quota that it had to pass on."""

    drawn: int
    unmet: float


def allocate(quota: dict[tuple, float], least: dict[tuple, int], room: dict[tuple, int], size: int) -> dict[tuple, Allocation]:
    """Rows to draw per leaf of a category tree, top down, and each leaf's unmet quota.

    A leaf is a path such as (band, class, split); its quota is the larger of its
    minimum and its target. A leaf takes of its quota what it holds and passes on the
    rest, its unmet quota: each node shares its amount among its children by their
    quotas, up to what they hold, so unmet quota goes to the siblings first, and only
    what a whole branch cannot take goes to the cousins. Minimums are kept before
    anything is shared.
    """
    kept = {k: min(least.get(k, 0), room[k]) for k in quota}
    unmet = {k: max(0.0, max(float(least.get(k, 0)), quota[k]) - room[k]) for k in quota}

    def down(leaves: list[tuple], depth: int, amount: int) -> dict[tuple, int]:
        if len(leaves) == 1 or depth == len(leaves[0]):
            return {leaves[0]: min(amount, room[leaves[0]] - kept[leaves[0]])}
        child = defaultdict(list)
        for k in leaves:
            child[k[depth]].append(k)
        part = _share_out(amount, {c: sum(max(0.0, quota[k] - kept[k]) for k in ks) for c, ks in child.items()}, {c: sum(room[k] - kept[k] for k in ks) for c, ks in child.items()})
        out = {}
        for c, ks in child.items():
            out |= down(ks, depth + 1, part[c])
        return out

    extra = down(list(quota), 0, max(0, size - sum(kept.values()))) if quota else {}
    return {k: Allocation(kept[k] + extra[k], unmet[k]) for k in quota}


def _targets(sample_targets: DataFrame, class_catalog: DataFrame | None) -> DataFrame:
    """One row per category; the class catalog's band holds where it knows the class."""
    t = sample_targets.select("class_id", plain_id(F.col("probe_split")).alias("probe_split"), plain_id(F.col("class_band")).alias("class_band"), "target_share", "min_rows").filter("class_id IS NOT NULL AND probe_split IS NOT NULL")
    t = t.groupBy("class_id", "probe_split").agg(F.min("class_band").alias("class_band"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("min_rows", F.lit(0))).alias("min_rows"))
    if class_catalog is not None:
        band = F.broadcast(class_catalog.groupBy("class_id").agg(F.min(plain_id(F.col("band"))).alias("band")).join(t.select("class_id").distinct(), "class_id", "left_semi"))
        t = t.join(band, "class_id", "left").withColumn("class_band", F.coalesce("band", "class_band")).drop("band")
    return t


def category_plan(feature_rows: DataFrame, sample_targets: DataFrame, class_catalog: DataFrame | None = None, part: int = SAMPLE_PART) -> DataFrame:
    """One row per category: class_band, class_id, probe_split, available, wanted, drawn, short_by.

    ``wanted`` is the larger of min_rows and target_share times a ``part``-th of the
    distinct ids with known class and split; ``drawn`` and ``short_by`` come from the
    allocation over the tree band, class, split: the rows it draws, and the part of
    ``wanted`` that the category had to pass on to others because it holds fewer ids.
    The driver holds the categories only (their number is that of the targets).
    """
    counts = labelled_ids(feature_rows).groupBy("class_id", "probe_split").agg(F.count("*").alias("available"))
    return _plan(counts, _targets(sample_targets, class_catalog), part)


def _plan(counts: DataFrame, targets: DataFrame, part: int) -> DataFrame:
    total = counts.agg(F.sum("available")).first()[0] or 0
    rows = targets.join(counts, ["class_id", "probe_split"], "left").collect()
    path = lambda r: (r["class_band"] or "", r["class_id"], r["probe_split"])
    room = {path(r): r["available"] or 0 for r in rows}
    wanted = {path(r): max(float(r["min_rows"]), r["target_share"] * total / part) for r in rows}
    given = allocate(wanted, {path(r): r["min_rows"] for r in rows}, room, total // part)
    out = [(r["class_band"], r["class_id"], r["probe_split"], room[k], wanted[k], *given[k]) for r in rows for k in (path(r),)]
    return counts.sparkSession.createDataFrame(out, "class_band string, class_id int, probe_split string, available long, wanted double, drawn long, short_by double")


def category_report(feature_rows: DataFrame, sample_targets: DataFrame, class_catalog: DataFrame | None = None, part: int = SAMPLE_PART) -> DataFrame:
    """The plan with ``undrawn``, the part of ``wanted`` that is not drawn, and a row of totals per class band.

    A band's row has null class_id and probe_split; its short_by and undrawn hold its
    totals against each other, so what a sibling category makes up for is not short.
    """
    plan = category_plan(feature_rows, sample_targets, class_catalog, part)
    bands = plan.groupBy("class_band").agg(*[F.sum(c).alias(c) for c in ("available", "wanted", "drawn")]).withColumn("short_by", F.greatest(F.lit(0.0), F.col("wanted") - F.col("available")))
    both = plan.unionByName(bands, allowMissingColumns=True)
    return both.withColumn("undrawn", F.greatest(F.lit(0.0), F.col("wanted") - F.col("drawn")))


def draw_sample(feature_rows: DataFrame, sample_targets: DataFrame, class_catalog: DataFrame | None = None, part: int = SAMPLE_PART, seed: int = 0) -> DataFrame:
    """(id, class_id, probe_split, class_band, draw_rank): in each category the ``drawn`` ids of least permuted rank.

    The rank is dense over the ids' hashes with ``seed``, ties by id, so the same ids
    are drawn in every run and layout. It is found from the counts of hash buckets of
    about RANKED_IDS ids: no task sorts more of a category, however large that is.
    """
    ids = checkpoint(labelled_ids(feature_rows))
    counts = ids.groupBy("class_id", "probe_split").agg(F.count("*").alias("available"))
    most = counts.agg(F.max("available")).first()[0] or 0
    bits = max(1, (most // RANKED_IDS).bit_length())
    plan = F.broadcast(_plan(counts, _targets(sample_targets, class_catalog), part).select("class_id", "probe_split", "class_band", "drawn"))
    hashed = ids.join(plan, ["class_id", "probe_split"]).withColumn("h", F.xxhash64("id", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits).bitwiseXOR(F.lit(1 << bits - 1)))
    leaf = ["class_id", "probe_split"]
    sizes = hashed.groupBy(*leaf, "bucket").agg(F.count("*").alias("n"))
    over = F.expr("sum(n) over (partition by class_id, probe_split order by bucket rows between unbounded preceding and 1 preceding)")
    before = sizes.withColumn("before", F.coalesce(over, F.lit(0))).drop("n")
    ranked = hashed.join(before, [*leaf, "bucket"]).filter("before < drawn").withColumn("draw_rank", F.col("before") + F.expr("row_number() over (partition by class_id, probe_split, bucket order by h, id)"))
    return ranked.filter("draw_rank <= drawn").select("id", "class_id", "probe_split", "class_band", "draw_rank")


def short_categories(feature_rows: DataFrame, sample_targets: DataFrame, part: int = SAMPLE_PART) -> DataFrame:
    """(class_id, probe_split) of the categories whose quota the allocation could not meet from their own ids."""
    return category_plan(feature_rows, sample_targets, None, part).filter("short_by > 0").select("class_id", "probe_split")


def bucket_position(key: Column, bits: int = BUCKET_BITS) -> Column:
    """Place of the key's fine bucket in the fixed permutation, from 0 to 2**bits - 1.

    The permutation is a chain of bijections of the bucket number: an odd factor with
    an offset, an exclusive or with its own upper half, and the factor again.
    """
    size = 2**bits
    b = F.pmod(F.xxhash64(key), F.lit(size))
    b = F.pmod(b * PERMUTE_FACTOR + PERMUTE_OFFSET, F.lit(size))
    b = b.bitwiseXOR(F.shiftright(b, bits // 2))
    return F.pmod(b * PERMUTE_FACTOR + PERMUTE_OFFSET, F.lit(size)).cast("int")


def _dated(df: DataFrame, column: str) -> Column:
    """When a row came: its time, the end of time where it has none, the beginning where the table has no such column."""
    return F.coalesce(F.col(column).cast("timestamp"), F.lit("9999-12-31").cast("timestamp")) if column in df.columns else F.lit("0001-01-01").cast("timestamp")


def first_sights(feature_rows: DataFrame, provenance: DataFrame) -> DataFrame:
    """(id, family, image, first_batch) per distinct id: what was known of it when it came first.

    An id is first seen in its least ``batch_no`` (null counts as the last), at the
    least ``extracted_at`` of its rows there. Provenance rows count if they had come by
    then (``ingested_at``), the earliest that tell something first: the id's own
    family, else the family of its image. Where neither is known the family is that
    of the id's rows in its first batch. Rows of later deliveries, whatever they tell,
    change nothing. Undated provenance rows count for nothing, and nothing of
    provenance for ids without ``extracted_at``; a table without these columns is
    taken as known from the start. Null ids are left out.
    """
    batch, seen = F.coalesce("batch_no", F.lit(2**31 - 1)), F.coalesce(F.col("extracted_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")) if "extracted_at" in feature_rows.columns else F.lit("9999-12-31").cast("timestamp")
    first = lambda c: F.min(F.struct("b", F.isnull(c).alias("lacks"), F.col(c).alias("v")))["v"]
    own = feature_rows.select(plain_id(F.col("id")).alias("id"), plain_id(F.col("family_id")).alias("own_family"), plain_image(F.col("source_image_id")).alias("own_image"), batch.alias("b"), seen.alias("t"), "batch_no").filter("id IS NOT NULL").groupBy("id").agg(first("own_family").alias("own_family"), first("own_image").alias("own_image"), F.min("batch_no").alias("first_batch"), F.min(F.struct("b", "t"))["t"].alias("t"))
    rows = provenance.select(plain_id(F.col("id")).alias("id"), plain_id(F.col("family_id")).alias("family"), plain_image(F.col("source_image_id")).alias("image"), _dated(provenance, "ingested_at").alias("g"))
    told = lambda c, name: F.min(F.when(F.col(c).isNotNull(), F.struct("g", F.col(c).alias("v")))).alias(name)
    by_id = rows.filter("id IS NOT NULL").groupBy("id").agg(told("family", "f"), told("image", "i"))
    by_image = checkpoint(rows.filter("image IS NOT NULL").groupBy("image").agg(told("family", "m"), F.count("*").alias("n")).filter("m IS NOT NULL"))
    known = lambda c: F.when(F.col(f"{c}.g") <= F.col("t"), F.col(f"{c}.v"))
    with_id = own.join(by_id, "id", "left").select("id", "t", "first_batch", "own_family", known("f").alias("family"), F.coalesce("own_image", known("i")).alias("image"))
    found = salted_join(with_id, by_image.select("image", "m"), "image", hot_keys(by_image, "image", "n", provenance.count()), F.col("id"), "left")
    return found.select("id", F.coalesce("family", known("m"), "own_family").alias("family"), "image", "first_batch")


def family_keys(feature_rows: DataFrame, provenance: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(id, family, image, family_key, first_batch) per distinct id: the ledger of keys, which is only appended to.

    An id's key is that of its family, else its image, else the id, as known at its
    first sight (``first_sights``). A family's key is its name and an image's its id,
    but the one seen later takes on the key of the one seen before, so that both stay
    together. Nothing that arrives later changes a key that was given. ``ledger`` is the result of an earlier call, written by the caller: its
    rows come out unchanged, whatever the tables say now, and new ids take on the
    keys it holds for their family or image. Without it the keys of all deliveries are
    found anew, and are the same as long as the arrival times are true.
    """
    new, last = first_sights(feature_rows, provenance), 2**31 - 1
    earliest = lambda c: ledger.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(F.struct(F.coalesce("first_batch", F.lit(last)), "family_key"))["family_key"].alias(f"{c}_given"))
    if ledger is not None:
        new = new.join(ledger.select("id"), "id", "left_anti")
    new = checkpoint(new.withColumn("b", F.coalesce("first_batch", F.lit(last))))
    ids = new.count()
    alone = new.filter("family IS NULL AND image IS NOT NULL").groupBy("image").agg(F.min("b").alias("used"), F.count("*").alias("n"))
    families = new.filter("family IS NOT NULL").groupBy("family").agg(F.min(F.struct("b", F.isnull("image"), "image")).alias("first"), F.count("*").alias("n")).select("family", "n", F.col("first.b").alias("b"), F.col("first.image").alias("image"))
    families, images = families.join(alone.select("image", "used"), "image", "left"), alone
    if ledger is not None:
        given = earliest("image")
        families, images = families.join(earliest("family"), "family", "left").join(given, "image", "left"), images.join(given, "image", "left")
    else:
        nothing = F.lit(None).cast("string")
        families, images = families.withColumns({"family_given": nothing, "image_given": nothing}), images.withColumn("image_given", nothing)
    # an image that was a key before a family of it was seen hands its key on, and the other way round
    families = checkpoint(families.withColumn("family_key", F.coalesce("family_given", "image_given", F.when(F.col("used") < F.col("b"), F.col("image")), "family")))
    of_image = families.filter("image IS NOT NULL").groupBy("image").agg(F.min(F.struct("b", "family", "family_key")).alias("f"))
    images = checkpoint(images.join(of_image, "image", "left").select(F.col("image").alias("alone"), "n", F.coalesce("image_given", F.when(F.col("f.b") <= F.col("used"), F.col("f.family_key")), "image").alias("image_key")))
    keyed = salted_join(new, families.select("family", "family_key"), "family", hot_keys(families, "family", "n", ids), F.col("id"), "left").withColumn("alone", F.when(F.col("family").isNull(), F.col("image")))
    keyed = salted_join(keyed, images.select("alone", "image_key"), "alone", hot_keys(images, "alone", "n", ids), F.col("id"), "left")
    out = keyed.select("id", "family", "image", F.coalesce("family_key", "image_key", "id").alias("family_key"), "first_batch")
    return out if ledger is None else ledger.select(*out.columns).unionByName(out)


def stable_sample(feature_rows: DataFrame, provenance: DataFrame, rate: float = 0.1, bits: int = BUCKET_BITS, ledger: DataFrame | None = None) -> DataFrame:
    """(id, family_key, position, first_batch) of the ids whose fine bucket is in the list of the first ``rate`` of the permutation.

    A key is given once (see ``family_keys``; pass the written ``ledger`` of the last
    run to hold to it even where arrival times are missing or wrong), stays in its
    bucket for ever, and the list of buckets only grows with ``rate``. So the sample is
    the same in every run and layout and keeps its members when rows arrive, and a
    smaller rate gives a part of a larger one. Ids whose family was known at first
    sight come with the whole family. An empty table gives no rows.
    """
    keyed = family_keys(feature_rows, provenance, ledger).withColumn("position", bucket_position(F.col("family_key"), bits))
    return keyed.filter(F.col("position") < int(round(rate * 2**bits))).select("id", "family_key", "position", "first_batch")


def growth_report(feature_rows: DataFrame, provenance: DataFrame, rate: float = 0.1) -> DataFrame:
    """Per batch: ids that came first in it, and those of them in the sample."""
    keyed = family_keys(feature_rows, provenance).withColumn("position", bucket_position(F.col("family_key")))
    return keyed.groupBy("first_batch").agg(F.count("*").alias("ids"), F.count_if(F.col("position") < int(round(rate * 2**BUCKET_BITS))).alias("sampled"))
