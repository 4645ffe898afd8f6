"""Quality of labelled image sets: label lines, splits, names, duplicates, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.operators.graph import components
from vigil.operators.hamming import bit_distance, near_pairs
from vigil.operators.ordered import index_rows
from vigil.operators.skew import HOT_ROWS, hot_list, skew_join
from vigil.session import Scratch

CLASSES = ("helmet", "no_helmet", "no_vest", "vest")  # fixed values, in the order of their ids


def judged(rows: DataFrame, line: str = "line") -> DataFrame:
    """``rows`` with the fields of a line "class x_center y_center width height" (class_id, x, y, w, h; null where unreadable) and
    ``error``, the first rule that the line breaks, null if it breaks none.

    The line is split once and each field parsed once: the optimizer moves no condition below a generator, so that filters on
    ``error`` don't parse the line anew for each rule.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    tokens = rows.withColumn("_t", F.split(F.trim(line), r"\s+"))
    fields = [F.get("_t", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("xywh", 1)]
    struct = F.struct(F.size("_t").alias("_n"), F.get("_t", F.lit(0)).try_cast("int").alias("class_id"), *fields)
    parsed = tokens.select(*rows.columns, F.inline(F.array(struct)))
    error = (
        F.when(F.col("_n") != 5, "token_count")
        .when(F.col("class_id").isNull(), "class_not_a_number")
        .when((F.col("class_id") < 0) | (F.col("class_id") >= len(CLASSES)), "class_range")
        .when(~(finite("x") & finite("y") & finite("w") & finite("h")), "not_finite")
        .when((F.col("x") < 0) | (F.col("x") > 1) | (F.col("y") < 0) | (F.col("y") > 1), "centre_range")
        .when((F.col("w") <= 0) | (F.col("w") > 1) | (F.col("h") <= 0) | (F.col("h") > 1), "size_range")
    )
    return parsed.withColumn("error", error).drop("_n")


def original_name(exported: Column) -> Column:
    """The name before an export: what stands before ``.rf.``, its last ``_ext`` as ``.ext``."""
    return F.regexp_replace(F.substring_index(exported, ".rf.", 1), r"_([^_]*)$", r".$1")


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")


def name_seconds(name: Column) -> Column:
    """Seconds that a stem ends in as ``_t`` and milliseconds; null if it doesn't."""
    return F.regexp_extract(stem(name), r"_t(\d+)$", 1).try_cast("long") / 1000


def fingerprint(coefficients: Column) -> Column:
    """64 bits: bit i tells whether coefficient i exceeds the median of all but the first."""
    median = F.get(F.sort_array(F.slice(coefficients, 2, 63)), F.lit(31))
    bits = F.transform(F.arrays_zip(coefficients.alias("v"), F.sequence(F.lit(0), F.lit(63)).alias("i")), lambda z: F.when(z["v"] > median, F.call_function("shiftleft", F.lit(1).cast("long"), z["i"])).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def near_duplicates(images: DataFrame, image_id: str, hash_: str, radius: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of images that copies and near copies tie together, and the pairs that tie them.

    Gives (image_id, h, group_id) of images with a copy or near copy, the group being its smallest image; (h, n) of all different
    fingerprints; and the pairs (hl < hr) of different ones within ``radius``.  Different fingerprints are compared once and
    stand for their images.
    """
    rows = images.where(f"{image_id} is not null and {hash_} is not null").select(F.col(image_id).alias("image_id"), F.col(hash_).cast("long").alias("h")).distinct()
    sizes = scratch.save(rows.groupBy("h").agg(F.min("image_id").alias("first"), F.count(F.lit(1)).alias("n")), most=F.max("n"))
    near = scratch.save(near_pairs(sizes.select(F.col("h").alias("hl")), sizes.select(F.col("h").alias("hr")), radius, scratch).where("hl < hr"))
    tied = components(near, "hl", "hr", scratch).select(F.col("node").alias("h"), "component")
    members = sizes.join(tied, "h", "left").withColumn("component", F.coalesce("component", F.when(F.col("n") > 1, F.col("h")))).where("component is not null")
    groups = members.groupBy("component").agg(F.min("first").alias("group_id"))
    known = scratch.save(members.select("h", "component").join(groups, "component").select("h", "group_id"))
    # one fingerprint may be a third of all images
    hot = (scratch.watched(sizes, "most") or 0) >= HOT_ROWS
    placed = skew_join(rows, known, "h", "inner", hot_list(sizes, "h", "n")) if hot else rows.join(known, "h")
    return placed.select("image_id", "h", "group_id"), sizes.select("h", "n"), near


def near_duplicate_groups(images: DataFrame, image_id: str, hash_: str, radius: int, scratch: Scratch) -> DataFrame:
    """(image_id, group_id) of images with a copy or near copy; the group is its smallest image."""
    return near_duplicates(images, image_id, hash_, radius, scratch)[0].select("image_id", "group_id")


def group_matches(members: DataFrame, near: DataFrame, value: str, group: str = "group_id") -> DataFrame:
    """Groups in which some pair within the threshold has the same ``value``; members (h, group, value) chained together don't count.

    Members are counted by (fingerprint, value) first, so a pair is of the same fingerprint (two members of one class) or
    of two classes of a pair of fingerprints.
    """
    classes = members.where(F.col(value).isNotNull()).groupBy(group, "h", value).agg(F.count(F.lit(1)).alias("_n"))
    same = classes.where("_n > 1").select(group)
    left, right = classes.select(group, F.col("h").alias("hl"), value), classes.select(F.col("h").alias("hr"), value)
    return same.unionByName(near.join(left, "hl").join(right, ["hr", value]).select(group)).distinct()


def split_pairs(members: DataFrame, near: DataFrame, split: str) -> DataFrame:
    """(n_within, n_across): pairs of members (h, split) within the threshold whose splits are the same, and are not.

    Counted from the sizes of classes; no pair is listed.  A null split is a split of its own.
    """
    sized = members.groupBy("h", F.coalesce(split, F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    total = members.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    half = lambda n: n * (n - 1) / 2
    inside = total.agg(F.sum(half(F.col("n"))).alias("x"))
    inside_same = sized.agg(F.sum(half(F.col("n"))).alias("x"))
    a, b = total.select(F.col("h").alias("hl"), F.col("n").alias("na")), total.select(F.col("h").alias("hr"), F.col("n").alias("nb"))
    between = near.join(a, "hl").join(b, "hr").agg(F.sum(F.col("na") * F.col("nb")).alias("x"))
    c, d = sized.select(F.col("h").alias("hl"), "s", F.col("n").alias("na")), sized.select(F.col("h").alias("hr"), "s", F.col("n").alias("nb"))
    between_same = near.join(c, "hl").join(d, ["hr", "s"]).agg(F.sum(F.col("na") * F.col("nb")).alias("x"))
    parts = None
    for name, one in (("all", inside), ("same", inside_same), ("all", between), ("same", between_same)):
        one = one.select(F.lit(name).alias("k"), F.coalesce(F.col("x").cast("long"), F.lit(0)).alias("x"))
        parts = one if parts is None else parts.unionByName(one)
    by = lambda k: F.sum(F.when(F.col("k") == k, F.col("x")).otherwise(0))
    return parts.agg(by("same").alias("n_within"), (by("all") - by("same")).alias("n_across"))


def capped_top(rows: DataFrame, group: str, order: list[Column], cap: int, most: int) -> DataFrame:
    """At most ``cap`` rows a group in an order, and the first ``most`` of them all."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_n") <= cap)
    return ranked.orderBy(*order).limit(most).drop("_n")


def diverse(rows: DataFrame, group: str, row_id: str, hash_: str, order: list[Column], most: int, radius: int, scratch: Scratch) -> DataFrame:
    """(row_id, hash_, accepted): round-robin over groups, refusing a row within ``radius`` of an accepted one, until ``most`` are accepted.

    Whether a row is accepted depends on all accepted before it.  Ranked rows are written once; the driver takes them in
    windows of the global order, each with only as many rows as are still to be accepted, and the cluster drops from the rest
    what is near the rows accepted so far before the next window is taken.  A null hash is near nothing.
    """
    ranked = rows.withColumn("_turn", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    left = scratch.save(index_rows(ranked.select(row_id, hash_, "_turn", group), ["_turn", group, row_id], scratch, "_place"))
    taken: list[tuple] = []
    while len(taken) < most:
        window = left.orderBy("_place").limit(most - len(taken)).select(row_id, hash_, "_place").collect()  # at most ``most`` rows
        if not window:
            break
        fresh = []
        for r in window:
            if r[1] is None or all(((r[1] ^ h) & (1 << 64) - 1).bit_count() > radius for _, h, *_ in taken if h is not None):
                taken.append((r[0], r[1], r[2]))
                fresh.append(r[1])
        rest = left.where(F.col("_place") > window[-1][2])
        near = F.lit(False)
        for h in fresh:
            if h is not None:
                near = near | F.coalesce(bit_distance(F.col(hash_), F.lit(h)) <= radius, F.lit(False))
        left = scratch.save(rest.where(~near))
    out = [(i, h, n + 1) for n, (i, h, _) in enumerate(taken)]
    return rows.sparkSession.createDataFrame(out, f"{row_id} long, {hash_} long, accepted int")


def split_groups(rows: DataFrame, group: str, shares: tuple[float, float], scratch: Scratch) -> DataFrame:
    """(group, split): groups in the order of a digest; the last ones are test, those before val, the first train.

    ``shares``: of val and test; either gets at least one group.
    """
    names = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g")).distinct().withColumn("digest", F.md5("g"))
    placed = scratch.save(index_rows(names, ["digest", "g"], scratch, "at"))
    n = scratch.count(placed)
    val, test = (max(1, round(n * s)) for s in shares)
    train = max(1, n - val - test)
    return placed.select(F.col("g").alias(group), F.when(F.col("at") < train, "train").when(F.col("at") < train + val, "val").otherwise("test").alias("split"))


def gate(images: DataFrame, lines: DataFrame, dataset: str) -> DataFrame:
    """What keeps each dataset from training: counts and ``reason``, the first of the conditions that fails, or passed.

    ``images`` has dataset, image, split and source_group, ``lines`` dataset, image, line_no and error (null for a valid line).  Conditions in
    order: no fatal errors (the first three are told), some images, some in train and in val, some instances, no source group in two
    splits.  A null group leaks nothing.
    """
    counts = images.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_images"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    leaks = images.where("source_group is not null and split is not null").groupBy(dataset, "source_group").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").groupBy(dataset).agg(F.count(F.lit(1)).alias("n_leaks"))
    instances = lines.groupBy(dataset).agg(F.count_if(F.col("error").isNull()).alias("n_instances"))
    # ranks up to three are found per task before rows move
    first = lines.where("error is not null").withColumn("_n", F.row_number().over(W.partitionBy(dataset).orderBy("image", "line_no", "error"))).where("_n <= 3")
    told = F.concat(F.col("image").cast("string"), F.lit(":"), F.col("line_no").cast("string"), F.lit(" "), F.col("error"))
    errors = first.groupBy(dataset).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", told.alias("t")))), lambda x: x["t"]), "; ").alias("_errors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = counts.join(leaks, dataset, "left").join(instances, dataset, "left").join(errors, dataset, "left").select(dataset, "n_images", "n_train", "n_val", zero("n_instances"), zero("n_leaks"), "_errors")
    reason = (
        F.when(F.col("_errors").isNotNull(), F.concat(F.lit("fatal errors: "), "_errors")).when(F.col("n_images") == 0, "no images").when(F.col("n_train") == 0, "train split is empty")
        .when(F.col("n_val") == 0, "validation split is empty").when(F.col("n_instances") == 0, "no labelled instances").when(F.col("n_leaks") > 0, "source groups leak").otherwise("passed")
    )
    return rows.withColumn("reason", reason).drop("_errors")


def seen_before(rows: DataFrame, row_id: str, period: str, keys: dict[str, Column]) -> DataFrame:
    """(row_id, by) of rows one of whose ``keys`` a row of an earlier period has; a null key equals nothing.

    The earliest period of each key comes from one aggregate, which has one row a key and is joined back, hot keys apart.
    """
    long = rows.select(row_id, F.col(period).alias("_p"), F.explode(F.array(*[F.struct(F.lit(k).alias("by"), c.cast("string").alias("key")) for k, c in keys.items()])).alias("k")).where("k.key is not null")
    long = long.select(row_id, "_p", "k")
    least = long.groupBy("k").agg(F.min("_p").alias("_first"))
    return skew_join(long, least, "k").where("_first < _p").select(row_id, F.col("k.by").alias("by")).distinct()


def referred(rows: DataFrame, present: Column, what: str) -> DataFrame:
    """``rows`` if all meet ``present``; otherwise an error that names the first few records without ``what``."""
    bad = rows.where(~F.coalesce(present, F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"no {what}: {'; '.join(', '.join(map(str, r)) for r in bad)}")
    return rows


def integrity(frames: DataFrame, video: str, declared: str, fps: float) -> DataFrame:
    """(video, declared, decoded, entire, duration_seconds): whether as many frames were decoded as are declared, which must be some."""
    return frames.groupBy(video).agg(F.max(declared).cast("long").alias("declared"), F.count(F.lit(1)).alias("decoded")).select(
        video, "declared", "decoded", (F.coalesce(F.col("declared") > 0, F.lit(False)) & (F.col("decoded") == F.col("declared"))).alias("entire"), (F.col("decoded") / fps).alias("duration_seconds")
    )
