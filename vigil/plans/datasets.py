"""Queries over labelled image sets, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.text import split_name, strip
from vigil.operators import datasets as D
from vigil.operators.hamming import bit_distance, near_pairs
from vigil.operators.ordered import index_rows
from vigil.session import Scratch, table

RADIUS = 3


def _digits(x: Column) -> Column:
    """A number cut to four digits, without any engine's rounding of decimals."""
    units = F.floor(x * 10_000)
    return F.concat(F.floor(units / 10_000).cast("string"), F.lit("."), F.lpad((units % 10_000).cast("string"), 4, "0"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Label lines made of line items: image (order), line number, split, text; some are broken on purpose."""
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    numbers = [(F.col("l_discount") * 10 + 0.0), (F.col("l_tax") * 10 + 0.0), F.col("l_quantity") / 50, F.col("l_extendedprice") / 105000]
    text = F.concat_ws(" ", F.pmod(n - 1 + F.col("l_partkey"), F.lit(5)).cast("string"), *[_digits(x) for x in numbers])
    # some images repeat one line
    text = F.when(o % 29 == 11, F.lit("1 0.5000 0.5000 0.2500 0.2500")).otherwise(text)
    text = F.when(o % 17 == 3, F.concat(text, F.lit(" 0.5"))).when(o % 19 == 5, F.concat(F.lit("abc"), F.substring(text, 2, 99))).when(o % 23 == 7, F.regexp_replace(text, r" [0-9.]+$", " nan")).otherwise(text)
    split = F.when(o % 10 < 7, "train").when(o % 10 < 9, "val").otherwise("test")
    return table(spark, folder, "lineitem").select(o.alias("image"), n.alias("line_no"), split.alias("split"), text.alias("line"))


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    return D.judged(_lines(spark, folder)).where("error is null").select("image", "line_no", "split", "class_id", "x", "y", "w", "h")


def label_line_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The first rule that each label line breaks, counted."""
    return D.judged(_lines(spark, folder)).groupBy("split", F.coalesce("error", F.lit("valid")).alias("verdict")).agg(F.count(F.lit(1)).alias("n_lines"))


def label_class_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Instances per split and class, per class and in all; lines are counted once, and the few counts rolled up."""
    counted = _boxes(spark, folder).groupBy("split", "class_id").agg(F.count(F.lit(1)).alias("n"))
    return spark.sql(
        """select coalesce(split, 'all') split, coalesce(cast(class_id as string), 'all') class_id, sum(n) n_instances
        from {counted} group by grouping sets ((split, class_id), (class_id), ())""", counted=counted,
    )


def duplicate_label_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Valid lines of a file that repeat an earlier line of it, blanks at the ends aside."""
    w = W.partitionBy("image", "line").orderBy("line_no")
    rows = D.judged(_lines(spark, folder)).where("error is null").select("image", "line_no", F.trim("line").alias("line"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n > 1").select("image", "line_no", "line")


def stem_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Stems in more than one split, each later split against the first in the order train, val, test."""
    rank = F.when(F.col("s") == "train", 0).when(F.col("s") == "val", 1).otherwise(2)
    rows = table(spark, folder, "public_images").select(F.col("original_stem").alias("stem"), split_name(F.col("split")).alias("s")).where("stem is not null and s is not null").distinct()
    w = W.partitionBy("stem").orderBy(rank)
    return rows.select("stem", F.col("s").alias("split"), F.first("s").over(w).alias("first_split"), F.row_number().over(w).alias("n")).where("n > 1").drop("n")


def missing_labels_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Images without label."""
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("image")).join(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("image")), "image", "left_anti")


def orphan_labels_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Labels whose image isn't among the orders of the first priorities."""
    images = table(spark, folder, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("image"))
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("image")).join(images, "image", "left_anti").groupBy("image").agg(F.count(F.lit(1)).alias("n_labels"))


def class_remap(spark: SparkSession, folder: str) -> DataFrame:
    """Class ids shifted by a fixed map, the rest of the line as it was; ids outside the map are told apart."""
    parts = F.split("line", r"\s+", 2)
    mapped = F.element_at(F.create_map(*[F.lit(x) for x in ("0", "1", "1", "2", "2", "3")]), F.get(parts, F.lit(0)))
    rows = _lines(spark, folder).select("image", "line_no", mapped.alias("m"), F.get(parts, F.lit(1)).alias("rest"))
    return rows.select("image", "line_no", F.when(F.col("m").isNull(), "rejected").otherwise(F.concat_ws(" ", "m", "rest")).alias("line"))


def class_histogram_before_after(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per class id before and after the map, for ids that it knows."""
    before = F.substring_index("line", " ", 1)
    after = F.element_at(F.create_map(*[F.lit(x) for x in ("0", "1", "1", "2", "2", "3")]), before)
    rows = _lines(spark, folder).select(before.alias("b"), after.alias("a")).where("a is not null")
    return rows.select(F.explode(F.array(F.struct(F.lit("before").alias("phase"), F.col("b").alias("class_id")), F.struct(F.lit("after").alias("phase"), F.col("a").alias("class_id")))).alias("x")).groupBy("x.phase", "x.class_id").agg(F.count(F.lit(1)).alias("n"))


def remap_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Class ids of a source with another order of names, mapped by name; coordinates with six digits."""
    source = ["vest", "helmet", "no_helmet", "no_vest"]
    target = F.create_map(*[F.lit(x) for i, n in enumerate(source) for x in (i, D.CLASSES.index(n))])
    return _boxes(spark, folder).select("image", "line_no", F.format_string("%d %.6f %.6f %.6f %.6f", F.element_at(target, F.col("class_id")), "x", "y", "w", "h").alias("line"))


def source_group_leakage(spark: SparkSession, folder: str) -> DataFrame:
    """Source groups in more than one split as written, blanks left out."""
    rows = table(spark, folder, "person_crops").select(strip(F.col("source_group")).alias("g"), strip(F.col("split")).alias("s")).where("g <> '' and s <> ''")
    return rows.groupBy("g").agg(F.array_join(F.sort_array(F.collect_set("s")), ",").alias("splits"), F.count_distinct("s").alias("n")).where("n > 1").select(F.col("g").alias("source_group"), "splits")


def group_split_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """whole source groups dealt to splits in the order of a digest, 15 % each to val and test."""
    return D.split_groups(table(spark, folder, "person_crops"), "source_group", (0.15, 0.15), Scratch(spark))


def images_per_split(spark: SparkSession, folder: str) -> DataFrame:
    """Images per split and in all."""
    rows = table(spark, folder, "public_images").select("image_id", F.coalesce(split_name(F.col("split")), F.lit("none")).alias("split")).distinct()
    return rows.rollup("split").agg(F.count(F.lit(1)).alias("n_images")).select(F.coalesce("split", F.lit("all")).alias("split"), "n_images")


def _dataset_of_lines() -> Column:
    return F.col("image") % 1009


def training_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Of each dataset the first condition that keeps it from training, in the reference's order, and its first three errors."""
    images = table(spark, folder, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("source_group"))
    split = F.when(F.col("image") % 10 < 7, "train").when(F.col("image") % 10 < 9, "val").otherwise("test")
    images = images.select(_dataset_of_lines().alias("dataset"), "image", split.alias("split"), "source_group")
    lines = D.judged(_lines(spark, folder)).select(_dataset_of_lines().alias("dataset"), "image", "line_no", "error")
    return D.gate(images, lines, "dataset").select("dataset", "n_images", "n_train", "n_val", "n_instances", "n_leaks", "reason")


def freeze_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Of each selection round the conditions for freezing it, and FROZEN if all hold."""
    rows = table(spark, folder, "validation_records").where("record_id is not null and selection_round is not null").select("record_id", "selection_round", "crop_filename", "camera_id", "clip_id", "source_frame_number", "sha256", "review_priority").distinct()
    traced = F.col("camera_id").isNotNull() & F.col("clip_id").isNotNull() & F.col("source_frame_number").isNotNull()
    held = _contaminated(spark, folder).groupBy("record_id").agg(F.count(F.lit(1)).alias("_k"))
    rows = rows.join(held, "record_id", "left")
    r = rows.groupBy("selection_round").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(traced).alias("n_traced"), F.count_distinct("sha256").alias("n_digests"), F.count_distinct("crop_filename").alias("n_names"),
        F.count_distinct("review_priority").alias("n_priorities"), F.count("_k").alias("n_overlapping"),
    )
    holds = (F.col("n_records") > 0) & (F.col("n_traced") == F.col("n_records")) & (F.col("n_digests") == F.col("n_records")) & (F.col("n_names") == F.col("n_records")) & (F.col("n_overlapping") == 0)
    return r.withColumn("status", F.when(holds, "FROZEN").otherwise("BLOCKED"))


def exact_duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the same digest."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest")).distinct()
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def cross_dataset_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Images of each dataset whose pixels another dataset has too."""
    rows = table(spark, folder, "public_images").where("pixel_hash is not null and dataset_identity is not null").select("image_id", "dataset_identity", F.lower("pixel_hash").alias("px")).distinct()
    spread = rows.groupBy("px").agg(F.min("dataset_identity").alias("a"), F.max("dataset_identity").alias("b")).where("a <> b").select("px")
    return rows.join(spread, "px", "left_semi").groupBy("dataset_identity").agg(F.count(F.lit(1)).alias("n_images"))


def _contaminated(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "validation_records").where("record_id is not null and selection_round is not null").select("record_id", "selection_round", "crop_filename", "sha256", "perceptual_hash").distinct()
    return D.seen_before(rows, "record_id", "selection_round", {"name": F.col("crop_filename"), "file": F.col("sha256"), "decoded": F.col("perceptual_hash").cast("string")})


def contamination_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose name, file digest or decoded fingerprint is among those of earlier rounds."""
    return _contaminated(spark, folder)


def original_name_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """names before the export."""
    return table(spark, folder, "validation_records").where("crop_filename like '%.rf.%'").select("record_id", D.original_name(F.col("crop_filename")).alias("original_name")).distinct()


def timestamp_from_name(spark: SparkSession, folder: str) -> DataFrame:
    """seconds that source image names end in."""
    return table(spark, folder, "person_crops").select("source_image", D.name_seconds(F.col("source_image")).alias("seconds")).where("seconds is not null").distinct()


def provenance_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Records traced by their recovered name, manual ones, and those unresolved."""
    prepared = table(spark, folder, "person_crops").select(F.col("crop_filename").alias("original")).where("original is not null").distinct().withColumn("_known", F.lit(True))
    rows = table(spark, folder, "validation_records").where("crop_filename is not null").select("record_id", "crop_filename").distinct()
    rows = rows.withColumn("original", F.when(F.col("crop_filename").contains(".rf."), D.original_name(F.col("crop_filename"))).otherwise(F.col("crop_filename")))
    kind = F.when(F.col("_known"), "prepared").when(F.col("crop_filename").contains("_manual_"), "manual").otherwise("unresolved")
    return rows.join(prepared, "original", "left").groupBy(kind.alias("provenance")).agg(F.count(F.lit(1)).alias("n"))


def phash_bits(spark: SparkSession, folder: str) -> DataFrame:
    """fingerprints of 8x8 coefficients."""
    return table(spark, folder, "embeddings").select("vec_id", D.fingerprint(F.col("embedding")).alias("perceptual_hash"))


def near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Different fingerprints within three bits of each other, and how many images bear each."""
    h = table(spark, folder, "public_images").where("perceptual_hash is not null").select("image_id", "perceptual_hash").distinct().groupBy("perceptual_hash").agg(F.count(F.lit(1)).alias("n"))
    scratch = Scratch(spark)
    h = scratch.save(h)
    pairs = near_pairs(h.select(F.col("perceptual_hash").alias("hl")), h.select(F.col("perceptual_hash").alias("hr")), RADIUS, scratch).where("hl < hr")
    a, b = h.select(F.col("perceptual_hash").alias("hl"), F.col("n").alias("n_a")), h.select(F.col("perceptual_hash").alias("hr"), F.col("n").alias("n_b"))
    return pairs.join(a, "hl").join(b, "hr").select(F.col("hl").alias("hash_a"), F.col("hr").alias("hash_b"), bit_distance(F.col("hl"), F.col("hr")).alias("distance"), "n_a", "n_b")


def near_dup_components(spark: SparkSession, folder: str) -> DataFrame:
    """G1: images with a copy or near copy and their group."""
    return D.near_duplicate_groups(table(spark, folder, "public_images"), "image_id", "perceptual_hash", RADIUS, Scratch(spark))


def _grouped(spark: SparkSession, folder: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of groups with what the images say of themselves, all pairs of fingerprints, and all images."""
    rows = table(spark, folder, "public_images").where("image_id is not null")
    members, _, near = D.near_duplicates(rows, "image_id", "perceptual_hash", RADIUS, scratch)
    images = rows.groupBy("image_id").agg(
        F.min(split_name(F.col("split"))).alias("split"), F.min(F.lower("pixel_hash")).alias("px"), F.min("original_stem").alias("stem"), F.min("relative_path").alias("path"), F.min("dataset_identity").alias("source"),
    )
    return scratch.save(members.join(images, "image_id")), near, images


def _group_status(members: DataFrame, near: DataFrame) -> DataFrame:
    known = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_images"), F.count_distinct("split").alias("n_splits"), F.min("path").alias("path"))
    for c in ("px", "stem"):
        known = known.join(D.group_matches(members, near, c).withColumn(f"same_{c}", F.lit(True)), "group_id", "left")
    return known.select(
        "group_id", "path", "n_images", "n_splits", F.when(F.col("same_px"), "CLEAR_SAME_SOURCE_NEAR_DUPLICATE").when(F.col("same_stem"), "LIKELY_SAME_SOURCE").otherwise("REVIEW_REQUIRED").alias("review_status"),
        F.when(F.col("n_splits") > 1, "KEEP_WHOLE_GROUP_IN_ONE_SPLIT").otherwise("KEEP_GROUP_TOGETHER_IF_RESPLIT").alias("handling"),
    )


def near_dup_group_status(spark: SparkSession, folder: str) -> DataFrame:
    """Members, splits and review status of each group; only pairs within the threshold count as evidence, not chains."""
    members, near, _ = _grouped(spark, folder, Scratch(spark))
    return _group_status(members, near).drop("path")


def near_dup_group_report(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the groups, which are numbered by their smallest path."""
    scratch = Scratch(spark)
    members, near, _ = _grouped(spark, folder, scratch)
    status = _group_status(members, near)
    numbered = index_rows(status.select("group_id", F.coalesce("path", F.lit("")).alias("path")), ["path", "group_id"], scratch, "i")
    names = numbered.select("group_id", F.format_string("PUBLIC_DUP_%04d", F.col("i") + 1).alias("group_name")).join(status.select("group_id", "review_status"), "group_id")
    return members.join(names, "group_id").select("group_name", "review_status", "image_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("split", F.lit("")).alias("split"), F.coalesce("stem", F.lit("")).alias("stem"))


def near_dup_group_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of different fingerprints that tie each group, with the smallest image of either."""
    members, near, _ = _grouped(spark, folder, Scratch(spark))
    first = members.groupBy("h", "group_id").agg(F.min("image_id").alias("image"))
    a, b = first.select(F.col("h").alias("hl"), "group_id", F.col("image").alias("image_a")), first.select(F.col("h").alias("hr"), F.col("image").alias("image_b"))
    return near.join(a, "hl").join(b, "hr").select("group_id", F.least("image_a", "image_b").alias("image_a"), F.greatest("image_a", "image_b").alias("image_b"), bit_distance(F.col("hl"), F.col("hr")).alias("distance"))


def near_dup_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Images scanned, pairs within and across splits, groups, those across splits, and images in them."""
    members, near, images = _grouped(spark, folder, Scratch(spark))
    groups = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("k"))
    g = groups.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_cross_split_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_images_involved"))
    return images.agg(F.count(F.lit(1)).alias("n_images")).crossJoin(D.split_pairs(members, near, "split")).crossJoin(g)  # one row each


def image_group_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every image with its group and status, looked up for images of public sources only."""
    members, near, images = _grouped(spark, folder, Scratch(spark))
    found = members.select("image_id", "group_id").join(_group_status(members, near).select("group_id", "review_status"), "group_id")
    public = F.col("source").isNotNull()
    return images.select("image_id", "source").join(found.withColumnRenamed("image_id", "_id"), (F.col("image_id") == F.col("_id")) & public, "left").select("image_id", F.coalesce("source", F.lit("site")).alias("source"), F.coalesce("group_id", F.lit(-1)).alias("group_id"), F.coalesce("review_status", F.lit("none")).alias("review_status"))


def _crops(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "person_crops").where("crop_id is not null").groupBy("crop_id").agg(
        F.min("source_group").alias("source_group"), F.min("crop_filename").alias("crop_filename"), F.min("person_detection_confidence").alias("confidence"), F.min("crop_height_px").alias("height")
    )


def select_capped_topn(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred most confident crops, at most 25 of a source group."""
    rows = _crops(spark, folder).where("source_group is not null and confidence is not null")
    return D.capped_top(rows, "source_group", [F.desc("confidence"), F.asc("crop_filename"), F.asc("crop_id")], 25, 100).select("crop_id", "source_group", "confidence")


def select_round_robin_diverse(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred crops, source group by source group in turn, the most confident first, none within three bits of an accepted one.

    Crops have no fingerprint in the tables; one is made of the id, so that some are near each other.
    """
    rows = _crops(spark, folder).where("source_group is not null and confidence is not null").withColumn("name", F.coalesce("crop_filename", F.lit("")))
    rows = rows.withColumn("h", F.col("crop_id") * 7919 % 997 * 918273645546372 + F.col("crop_id") % 4)
    return D.diverse(rows, "source_group", "crop_id", "h", [F.desc("confidence"), F.asc("name"), F.asc("crop_id")], 100, RADIUS, Scratch(spark))


def set_intersect_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Crop names that occur both in the first round and in a later one."""
    v = table(spark, folder, "validation_records").where("crop_filename is not null")
    return v.where("selection_round > 1").select("crop_filename").intersect(v.where("selection_round = 1").select("crop_filename"))


def set_except_remaining(spark: SparkSession, folder: str) -> DataFrame:
    """Records of later rounds whose name the first round hasn't."""
    v = table(spark, folder, "validation_records").where("crop_filename is not null")
    return v.where("selection_round > 1").select("crop_filename").exceptAll(v.where("selection_round = 1").select("crop_filename")).distinct()


def uniqueness_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Row ids delivered more than once."""
    return table(spark, folder, "validation_records").groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def class_set_equality(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the class names that a dataset's labels use are exactly the fixed ones."""
    names = F.element_at(F.array(*[F.lit(c) for c in D.CLASSES]), F.col("class_id") + 1)
    used = _boxes(spark, folder).groupBy(_dataset_of_lines().alias("dataset")).agg(F.sort_array(F.collect_set(names)).alias("names"))  # at most the fixed classes
    return used.select("dataset", F.array_join("names", ",").alias("names"), (F.col("names") == F.array(*[F.lit(c) for c in sorted(D.CLASSES)])).alias("complete"))


def size_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Crops per size bucket over the full domain of buckets."""
    bucket = F.when(F.col("height") >= 400, "near").when(F.col("height") >= 200, "medium").otherwise("distant")
    counted = _crops(spark, folder).where("height is not null").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    domain = spark.createDataFrame([(b,) for b in ("near", "medium", "distant", "unreadable")], "bucket string")
    return domain.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def sheet_pagination(spark: SparkSession, folder: str) -> DataFrame:
    """Page, row and column of each validation record's thumbnail, 30 a sheet in 5 columns, by clip."""
    rows = table(spark, folder, "validation_records").where("record_id is not null").groupBy("record_id").agg(F.min("clip_id").alias("clip_id")).where("clip_id is not null")
    i = F.row_number().over(W.partitionBy("clip_id").orderBy("record_id")) - 1
    return rows.withColumn("i", i).select("record_id", F.floor(F.col("i") / 30).alias("page"), F.floor(F.col("i") % 30 / 5).alias("row"), (F.col("i") % 5).alias("column"))


def frame_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """Frames sampled every few seconds, their 30 s block and zero-padded names."""
    fps, every = 12.5, 2.0
    step = max(1, round(fps * every))
    rows = table(spark, folder, "validation_records").where(f"source_frame_number is not null and pmod(source_frame_number, {step}) = 0")
    t = F.col("source_frame_number") / fps
    return rows.select(
        "source_frame_number", F.floor(t / 30).alias("block"), F.format_string("t%07d", F.floor(t * 1000)).alias("name")
    ).distinct()


def time_aligned_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of two sources aligned on the frame index that their seconds give at 12.5 frames a second."""
    a = table(spark, folder, "validation_records").where("source_timestamp_seconds is not null").select(F.bround(F.col("source_timestamp_seconds") * 12.5).cast("long").alias("frame")).groupBy("frame").agg(F.count(F.lit(1)).alias("n_a"))
    b = table(spark, folder, "safety_events").where("source_timestamp_seconds is not null").select(F.bround(F.col("source_timestamp_seconds") * 12.5).cast("long").alias("frame")).groupBy("frame").agg(F.count(F.lit(1)).alias("n_b"))
    return a.join(b, "frame")


def crop_source_join(spark: SparkSession, folder: str) -> DataFrame:
    """Crops per split of their group, train where there is none."""
    dealt = group_split_assignment(spark, folder)
    crops = table(spark, folder, "person_crops").select("crop_id", "source_group").distinct()
    return crops.join(dealt, "source_group", "left").groupBy(F.coalesce("split", F.lit("train")).alias("split")).agg(F.count(F.lit(1)).alias("n_crops"))


def _selected(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the last rounds with the crop and, by it, the source frame they were cut from; absent where there is none."""
    crops = table(spark, folder, "person_crops").where("crop_filename is not null").groupBy("crop_filename").agg(F.min("source_image").alias("source_image"), F.min("crop_id").alias("crop_id"))
    frames = table(spark, folder, "person_crops").where("source_image is not null").groupBy("source_image").agg(F.min("camera_id").alias("frame_camera"), F.min("source_clip").alias("frame_clip"))
    rows = table(spark, folder, "validation_records").where("record_id is not null and crop_filename is not null").groupBy("record_id").agg(F.min("crop_filename").alias("name"), F.min("source_frame_filename").alias("frame"))
    wanted = rows.unionByName(table(spark, folder, "person_crops").where("crop_id % 7 = 0 and crop_filename is not null").groupBy((-F.col("crop_id")).alias("record_id")).agg(F.min("crop_filename").alias("name"), F.min("source_image").alias("frame")))
    return wanted.join(crops.withColumnRenamed("crop_filename", "name"), "name", "left").join(frames, "source_image", "left")


def crop_frame_join(spark: SparkSession, folder: str) -> DataFrame:
    """Crops with the first frame record of their source image."""
    return _selected(spark, folder).where("crop_id is not null").select("record_id", "crop_id", F.coalesce("source_image", F.lit("")).alias("source_image"), F.coalesce("frame_camera", F.lit("")).alias("frame_camera"), F.coalesce("frame_clip", F.lit("")).alias("frame_clip"))


def selection_reference_check(spark: SparkSession, folder: str) -> DataFrame:
    """Selected records and what of crop and frame is absent; ``operators.datasets.referred`` makes such rows an error."""
    why = F.when(F.col("crop_id").isNull(), "crop").when(F.col("frame_camera").isNull() & F.col("frame_clip").isNull(), "frame").otherwise("none")
    return _selected(spark, folder).groupBy(why.alias("absent")).agg(F.count(F.lit(1)).alias("n"))


def selection_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Of each round after the first whether its selection is not empty, names no crop twice, gives each a priority, and leaves out the first round."""
    v = table(spark, folder, "validation_records").where("record_id is not null and selection_round is not null").select("record_id", "selection_round", "crop_filename", "review_priority").distinct()
    first = v.where("selection_round = 1 and crop_filename is not null").select("crop_filename").distinct().withColumn("_first", F.lit(True))
    rows = v.where("selection_round > 1").join(first, "crop_filename", "left")
    r = rows.groupBy("selection_round").agg(
        F.count(F.lit(1)).alias("n"), (F.count("crop_filename") - F.count_distinct("crop_filename")).alias("n_twice"), F.count_if(F.col("review_priority").isNull()).alias("n_without_priority"), F.count("_first").alias("n_of_first_round"),
    )
    reason = F.when(F.col("n_twice") > 0, "duplicate crop names").when(F.col("n_without_priority") > 0, "unsupported review priority").when(F.col("n_of_first_round") > 0, "overlaps the first round").otherwise("valid")
    return r.withColumn("verdict", reason)


def listing_sorts(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty images of each source by path, numbered in that order."""
    rows = table(spark, folder, "public_images").where("relative_path is not null and dataset_identity is not null").select("dataset_identity", "relative_path").distinct()
    return rows.withColumn("n", F.row_number().over(W.partitionBy("dataset_identity").orderBy("relative_path"))).where("n <= 20")


def video_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether as many frames of each video were decoded as it declares, and how long it is.

    Videos are orders, frames their line items; some frames are lost on purpose.
    """
    frames = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("frame"), F.max("l_linenumber").over(W.partitionBy("l_orderkey")).alias("declared"))
    frames = frames.where(~((F.col("video") % 13 == 4) & (F.col("frame") == 2)))
    return D.integrity(frames, "video", "declared", 12.5)


QUERIES = {
    f.__name__: f
    for f in (
        label_line_validation, label_class_rollup, duplicate_label_rows, stem_collisions, missing_labels_anti, orphan_labels_anti, class_remap, class_histogram_before_after, remap_by_name,
        source_group_leakage, group_split_assignment, images_per_split, training_gate, freeze_gate, exact_duplicate_groups, cross_dataset_overlap, contamination_semi, original_name_recovery,
        timestamp_from_name, provenance_classify, phash_bits, near_dup_pairs, near_dup_components, near_dup_group_status, near_dup_group_report, near_dup_group_pairs, near_dup_summary, image_group_lookup, select_capped_topn, select_round_robin_diverse,
        set_intersect_guard, set_except_remaining, uniqueness_guard, class_set_equality, size_buckets, sheet_pagination, frame_sampling, time_aligned_frames, crop_source_join,
        crop_frame_join, selection_reference_check, selection_validation, listing_sorts, video_integrity,
    )
}

_T = "concat(cast(floor(({0}) * 10000) as bigint) // 10000, '.', lpad((cast(floor(({0}) * 10000) as bigint) % 10000)::varchar, 4, '0'))"
_LINES = f"""
raw as (select l_orderkey image, l_linenumber line_no, case when l_orderkey % 10 < 7 then 'train' when l_orderkey % 10 < 9 then 'val' else 'test' end split,
  concat_ws(' ', (l_linenumber - 1 + l_partkey) % 5, {_T.format('l_discount * 10 + 0.0')}, {_T.format('l_tax * 10 + 0.0')}, {_T.format('l_quantity / 50')}, {_T.format('l_extendedprice / 105000')}) u from lineitem),
plain as (select *, case when image % 29 = 11 then '1 0.5000 0.5000 0.2500 0.2500' else u end t from raw),
lines as (select image, line_no, split, case when image % 17 = 3 then t || ' 0.5' when image % 19 = 5 then 'abc' || substr(t, 2) when image % 23 = 7 then regexp_replace(t, ' [0-9.]+$', ' nan') else t end line from plain)"""
_VERDICT = _LINES + """,
tok as (select *, str_split(line, ' ') p from lines),
num as (select *, try_cast(p[1] as int) klass, try_cast(p[2] as double) x, try_cast(p[3] as double) y, try_cast(p[4] as double) w, try_cast(p[5] as double) h from tok),
judged as (select *, case when len(p) <> 5 then 'token_count' when klass is null then 'class_not_a_number' when klass not between 0 and 3 then 'class_range'
  when not (coalesce(isfinite(x), false) and coalesce(isfinite(y), false) and coalesce(isfinite(w), false) and coalesce(isfinite(h), false)) then 'not_finite'
  when x not between 0 and 1 or y not between 0 and 1 then 'centre_range' when w <= 0 or w > 1 or h <= 0 or h > 1 then 'size_range' else 'valid' end verdict from num)"""
_STRIP = "nullif(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '')"
_LOW = f"lower({_STRIP})"
_SPLIT = f"case when {_LOW} in ('valid', 'validation') then 'val' else {_LOW} end".replace("{0}", "split")
_ORIGINAL = "regexp_replace(split_part(crop_filename, '.rf.', 1), '_([^_]*)$', '.\\1')"
_CROPS = "crops as (select crop_id, min(source_group) source_group, min(crop_filename) crop_filename, min(person_detection_confidence) confidence, min(crop_height_px) height from person_crops where crop_id is not null group by 1)"
_DEALT = """names as (select distinct source_group from person_crops where source_group is not null),
c as (select *, row_number() over (order by md5(source_group), source_group) - 1 i, count(*) over () n from names),
k as (select *, greatest(1, cast(round_even(n * 0.15::double, 0) as bigint)) v from c),
dealt as (select source_group, case when i < greatest(1, n - 2 * v) then 'train' when i < greatest(1, n - 2 * v) + v then 'val' else 'test' end split from k)"""
_GROUPS = """im as (select distinct image_id, perceptual_hash h from public_images where image_id is not null and perceptual_hash is not null),
e as (select a.image_id a, b.image_id b from im a join im b on a.image_id <> b.image_id and bit_count(xor(a.h, b.h)) <= 3),
reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on e.a = r.b),
grouped as (select a image_id, least(a, min(b)) group_id from reach group by a)"""
_MEMBERS = _GROUPS + f""",
pi as (select image_id, min({_SPLIT}) split, min(lower(pixel_hash)) px, min(original_stem) stem, min(relative_path) path, min(dataset_identity) source from public_images where image_id is not null group by 1),
mem as (select g.group_id, g.image_id, pi.split, px, stem, path, h from grouped g join pi using (image_id) join im using (image_id)),
ev as (select x.group_id, bool_or(x.px = y.px) same_px, bool_or(x.stem = y.stem) same_stem from e join mem x on x.image_id = e.a join mem y on y.image_id = e.b group by 1),
st as (select m.group_id, min(path) path, count(*) n_images, count(distinct split) n_splits, any_value(case when same_px then 'CLEAR_SAME_SOURCE_NEAR_DUPLICATE' when same_stem then 'LIKELY_SAME_SOURCE' else 'REVIEW_REQUIRED' end) review_status
  from mem m join ev using (group_id) group by 1)"""

_SEEN = """v as (select distinct record_id, selection_round, crop_filename, sha256, perceptual_hash from validation_records where record_id is not null and selection_round is not null),
k as (select record_id, selection_round r, 'name' "by", crop_filename x from v union all select record_id, selection_round, 'file', sha256 from v union all select record_id, selection_round, 'decoded', perceptual_hash::varchar from v),
m as (select "by", x, min(r) r from k where x is not null group by 1, 2),
seen as (select distinct k.record_id, k."by" from k join m on k."by" = m."by" and k.x = m.x and m.r < k.r)"""

SQL = {
    "label_line_validation": f"with {_VERDICT} select split, verdict, count(*) n_lines from judged group by 1, 2",
    "label_class_rollup": f"with {_VERDICT} select coalesce(split, 'all') split, coalesce(klass::varchar, 'all') class_id, count(*) n_instances from judged where verdict = 'valid' group by grouping sets ((split, klass), (klass), ())",
    "duplicate_label_rows": f"with {_VERDICT} select image, line_no, line from judged where verdict = 'valid' qualify row_number() over (partition by image, trim(line) order by line_no) > 1",
    "stem_collisions": f"""with r as (select distinct original_stem stem, {_SPLIT} split from public_images where original_stem is not null and {_SPLIT} is not null),
o as (select *, case split when 'train' then 0 when 'val' then 1 else 2 end k from r)
select stem, split, first_value(split) over (partition by stem order by k) first_split from o qualify row_number() over (partition by stem order by k) > 1""",
    "missing_labels_anti": "select o_orderkey image from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "orphan_labels_anti": "select l_orderkey image, count(*) n_labels from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority <> '5-LOW') group by 1",
    "class_remap": f"""with {_LINES} select image, line_no, case when split_part(line, ' ', 1) in ('0', '1', '2') then concat(split_part(line, ' ', 1)::int + 1, regexp_replace(line, '^\\S+', '')) else 'rejected' end line from lines""",
    "class_histogram_before_after": f"""with {_LINES}, k as (select split_part(line, ' ', 1) b from lines where split_part(line, ' ', 1) in ('0', '1', '2'))
select 'before' phase, b class_id, count(*) n from k group by 2 union all select 'after', (b::int + 1)::varchar, count(*) from k group by 2""",
    "remap_by_name": f"with {_VERDICT} select image, line_no, printf('%d %.6f %.6f %.6f %.6f', case klass when 0 then 3 when 1 then 0 when 2 then 1 else 2 end, x, y, w, h) line from judged where verdict = 'valid'",
    "source_group_leakage": f"""with r as (select distinct {_STRIP.format('source_group')} g, {_STRIP.format('split')} s from person_crops)
select g source_group, string_agg(s, ',' order by s) splits from r where g is not null and s is not null group by 1 having count(*) > 1""",
    "group_split_assignment": f"with {_DEALT} select * from dealt",
    "images_per_split": f"""with r as (select distinct image_id, coalesce({_SPLIT}, 'none') split from public_images)
select coalesce(split, 'all') split, count(*) n_images from r group by rollup (split)""",
    "training_gate": f"""with {_VERDICT},
im as (select o_orderkey % 1009 dataset, o_orderkey image, o_custkey g, case when o_orderkey % 10 < 7 then 'train' when o_orderkey % 10 < 9 then 'val' else 'test' end s from orders),
a as (select dataset, count(*) n_images, count(*) filter (where s = 'train') n_train, count(*) filter (where s = 'val') n_val from im group by 1),
l as (select dataset, count(*) n_leaks from (select dataset, g from im where g is not null group by 1, 2 having count(distinct s) > 1) group by 1),
j as (select image % 1009 dataset, image, line_no, verdict from judged),
i as (select dataset, count(*) filter (where verdict = 'valid') n_instances from j group by 1),
e as (select dataset, string_agg(concat(image, ':', line_no, ' ', verdict), '; ' order by image, line_no, verdict) errors from
  (select * from j where verdict <> 'valid' qualify row_number() over (partition by dataset order by image, line_no, verdict) <= 3) group by 1)
select dataset, n_images, n_train, n_val, coalesce(n_instances, 0) n_instances, coalesce(n_leaks, 0) n_leaks, case when errors is not null then 'fatal errors: ' || errors when n_images = 0 then 'no images'
  when n_train = 0 then 'train split is empty' when n_val = 0 then 'validation split is empty' when coalesce(n_instances, 0) = 0 then 'no labelled instances' when coalesce(n_leaks, 0) > 0 then 'source groups leak' else 'passed' end reason
from a left join l using (dataset) left join i using (dataset) left join e using (dataset)""",
    "freeze_gate": f"""with {_SEEN},
rows_ as (select distinct record_id, selection_round, crop_filename, camera_id, clip_id, source_frame_number, sha256, review_priority from validation_records where record_id is not null and selection_round is not null),
a as (select selection_round, count(*) n_records, count(*) filter (where camera_id is not null and clip_id is not null and source_frame_number is not null) n_traced, count(distinct sha256) n_digests,
  count(distinct crop_filename) n_names, count(distinct review_priority) n_priorities, count(*) filter (where record_id in (select record_id from seen)) n_overlapping from rows_ group by 1)
select *, case when n_traced = n_records and n_digests = n_records and n_names = n_records and n_overlapping = 0 then 'FROZEN' else 'BLOCKED' end status from a""",
    "exact_duplicate_groups": "with r as (select distinct doc_id, sha256(text) digest from documents where text is not null) select digest, count(*) n, min(doc_id) first_doc from r group by 1 having count(*) > 1",
    "cross_dataset_overlap": """with r as (select distinct image_id, dataset_identity, lower(pixel_hash) px from public_images where pixel_hash is not null and dataset_identity is not null)
select dataset_identity, count(*) n_images from r where px in (select px from r group by 1 having count(distinct dataset_identity) > 1) group by 1""",
    "contamination_semi": f"with {_SEEN} select * from seen",
    "original_name_recovery": f"select distinct record_id, {_ORIGINAL} original_name from validation_records where crop_filename like '%.rf.%'",
    "timestamp_from_name": """with r as (select distinct source_image, regexp_extract(regexp_replace(regexp_replace(source_image, '^.*/', ''), '\\.[^.]*$', ''), '_t(\\d+)$', 1) t from person_crops)
select source_image, try_cast(t as bigint) / 1000 "seconds" from r where try_cast(t as bigint) is not null""",
    "provenance_classify": f"""with r as (select distinct record_id, crop_filename, case when contains(crop_filename, '.rf.') then {_ORIGINAL} else crop_filename end o from validation_records where crop_filename is not null)
select case when o in (select crop_filename from person_crops where crop_filename is not null) then 'prepared' when contains(crop_filename, '_manual_') then 'manual' else 'unresolved' end provenance, count(*) n from r group by 1""",
    "phash_bits": """with v as (select vec_id, unnest(embedding) x, unnest(range(64)) i from embeddings),
m as (select vec_id, list_sort(embedding[2:64])[32] med from embeddings),
s as (select vec_id, sum(case when x > med then 1::hugeint << i::int else 0::hugeint end) b from v join m using (vec_id) group by 1)
select vec_id, cast(case when b >= 9223372036854775808 then b - 18446744073709551616 else b end as bigint) perceptual_hash from s""",
    "near_dup_pairs": """with h as (select perceptual_hash h, count(distinct image_id) n from public_images where perceptual_hash is not null group by 1)
select a.h hash_a, b.h hash_b, cast(bit_count(xor(a.h, b.h)) as int) distance, a.n n_a, b.n n_b from h a join h b on a.h < b.h and bit_count(xor(a.h, b.h)) <= 3""",
    "near_dup_components": f"with recursive {_GROUPS} select * from grouped",
    "near_dup_group_status": f"""with recursive {_MEMBERS} select group_id, n_images, n_splits, review_status, case when n_splits > 1 then 'KEEP_WHOLE_GROUP_IN_ONE_SPLIT' else 'KEEP_GROUP_TOGETHER_IF_RESPLIT' end handling from st""",
    "select_capped_topn": f"""with {_CROPS}, k as (select * from crops where source_group is not null and confidence is not null qualify row_number() over (partition by source_group order by confidence desc, crop_filename, crop_id) <= 25)
select crop_id, source_group, confidence from k order by confidence desc, crop_filename, crop_id limit 100""",
    "set_intersect_guard": "select crop_filename from validation_records where selection_round > 1 and crop_filename is not null intersect select crop_filename from validation_records where selection_round = 1",
    "set_except_remaining": """with v as (select * from validation_records where crop_filename is not null)
select distinct crop_filename from (select crop_filename from v where selection_round > 1 except all select crop_filename from v where selection_round = 1)""",
    "uniqueness_guard": "select record_id, count(*) n from validation_records group by 1 having count(*) > 1",
    "class_set_equality": f"""with {_VERDICT} select image % 1009 dataset, string_agg(distinct n, ',' order by n) "names", count(distinct n) = 4 complete from (select image, ['helmet', 'no_helmet', 'no_vest', 'vest'][klass + 1] n from judged where verdict = 'valid') group by 1""",
    "size_buckets": f"""with {_CROPS}, b as (select case when height >= 400 then 'near' when height >= 200 then 'medium' else 'distant' end bucket, count(*) n from crops where height is not null group by 1)
select d.bucket, coalesce(n, 0) n from (values ('near'), ('medium'), ('distant'), ('unreadable')) d(bucket) left join b using (bucket)""",
    "sheet_pagination": """with r as (select record_id, min(clip_id) clip_id from validation_records where record_id is not null group by 1 having min(clip_id) is not null),
i as (select record_id, row_number() over (partition by clip_id order by record_id) - 1 i from r)
select record_id, i // 30 page, i % 30 // 5 "row", cast(i % 5 as int) "column" from i""",
    "frame_sampling": """select distinct source_frame_number, cast(floor(source_frame_number / 12.5 / 30) as bigint) block, printf('t%07d', cast(floor(source_frame_number / 12.5 * 1000) as bigint)) name
from validation_records where source_frame_number is not null and source_frame_number % 25 = 0""",
    "time_aligned_frames": """with a as (select cast(round_even(source_timestamp_seconds * 12.5::double, 0) as bigint) frame, count(*) n_a from validation_records where source_timestamp_seconds is not null group by 1),
b as (select cast(round_even(source_timestamp_seconds * 12.5::double, 0) as bigint) frame, count(*) n_b from safety_events where source_timestamp_seconds is not null group by 1)
select frame, n_a, n_b from a join b using (frame)""",
    "crop_source_join": f"""with {_DEALT} select coalesce(split, 'train') split, count(*) n_crops from (select distinct crop_id, source_group from person_crops) left join dealt using (source_group) group by 1""",
    "near_dup_group_report": f"""with recursive {_MEMBERS}, o as (select group_id, review_status, row_number() over (order by coalesce(path, ''), group_id) i from st)
select printf('PUBLIC_DUP_%04d', i) group_name, review_status, image_id, coalesce(path, '') path, coalesce(split, '') split, coalesce(stem, '') stem from mem join o using (group_id)""",
    "near_dup_group_pairs": f"""with recursive {_MEMBERS}, f as (select h, group_id, min(image_id) i from mem group by 1, 2)
select a.group_id, least(a.i, b.i) image_a, greatest(a.i, b.i) image_b, cast(bit_count(xor(a.h, b.h)) as int) distance from f a join f b on a.h < b.h and bit_count(xor(a.h, b.h)) <= 3""",
    "near_dup_summary": f"""with recursive {_MEMBERS},
p as (select count(*) filter (where coalesce(x.split, '') = coalesce(y.split, '')) n_within, count(*) filter (where coalesce(x.split, '') <> coalesce(y.split, '')) n_across from e join mem x on x.image_id = e.a join mem y on y.image_id = e.b where e.a < e.b)
select (select count(*) from pi) n_images, n_within, n_across, (select count(*) from st) n_groups, (select count(*) from st where n_splits > 1) n_cross_split_groups, (select count(*) from mem) n_images_involved from p""",
    "image_group_lookup": f"""with recursive {_MEMBERS}
select pi.image_id, coalesce(source, 'site') source, coalesce(case when source is not null then st.group_id end, -1) group_id, coalesce(case when source is not null then review_status end, 'none') review_status
from pi left join grouped g using (image_id) left join st using (group_id)""",
    "select_round_robin_diverse": f"""with recursive {_CROPS},
r as (select crop_id, crop_id * 7919 % 997 * 918273645546372 + crop_id % 4 h, source_group g, row_number() over (partition by source_group order by confidence desc, coalesce(crop_filename, ''), crop_id) t from crops where source_group is not null and confidence is not null),
o as (select crop_id, h, row_number() over (order by t, g, crop_id) i from r),
go(i, held, n, crop_id, h, ok) as (
  select 0::bigint, []::bigint[], 0, null::bigint, null::bigint, false
  union all select o.i, case when f then list_append(held, o.h) else held end, n + f::int, o.crop_id, o.h, f
  from (select go.i, held, n, o.i oi, len(list_filter(held, lambda x: bit_count(xor(x, o.h)) <= 3)) = 0 f from go join o on o.i = go.i + 1 where n < 100) q join o on o.i = q.oi)
select crop_id, h, n accepted from go where ok""",
    "crop_frame_join": """with c as (select crop_filename, min(source_image) source_image, min(crop_id) crop_id from person_crops where crop_filename is not null group by 1),
f as (select source_image, min(camera_id) frame_camera, min(source_clip) frame_clip from person_crops where source_image is not null group by 1),
w as (select record_id, min(crop_filename) n from validation_records where record_id is not null and crop_filename is not null group by 1 union all select -crop_id, min(crop_filename) from person_crops where crop_id % 7 = 0 and crop_filename is not null group by 1)
select record_id, crop_id, coalesce(c.source_image, '') source_image, coalesce(frame_camera, '') frame_camera, coalesce(frame_clip, '') frame_clip from w join c on w.n = c.crop_filename left join f on f.source_image = c.source_image""",
    "selection_reference_check": """with c as (select crop_filename, min(source_image) source_image, min(crop_id) crop_id from person_crops where crop_filename is not null group by 1),
f as (select source_image, min(camera_id) frame_camera, min(source_clip) frame_clip from person_crops where source_image is not null group by 1),
w as (select record_id, min(crop_filename) n from validation_records where record_id is not null and crop_filename is not null group by 1 union all select -crop_id, min(crop_filename) from person_crops where crop_id % 7 = 0 and crop_filename is not null group by 1)
select case when crop_id is null then 'crop' when frame_camera is null and frame_clip is null then 'frame' else 'none' end absent, count(*) n from w left join c on w.n = c.crop_filename left join f on f.source_image = c.source_image group by 1""",
    "selection_validation": """with v as (select distinct record_id, selection_round, crop_filename, review_priority from validation_records where record_id is not null and selection_round is not null),
a as (select selection_round, count(*) n, count(crop_filename) - count(distinct crop_filename) n_twice, count(*) filter (where review_priority is null) n_without_priority,
  count(*) filter (where crop_filename in (select crop_filename from v where selection_round = 1 and crop_filename is not null)) n_of_first_round from v where selection_round > 1 group by 1)
select *, case when n_twice > 0 then 'duplicate crop names' when n_without_priority > 0 then 'unsupported review priority' when n_of_first_round > 0 then 'overlaps the first round' else 'valid' end verdict from a""",
    "listing_sorts": """select dataset_identity, relative_path, cast(row_number() over (partition by dataset_identity order by relative_path) as int) n from (select distinct dataset_identity, relative_path from public_images where relative_path is not null and dataset_identity is not null)
qualify row_number() over (partition by dataset_identity order by relative_path) <= 20""",
    "video_integrity": """with f as (select l_orderkey video, l_linenumber frame, max(l_linenumber) over (partition by l_orderkey) declared from lineitem)
select video, cast(max(declared) as bigint) declared, count(*) decoded, count(*) = max(declared) entire, count(*) / 12.5::double duration_seconds from f where not (video % 13 = 4 and frame = 2) group by 1""",
}
