"""Manifests, label files, logs and status documents as DataFrames; schemas are always given, never inferred."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.records import path_context
from vigil.session import exists

SPLIT_MANIFEST = "source_image string, camera_id string, source_clip string, source_timestamp_seconds double, source_group string, split string"
FRAME_MANIFEST = "source_image string, camera_id string, source_clip string, source_timestamp_seconds double, frame_width int, frame_height int, source_group string"
CROP_MANIFEST = "crop_filename string, source_image string, camera_id string, source_clip string, source_group string, split string, person_detection_confidence double, " + ", ".join(
    f"{c} int" for c in ("person_box_x1", "person_box_y1", "person_box_x2", "person_box_y2", "person_width_px", "person_height_px", "crop_x1", "crop_y1", "crop_x2", "crop_y2", "crop_width_px", "crop_height_px")
)
AUDIT = "event_id string, camera_id string, session_id string, module_id string, action string, details string, audit_timestamp_utc string"
STATUS = (
    "schema_version string, camera_id string, session_id string, state string, updated_at_utc string, decoded_width int, decoded_height int, source_fps double, frames_received long, "
    "frames_processed long, frames_dropped long, failed_reads long, reconnect_count long, processing_fps double, temporary_track_count int, zones_enabled boolean"
)
EVENT = (
    "event_id string, camera_id string, session_id string, module_id string, event_type string, track_id long, source_timestamp_seconds double, frame_number long, schema_version string, "
    "severity string, status string, zone_id string, zone_name string, detection_confidence double, stationary_duration_seconds double, zone_occupancy int, created_at_utc string, "
    "source_video string, processed_at_utc string, evidence struct<raw_snapshot:string,annotated_snapshot:string,video_clip:string,requested_pre_seconds:double,requested_post_seconds:double,"
    "actual_clip_start_seconds:double,actual_clip_end_seconds:double,actual_pre_seconds:double,actual_post_seconds:double,clip_frame_count:int,resolution:array<int>>"
)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV manifest with a header."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_manifest(df: DataFrame, path: str, schema: str) -> None:
    """A new CSV manifest with the columns of ``schema`` in its order; an existing one is never overwritten."""
    columns = [c.split()[0] for c in schema.split(", ")]
    if "split" in columns:
        df = df.withColumn("split", F.coalesce("split", F.lit("train")))
    df.select(*columns).write.mode("errorifexists").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of label text files: blank lines dropped, the others numbered from 1 after that."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("file"), "value")
    lines = F.filter(F.split("value", r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    return whole.select("file", F.posexplode(lines).alias("i", "line")).select("file", (F.col("i") + 1).alias("line_no"), F.trim("line").alias("line"))


def read_audit_log(spark: SparkSession, root: str) -> DataFrame:
    """All audit.jsonl below ``root``: malformed lines skipped, camera and session from the path where a record lacks them."""
    lines = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter="audit.jsonl").select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    parsed = lines.withColumn("v", F.try_parse_json("value")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    below = F.regexp_replace(F.regexp_replace("file", "^file:/+", "/"), "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    camera, session = path_context(below)
    field = lambda n: F.try_variant_get("v", f"$.{n}", "string")
    return parsed.select(
        field("event_id").alias("event_id"), F.coalesce(field("camera_id"), camera).alias("camera_id"), F.coalesce(field("session_id"), session).alias("session_id"), field("module_id").alias("module_id"),
        F.coalesce(field("action"), F.lit("UNKNOWN")).alias("action"), F.coalesce(F.get_json_object("value", "$.details"), F.lit("{}")).alias("details"), field("audit_timestamp_utc").alias("audit_timestamp_utc"), "file",
    )


def read_audit_log_strict(spark: SparkSession, path: str) -> DataFrame:
    """One audit log; a malformed line is an error that names the file and the line's number.

    Lines are numbered only in the files that hold a malformed one, to say where.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    bad = lines.where(F.try_parse_json("value").isNull()).select(F.col("_metadata.file_path").alias("file")).limit(1).collect()
    if bad:
        whole = spark.read.text(bad[0].file, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("i", "line"))
        first = whole.where("trim(line) <> ''").where(F.try_parse_json("line").isNull()).agg(F.min("i").alias("i")).first()
        raise ValueError(f"{bad[0].file}:{first.i + 1}: not a JSON record")
    return spark.read.schema(AUDIT).option("mode", "FAILFAST").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """What ``append_audit`` wrote, malformed lines left out."""
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", AUDIT).alias("r")).select("r.*")


def append_audit(df: DataFrame, path: str) -> None:
    """Append entries as JSON lines."""
    df.select(*[c.split()[0] for c in AUDIT.split(", ")]).write.mode("append").json(path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Runtime status documents; unreadable ones are skipped."""
    rows = spark.read.schema(STATUS + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
    return rows.where("_bad is null and updated_at_utc is not null").drop("_bad")


def read_event_metadata(spark: SparkSession, root: str) -> DataFrame:
    """All metadata.json below ``root``; documents without event id and corrupt ones are skipped."""
    reader = spark.read.schema(EVENT + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True)
    rows = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(root)
    return rows.where("_bad is null and event_id is not null").drop("_bad")


def mentions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """CSV and JSON files whose text contains ``name``."""
    whole = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{csv,json}")
    return whole.where(F.contains("value", F.lit(name))).select(F.col("_metadata.file_path").alias("file"))


IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below ``root``, relative to it; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return found.select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("path"))


def images(listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows of a listing whose path has the suffix of an image in any letter case, each path once."""
    return listing.where(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)).dropDuplicates([path])


def layout(path: Column) -> tuple[Column, Column]:
    """(split, label path) of an image path below a dataset's root, in any of three layouts; both null for other paths.

    images/SPLIT/name with labels/SPLIT beside it, SPLIT/images/name with SPLIT/labels, or SPLIT/name with labels in the same folder.
    """
    forms = [(r"^images/([^/]+)/([^/]+)\.[^./]+$", "labels/$1/$2.txt"), (r"^([^/]+)/images/([^/]+)\.[^./]+$", "$1/labels/$2.txt"), (r"^([^/]+)/([^/]+)\.[^./]+$", "$1/$2.txt")]
    split = label = F.lit(None).cast("string")
    for pattern, made in reversed(forms):
        fits = path.rlike(pattern)
        split, label = F.when(fits, F.regexp_extract(path, pattern, 1)).otherwise(split), F.when(fits, F.regexp_replace(path, pattern, made)).otherwise(label)
    return F.when(F.lower(split).isin("valid", "validation"), "val").otherwise(F.lower(split)), label


def parsed_options(text: Column) -> Column:
    """A map of options given as key=value, separated by commas, or as a JSON object, whose quotes may be escaped once more."""
    pairs = F.str_to_map(text, F.lit(","), F.lit("="))
    return F.when(text.contains("=") & ~F.startswith(F.ltrim(text), F.lit("{")), pairs).otherwise(F.from_json(F.replace(text, F.lit('\\"'), F.lit('"')), "map<string,string>"))


def replace_folder(spark: SparkSession, written: str, path: str) -> None:
    """Put a written folder in place of ``path``, so that readers see either the old or the new one, or for a moment none, but never half."""
    jvm = spark._jvm.org.apache.hadoop.fs
    source, target = jvm.Path(written), jvm.Path(path)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{written} could not take the place of {path}")


def write_status(df: DataFrame, path: str) -> None:
    """The newest status document of each camera, one JSON object a line; what was there is replaced in one step."""
    names = [c.split()[0] for c in STATUS.split(", ")]
    newest = df.groupBy("camera_id").agg(F.max_by(F.struct(*names), F.struct("updated_at_utc", "frames_received", "session_id")).alias("r")).select("r.*")
    made = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    newest.select(*names[:7], F.col("source_fps"), *names[8:13], F.round("processing_fps", 3).alias("processing_fps"), *names[14:]).write.json(made)
    replace_folder(df.sparkSession, made, path)


def read_status_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_status`` wrote."""
    return spark.read.schema(STATUS).json(path)


SAVED, REFUSED = "EVIDENCE_SAVED", "EVIDENCE_ERROR"
RECORDED_TOKEN = "cam_good_test"  # fixed value: marks cameras whose frames are recorded ones


def write_packages(events: DataFrame, root: str) -> DataFrame:
    """Append evidence packages of events whose package isn't there yet; (event_id, camera_id, session_id, module_id, action, details)
    of the audit rows, which are appended to the log below ``root`` too.

    Packages are metadata documents, one a line; media are none of this engine's business.  An event given twice, or one that has
    a package, is refused and told in the audit; nothing is ever overwritten.
    """
    spark = events.sparkSession
    keys = ["camera_id", "session_id", "event_id"]
    known = [c.split()[0] for c in EVENT.split(", ") if not c.startswith("evidence ")]
    columns = [c for c in known if c in events.columns]
    schema = ", ".join(f"{k} string" for k in keys)
    old = spark.read.schema(schema).json(f"{root}/packages").distinct() if exists(spark, f"{root}/packages") else spark.createDataFrame([], schema)
    numbered = events.where("event_id is not null").groupBy(*keys).agg(F.min(F.struct(*[c for c in columns if c not in keys])).alias("r"), F.count(F.lit(1)).alias("_n"))
    rows = numbered.join(old.withColumn("_old", F.lit(True)), keys, "left").select(*keys, "r.*", "_n", F.coalesce("_old", F.lit(False)).alias("_old"))
    run = uuid.uuid4().hex
    rows.write.parquet(f"{root}/runs/{run}")  # what is fresh must not change once packages are written
    rows = spark.read.parquet(f"{root}/runs/{run}")
    evidence = F.struct(F.lit("snapshot_raw.jpg").alias("raw_snapshot"), F.lit("snapshot_annotated.jpg").alias("annotated_snapshot"), F.lit("event_clip.mp4").alias("video_clip"))
    rows.where("not _old").drop("_n", "_old").withColumn("evidence", evidence).write.mode("append").json(f"{root}/packages")
    refused = F.col("_n") - F.when(F.col("_old"), 0).otherwise(1)
    audit = rows.select(*keys, "module_id", F.explode(F.concat(
        F.when(F.col("_old"), F.array().cast("array<string>")).otherwise(F.array(F.lit(SAVED))), F.array_repeat(F.lit(REFUSED), refused.cast("int")),
    )).alias("action"))
    why = F.when(F.col("action") == SAVED, F.to_json(F.struct(package_dir().alias("event_dir")))).otherwise(F.to_json(F.struct(F.lit("DUPLICATE_EVENT_DIRECTORY").alias("error"), package_dir().alias("path"))))
    audit = audit.withColumn("details", why).withColumn("audit_timestamp_utc", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    append_audit(audit, f"{root}/audit")
    return audit.drop("audit_timestamp_utc")


def package_dir() -> Column:
    return F.concat_ws("/", "camera_id", "session_id", F.concat(F.lit("event_"), "event_id"))


def read_packages(spark: SparkSession, root: str) -> DataFrame:
    """Packages with the paths their documents imply and whether they come from recorded video."""
    rows = spark.read.schema(EVENT + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{root}/packages").where("_bad is null and event_id is not null").drop("_bad")
    video = F.coalesce(F.col("source_video"), F.lit(""))
    name = lambda field, default: F.concat_ws("/", package_dir(), F.coalesce(F.col(f"evidence.{field}"), F.lit(default)))
    return rows.select(
        *[c for c in rows.columns if c != "evidence"], package_dir().alias("event_dir"), name("raw_snapshot", "snapshot_raw.jpg").alias("raw_snapshot_path"), name("annotated_snapshot", "snapshot_annotated.jpg").alias("annotated_snapshot_path"),
        name("video_clip", "event_clip.mp4").alias("clip_path"), ((video != "") | F.coalesce(F.contains("camera_id", F.lit(RECORDED_TOKEN)), F.lit(False))).alias("is_recorded_prototype"),
    )


GROUPS = "schema_version string, groups array<struct<group_id:string,review_status:string,members:array<struct<path:string>>>>"
PIECES = 64


def write_group_manifest(members: DataFrame, path: str) -> None:
    """A manifest of groups from (group_id, review_status, path): documents with an array of groups and their members.

    A group's members are spread over PIECES entries by their path, so that no array holds a whole group of any size.  An
    existing manifest is never overwritten.
    """
    piece = F.pmod(F.xxhash64("path"), F.lit(PIECES))
    entries = members.groupBy("group_id", "review_status", piece.alias("_p")).agg(F.collect_list(F.struct("path")).alias("members"))
    document = F.struct(F.lit("1.0").alias("schema_version"), F.array(F.struct("group_id", "review_status", "members")).alias("groups"))
    entries.select(F.to_json(document).alias("value")).write.mode("errorifexists").text(path)


def read_group_manifest(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(path, group_id, review_status) of a manifest's members; ``multi_line`` for one indented document a file."""
    groups = spark.read.schema(GROUPS).option("multiLine", multi_line).json(path).select(F.explode("groups").alias("g"))
    return groups.select(F.explode("g.members.path").alias("path"), "g.group_id", "g.review_status")


def pool_manifest(sources: DataFrame, prefix: Column, path: str = "path") -> DataFrame:
    """(source, destination_image, destination_label, n_same) of a pool made by copying: names get the source's prefix, and ``n_same`` counts
    the sources that one destination would have."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    rows = sources.select(F.col(path).alias("source"), F.concat(F.lit("images/"), prefix, name).alias("destination_image"), F.concat(F.lit("labels/"), prefix, F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(".txt")).alias("destination_label"))
    same = rows.groupBy("destination_image").agg(F.count(F.lit(1)).alias("n_same"))
    return rows.join(same, "destination_image").select("source", "destination_image", "destination_label", "n_same")


def write_pool_manifest(manifest: DataFrame, path: str) -> None:
    """The rows to copy; an error if destinations collide or the pool exists already."""
    twice = manifest.where("n_same > 1").select("destination_image").limit(5).collect()
    if twice:
        raise ValueError(f"destinations collide: {json.dumps(sorted(r[0] for r in twice))}")
    manifest.drop("n_same").write.mode("errorifexists").json(path)
