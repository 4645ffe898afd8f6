"""Queries through the file sources and sinks, the reader's life, and clocks, with the SQL they are checked against.

A round trip writes driver tables by a sink into the scratch folder and returns what the matching source reads there.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.text import split_name
from vigil.operators import adapters as A
from vigil.operators import records as R
from vigil.operators.datasets import judged
from vigil.session import Scratch, scratch_root, table
from vigil.sources import config as C
from vigil.sources import files as S

DURATION, FIRST_FRAME = 5_000_000.0, 600.0  # seconds of the events' slow time
FPS = 12.5
CONTROLS = {"BAR-001": (True, "Restricted zone"), "IDT-004": (True, "Occupancy"), "EXC-002": (False, "Lone person"), "ERG-006": (True, "Low movement")}


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def _config_folder(spark: SparkSession) -> str:
    """A folder for small configuration files, which the driver alone writes and reads."""
    path = _folder(spark).removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def _round_trip(spark: SparkSession, rows: DataFrame, schema: str) -> DataFrame:
    path = f"{_folder(spark)}/manifest"
    S.write_manifest(rows, path, schema)
    return S.read_manifest(spark, path, schema)


def _crops(spark: SparkSession, folder: str) -> DataFrame:
    # a CSV file can't tell a blank text from none
    return table(spark, folder, "person_crops").where("trim(coalesce(source_group, 'x')) <> '' and trim(coalesce(source_clip, 'x')) <> '' and trim(coalesce(split, 'x')) <> ''").distinct()


def crop_manifest_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Crops through a CSV manifest; a missing split is train."""
    rows = _round_trip(spark, _crops(spark, folder), S.CROP_MANIFEST)
    return rows.select("crop_filename", "source_image", F.coalesce("source_group", F.lit("-")).alias("source_group"), "split", F.coalesce("crop_height_px", F.lit(-1)).alias("crop_height_px"))


def split_manifest_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The split of each source image and group through a CSV manifest."""
    rows = _crops(spark, folder).withColumn("source_timestamp_seconds", (F.col("crop_id") % 100) / 4)
    return _round_trip(spark, rows, S.SPLIT_MANIFEST).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("source_timestamp_seconds").alias("seconds"))


def frame_manifest_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Frames through a CSV manifest."""
    rows = _crops(spark, folder).groupBy("source_image").agg(*[F.min(c).alias(c) for c in ("camera_id", "source_clip", "source_group")])
    rows = rows.select("*", F.lit(2.5).alias("source_timestamp_seconds"), F.lit(1280).alias("frame_width"), F.lit(720).alias("frame_height"))
    back = _round_trip(spark, rows, S.FRAME_MANIFEST)
    return back.select("source_image", F.coalesce("camera_id", F.lit("-")).alias("camera_id"), F.coalesce("source_clip", F.lit("-")).alias("source_clip"), (F.col("frame_width") * F.col("frame_height")).alias("pixels"))


def label_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Valid and broken lines of label files, one folder of files a split."""
    from vigil.plans.datasets import _lines

    path = f"{_folder(spark)}/labels"
    lines = _lines(spark, folder)
    lines.select("split", F.concat(F.lit("  "), "line").alias("value")).write.partitionBy("split").text(path)
    back = S.read_labels(spark, path).withColumn("split", F.regexp_extract("file", r"split=([^/]+)/", 1))
    return judged(back.select("split", "line")).groupBy("split").agg(F.count(F.lit(1)).alias("n_lines"), F.count("error").alias("n_broken"))


def dataset_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Split and label path of each image, by the layout of its path."""
    split, label = S.layout(F.col("relative_path"))
    return table(spark, folder, "public_images").where("relative_path is not null").select("relative_path", split.alias("split"), label.alias("label_path")).distinct()


def image_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a listing by folder; other files are left out, repeated paths count once."""
    paths = table(spark, folder, "public_images").select(F.col("relative_path").alias("path"))
    paths = paths.unionByName(table(spark, folder, "evidence_artifacts").select(F.explode(F.array("raw_snapshot_path", "clip_path", "metadata_path")).alias("path"))).unionByName(paths.select(F.upper("path").alias("path")))
    return S.images(paths.where("path is not null")).groupBy(F.regexp_extract("path", r"^([^/]*)/", 1).alias("top")).agg(F.count(F.lit(1)).alias("n_images"))


def _states(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "safety_events").where("event_id is not null and camera_id is not null and session_id is not null")
    last = R.newest(rows, ["event_id"], [F.desc_nulls_last("ingested_at"), F.asc("status")])
    return last.withColumn("source_video", F.when(F.col("track_id") % 3 == 0, F.concat("camera_id", F.lit(".mp4")))).withColumn("camera_id", F.when(F.col("track_id") % 5 == 1, F.concat(F.lit("cam_good_test_"), "camera_id")).otherwise(F.col("camera_id")))


def evidence_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Packages of some events, then of all: those that exist are refused and told; scanned with their derived paths."""
    root, events = _folder(spark), Scratch(spark).save(_states(spark, folder))
    S.write_packages(events.where("track_id % 2 = 0"), root)
    S.write_packages(events, root)
    told = S.read_audit(spark, f"{root}/audit").groupBy("event_id").agg(F.count_if(F.col("action") == S.SAVED).alias("n_saved"), F.count_if(F.col("action") == S.REFUSED).alias("n_refused"))
    return S.read_packages(spark, root).select("event_id", "event_dir", "clip_path", "is_recorded_prototype").join(told, "event_id", "left")


def status_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The newest status of each camera as written in place of an older one."""
    rows = table(spark, folder, "runtime_status").where("camera_id is not null and updated_at_utc is not null")
    path = f"{_folder(spark)}/status"
    S.write_status(rows.where("state = 'starting'"), path)
    S.write_status(rows, path)
    return S.read_status_lines(spark, path).select("camera_id", "updated_at_utc", F.coalesce("frames_received", F.lit(-1)).alias("frames_received"))


def group_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and their members through a manifest of nested documents."""
    rows = table(spark, folder, "public_images").where("relative_path is not null and original_stem is not null").select(F.col("original_stem").alias("group_id"), F.lit("REVIEW_REQUIRED").alias("review_status"), F.col("relative_path").alias("path")).distinct()
    path = f"{_folder(spark)}/groups"
    S.write_group_manifest(rows, path)
    return S.read_group_manifest(spark, path)


def pool_destinations(spark: SparkSession, folder: str) -> DataFrame:
    """Where each image of a pool would be copied to, and how many sources share that place."""
    rows = table(spark, folder, "public_images").where("relative_path is not null").select(F.col("relative_path").alias("path"), "dataset_identity").distinct()
    return S.pool_manifest(rows, F.when(F.col("dataset_identity").isNotNull(), "public__").otherwise("site__"))


def option_parse(spark: SparkSession, folder: str) -> DataFrame:
    """options given as key=value or as JSON."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    pairs = F.format_string("nation=%d,region=%d", n, r)
    document = F.format_string('{"nation": "%d", "region": "%d"}', n, r)
    text = F.when(n % 3 == 0, document).when(n % 3 == 1, F.replace(document, F.lit('"'), F.lit('\\"'))).otherwise(pairs)
    m = S.parsed_options(text)
    return table(spark, folder, "nation").select("n_nationkey", m["nation"].cast("int").alias("nation"), m["region"].cast("int").alias("region"))


def controls_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Controls saved and loaded over their defaults; of known entries only ``enabled`` may change."""
    defaults = {k: {"enabled": e, "label": t, "description": ""} for k, (e, t) in CONTROLS.items()}
    path = f"{_config_folder(spark)}/controls.yaml"
    C.save_controls(path, {"EXC-002": {"enabled": True, "label": "renamed"}, "BAR-001": {"enabled": False}, "unknown": {"enabled": True}}, defaults)
    return spark.createDataFrame([(k, v["enabled"], v["label"]) for k, v in C.load_controls(path, defaults).items()], "control_id string, enabled boolean, label string")


def zone_config_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Zones put into a configuration file one by one, read back with their violations."""
    path = f"{_config_folder(spark)}/zones.yaml"
    for i, n, t, e, p, _ in A.ZONES:
        for enabled in (False, e):  # the second takes the place of the first
            C.upsert_zone(path, "cam_0", (1280, 720), {"zone_id": i, "zone_name": n, "zone_type": t, "enabled": enabled, "polygon": [list(q) for q in p]})
    zones = C.read_zones(spark, path)
    bad = C.zone_violations(zones).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))
    return zones.join(bad, "zone_id", "left").select("camera_id", "zone_id", "zone_name", "zone_type", "enabled", F.size("polygon").alias("n_points"), F.coalesce("n", F.lit(0)).alias("n_violations"))


def rule_config_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds of the enabled temporal rules for their zones, in the zones' order."""
    path = f"{_config_folder(spark)}/rules.yaml"
    C.write_atomically(path, {"temporal_rules": {
        "EXC-002": {"enabled": True, "applicable_zone_ids": ["B", "A"], "confirmation_seconds": 3.0, "reset_seconds": 1},
        "ERG-006": {"enabled": False, "applicable_zone_ids": ["A"], "no_movement_seconds": 600},
    }})
    return C.read_rules(spark, path, {"A", "B", "C"})


def camera_config_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Cameras of a configuration file; for each whether a strict read takes it, else why not."""
    path = f"{_config_folder(spark)}/cameras.yaml"
    good = {"source_type": "rtsp", "rtsp_env_var": "CAMERA_SECRET", "enabled": True}
    C.write_atomically(path, {"cameras": {
        "a": good | {"camera_id": "a"}, "b": good | {"camera_id": "x"}, "c": good | {"camera_id": "c", "source_type": "file"}, "d": good | {"camera_id": "d", "rtsp_env_var": "OTHER"}, "e": good | {"camera_id": "e", "enabled": False},
    }})
    rows = []
    for camera in "abcdef":
        try:
            rows.append((camera, C.read_camera_strict(path, camera, ("CAMERA_SECRET",))["rtsp_env_var"]))
        except ValueError as e:
            rows.append((camera, str(e)))
    strict = spark.createDataFrame(rows, "camera_id string, strict string")
    return strict.join(C.read_cameras(spark, path).select("camera_id", F.col("enabled").alias("lenient_enabled")), "camera_id", "left").select("camera_id", "strict", F.coalesce("lenient_enabled", F.lit(False)).alias("lenient_enabled"))


def mention_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of manifests that mention a name."""
    path = f"{_folder(spark)}/reports"
    table(spark, folder, "public_images").where("relative_path is not null and dataset_identity is not null").select("dataset_identity", "relative_path").distinct().write.partitionBy("dataset_identity").csv(path)
    return S.mentions(spark, path, "vest_y_").select(F.regexp_extract("file", r"dataset_identity=([^/]+)/", 1).alias("dataset")).distinct()


def audit_log_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Entries appended to a log and read strictly and leniently; both see them all."""
    root = _folder(spark)
    rows = table(spark, folder, "audit_log").where("action is not null")
    for part in (0, 1):
        S.append_audit(rows.where(F.col("audit_id") % 2 == part), f"{root}/audit.jsonl")
    strict = S.read_audit_log_strict(spark, f"{root}/audit.jsonl").groupBy("action").agg(F.count(F.lit(1)).alias("n_strict"), F.count("event_id").alias("n_with_event"))
    lenient = S.read_audit(spark, f"{root}/audit.jsonl").groupBy("action").agg(F.count(F.lit(1)).alias("n_lenient"))
    return strict.join(lenient, "action")


def reader_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Failures, waits with bounded backoff, and the end of readers that fail five times in a row; errors are the failures."""
    rows = A.event_frames(spark, folder).select(F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("reader"), "event_id", "event_type")
    return R.lifecycle(rows, "reader", "event_id", F.col("event_type") == "error", Scratch(spark)).withColumn("terminal_at", F.coalesce("terminal_at", F.lit(-1)))


def reader_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """T5: counters of each reader at its last row."""
    rows = A.event_frames(spark, folder).select("camera_id", "event_id", "event_type", A.micros("ts").alias("t"))
    return R.snapshot(rows, "camera_id", "event_id", "t", F.col("event_type") == "error")


def finite_run(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of a run of limited duration per track, and why it stopped."""
    rows = A.event_frames(spark, folder).where("user_id is not null and ts is not null").select("user_id", "event_type", A.micros("ts").alias("t"))
    return R.finite_run(rows, "user_id", "t", F.col("event_type") == "error", DURATION, FIRST_FRAME * 100)


def event_clock(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds of a frame: of recorded cameras its number by the frame rate, of live ones the time since their first frame."""
    rows = A.event_frames(spark, folder).select("event_id", "camera_id", A.micros("ts").alias("t"))
    first = F.broadcast(rows.groupBy("camera_id").agg(F.min("t").alias("a"), F.min("event_id").alias("e")))  # one row a camera of the site
    recorded = F.col("camera_id").isin("cam_0", "cam_1")
    return rows.join(first, "camera_id").select("event_id", F.when(recorded, (F.col("event_id") - F.col("e")) / FPS).otherwise((F.col("t") - F.col("a")) / 1e6).alias("timestamp_seconds"))


def splits_of_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images whose folder and written split differ."""
    split, _ = S.layout(F.col("relative_path"))
    rows = table(spark, folder, "public_images").where("relative_path is not null").select("image_id", split.alias("folder_split"), split_name(F.col("split")).alias("written")).distinct()
    return rows.where("written is not null").groupBy("folder_split", "written").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        crop_manifest_scan, split_manifest_scan, frame_manifest_scan, label_file_scan, dataset_layout, image_listing, evidence_packages, status_documents, group_manifest, pool_destinations, option_parse,
        controls_round_trip, zone_config_scan, rule_config_scan, camera_config_scan, mention_scan, audit_log_scans, reader_lifecycle, reader_snapshot, finite_run, event_clock, splits_of_images,
    )
}

from vigil.plans.datasets import _SPLIT, _VERDICT  # noqa: E402

_C = "c as (select distinct * from person_crops where trim(coalesce(source_group, 'x')) <> '' and trim(coalesce(source_clip, 'x')) <> '' and trim(coalesce(split, 'x')) <> '')"
_FAIL = """ev as (select concat('u_', user_id) reader, event_id, event_type = 'error' f from events),
g as (select *, sum((not f)::int) over (partition by reader order by event_id) seg from ev),
k as (select *, row_number() over (partition by reader, seg order by event_id) i from g where f),
t as (select reader, min(event_id) terminal_at from k where i = 5 group by 1)"""
_LAYOUT = "case when split_part(relative_path, '/', 1) = 'valid' then 'val' else split_part(relative_path, '/', 1) end"

SQL = {
    "crop_manifest_scan": f"with {_C} select crop_filename, source_image, coalesce(source_group, '-') source_group, coalesce(split, 'train') split, coalesce(crop_height_px, -1) crop_height_px from c",
    "split_manifest_scan": f"with {_C} select coalesce(split, 'train') split, count(*) n, sum(crop_id % 100 / 4::double) \"seconds\" from c group by 1",
    "frame_manifest_scan": f"with {_C} select source_image, coalesce(min(camera_id), '-') camera_id, coalesce(min(source_clip), '-') source_clip, 1280 * 720 pixels from c group by 1",
    "label_file_scan": f"with {_VERDICT} select split, count(*) n_lines, count(*) filter (where verdict <> 'valid') n_broken from judged group by 1",
    "dataset_layout": f"select distinct relative_path, {_LAYOUT} split, concat(split_part(relative_path, '/', 1), '/labels/', regexp_replace(split_part(relative_path, '/', 3), '\\.[^./]+$', '.txt')) label_path from public_images where relative_path is not null",
    "image_listing": """with p as (select relative_path path from public_images union select upper(relative_path) from public_images union select raw_snapshot_path from evidence_artifacts union select clip_path from evidence_artifacts union select metadata_path from evidence_artifacts)
select regexp_extract(path, '^([^/]*)/', 1) top, count(*) n_images from p where path is not null and regexp_matches(lower(path), '\\.(jpg|jpeg|png|bmp|webp)$') group by 1""",
    "evidence_packages": """with s as (select * from safety_events where event_id is not null and camera_id is not null and session_id is not null qualify row_number() over (partition by event_id order by ingested_at desc nulls last, status) = 1),
c as (select event_id, session_id, track_id, case when track_id % 5 = 1 then 'cam_good_test_' || camera_id else camera_id end camera_id from s),
d as (select *, concat(camera_id, '/', session_id, '/event_', event_id) event_dir from c)
select event_id, event_dir, event_dir || '/event_clip.mp4' clip_path, coalesce(track_id % 3 = 0, false) or contains(camera_id, 'cam_good_test') is_recorded_prototype, 1::bigint n_saved, coalesce((track_id % 2 = 0)::bigint, 0) n_refused from d""",
    "status_documents": """select camera_id, updated_at_utc, coalesce(frames_received, -1) frames_received from runtime_status where camera_id is not null and updated_at_utc is not null
qualify row_number() over (partition by camera_id order by updated_at_utc desc, frames_received desc nulls last, session_id desc nulls last) = 1""",
    "group_manifest": "select distinct relative_path path, original_stem group_id, 'REVIEW_REQUIRED' review_status from public_images where relative_path is not null and original_stem is not null",
    "pool_destinations": """with p as (select distinct relative_path, case when dataset_identity is not null then 'public__' else 'site__' end prefix from public_images where relative_path is not null),
d as (select relative_path source, concat('images/', prefix, split_part(relative_path, '/', -1)) destination_image, concat('labels/', prefix, regexp_replace(split_part(relative_path, '/', -1), '\\.[^.]*$', ''), '.txt') destination_label from p)
select *, count(*) over (partition by destination_image) n_same from d""",
    "option_parse": "select n_nationkey, cast(n_nationkey as int) nation, cast(n_regionkey as int) region from nation",
    "controls_round_trip": "select * from (values ('BAR-001', false, 'Restricted zone'), ('IDT-004', true, 'Occupancy'), ('EXC-002', true, 'Lone person'), ('ERG-006', true, 'Low movement')) t(control_id, enabled, label)",
    "zone_config_scan": "select * from (values ('cam_0', 'A', 'loading bay', 'restricted', true, 4, 0::bigint), ('cam_0', 'B', 'walkway', 'counting', true, 4, 0), ('cam_0', 'C', 'press area', 'restricted', true, 4, 0), ('cam_0', 'D', 'closed gate', 'restricted', false, 4, 0)) t(camera_id, zone_id, zone_name, zone_type, enabled, n_points, n_violations)",
    "rule_config_scan": "select 'EXC-002' module_id, zone_id, zone_ordinal, name, \"value\" from (values ('B', 0), ('A', 1)) z(zone_id, zone_ordinal), (values ('confirmation_seconds', 3.0::double), ('reset_seconds', 1.0)) v(name, \"value\")",
    "camera_config_scan": """select * from (values ('a', 'CAMERA_SECRET', true), ('b', 'camera_id does not match its key', true), ('c', 'camera c source_type must be rtsp', true), ('d', 'camera d must use an approved variable', true),
  ('e', 'camera e is disabled', false), ('f', 'camera f must be a mapping', false)) t(camera_id, strict, lenient_enabled)""",
    "mention_scan": "select distinct dataset_identity dataset from public_images where dataset_identity is not null and contains(relative_path, 'vest_y_')",
    "audit_log_scans": "select action, count(*) n_strict, count(event_id) n_with_event, count(*) n_lenient from audit_log where action is not null group by 1",
    "reader_lifecycle": f"""with {_FAIL}, l as (select k.* , terminal_at from k left join t using (reader) where terminal_at is null or event_id <= terminal_at)
select reader, count(*) n_failures, count(*) filter (where terminal_at is null or event_id < terminal_at) n_waits,
  coalesce(sum([1.0::double, 2.0, 4.0, 8.0, 10.0][least(i, 5)]) filter (where terminal_at is null or event_id < terminal_at), 0) seconds_waited, coalesce(min(terminal_at), -1) terminal_at from l group by 1""",
    "reader_snapshot": """with ev as (select concat('cam_', user_id % 5) camera_id, event_id, event_type = 'error' f, epoch_us(ts) t from events),
l as (select camera_id, max(event_id) filter (where not f) g from ev group by 1)
select camera_id, count(*) filter (where not f) frames_received, count(*) filter (where f) failed_reads, count(*) filter (where f and (g is null or event_id > g)) consecutive_failed_reads,
  (min(t) filter (where not f) - min(t)) / 1e6 time_to_first_frame, (max(t) - min(t)) / 1e6 runtime_seconds from ev join l using (camera_id) group by 1""",
    "finite_run": f"""with ev as (select user_id, event_type = 'error' f, epoch_us(ts) t from events where user_id is not null and ts is not null),
s as (select user_id, min(t) a, max(t) z, min(t) filter (where not f) g from ev group by 1),
n as (select user_id, count(*) n from ev join s using (user_id) where not f and t <= a + {DURATION * 1e6} group by 1)
select user_id, case when g is null or g > a + {FIRST_FRAME * 1e8} then 0 else coalesce(n, 0) end n_frames,
  case when g is null or g > a + {FIRST_FRAME * 1e8} then 'no first frame' when z > a + {DURATION * 1e6} then 'duration' else 'end of source' end stopped from s left join n using (user_id)""",
    "event_clock": """with ev as (select event_id, concat('cam_', user_id % 5) camera_id, epoch_us(ts) t from events), f as (select camera_id, min(t) a, min(event_id) e from ev group by 1)
select event_id, case when camera_id in ('cam_0', 'cam_1') then (event_id - e) / 12.5::double else (t - a) / 1e6 end timestamp_seconds from ev join f using (camera_id)""",
    "splits_of_images": f"""with r as (select distinct image_id, {_LAYOUT} folder_split, {_SPLIT} written from public_images where relative_path is not null)
select folder_split, written, count(*) n from r where written is not null group by 1, 2""",
}
