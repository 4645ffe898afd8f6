"""Queries that run as Structured Streaming jobs over the driver tables, and a few more record queries.

A streaming query reads what a batch job has written to a scratch folder, runs until all of it is processed, and
returns what it wrote.  State is kept per camera and session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.operators import adapters as A
from vigil.plans import rules as P
from vigil.session import scratch_root, table
from vigil.streaming.ingest import conflating_writer
from vigil.streaming.rules import EVENTS, FRAME, Thresholds, Zone, rule_stream

LIMITS = Thresholds(P.EXC_CONFIRM, P.EXC_RESET, P.ERG["no_movement"], P.ERG["ratio"], P.ERG["least_pixels"], P.ERG["ttl"])
ZONES = {f"cam_{c}": tuple(Zone(i, kind == "restricted", tuple(p), A.CONFIRM, A.CONFIRM, A.TTL) for i, _, kind, enabled, p, _ in A.ZONES if enabled) for c in range(5)}


def _rule_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that the rule stream says about the frames of the events table."""
    root = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    seen = A.observations(spark, folder).groupBy("camera_id", "session_id", "frame_number").agg(F.collect_list(F.struct("track_id", "x", "y", "height", "confidence")).alias("tracks"))
    frames = A.frames(spark, folder).join(seen, ["camera_id", "session_id", "frame_number"], "left")
    frames.select("camera_id", "session_id", "frame_number", "timestamp_seconds", "tracks").write.parquet(f"{root}/frames")
    stream = rule_stream(spark.readStream.schema(FRAME).parquet(f"{root}/frames"), ZONES, LIMITS)
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(EVENTS).parquet(f"{root}/out")


def stream_rule_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of all rules from the stateful stream."""
    rows = _rule_rows(spark, folder).where("kind in ('BAR-001', 'EXC-002', 'ERG-006')")
    return rows.select("camera_id", "session_id", F.col("kind").alias("module_id"), "zone_id", "track_id", "frame_number")


def stream_zone_occupancy(spark: SparkSession, folder: str) -> DataFrame:
    """Occupancy of every frame and zone from the stateful stream."""
    return _rule_rows(spark, folder).where("kind = 'IDT-004'").select("camera_id", "session_id", "zone_id", "frame_number", F.col("value").cast("long").alias("occupancy"))


def stream_conflation(spark: SparkSession, folder: str) -> DataFrame:
    """Latest frame per camera and micro-batch; the others are dropped and counted.

    Frames arrive in four lots.  The query stops after each and goes on from its checkpoint with the next, so that a lot is a
    micro-batch.
    """
    root = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    events = A.event_frames(spark, folder).select("camera_id", F.col("event_id").alias("sequence"), "frame_number")
    for lot in range(4):
        events.where(F.col("frame_number") % 4 == lot).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema("camera_id string, sequence long, frame_number long").parquet(f"{root}/in")
        query = source.writeStream.foreachBatch(conflating_writer(f"{root}/out")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("batch", "camera_id", "sequence", "received", "dropped")


def local_track_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks numbered within camera and session by first appearance."""
    first = A.observations(spark, folder).groupBy("camera_id", "session_id", "track_id").agg(F.min("frame_number").alias("first_frame"))
    return first.withColumn("local_id", F.row_number().over(W.partitionBy("camera_id", "session_id").orderBy("first_frame", "track_id")))


def clip_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an evidence clip holds the frames that its window and any usual frame rate promise, both ends included (S2 proper is ``video_integrity``)."""
    e = table(spark, folder, "evidence_artifacts").where("evidence_id is not null and clip_frame_count is not null and actual_clip_end_seconds is not null and actual_clip_start_seconds is not null")
    span = F.col("actual_clip_end_seconds") - F.col("actual_clip_start_seconds")
    whole = F.exists(F.array(*[F.lit(x) for x in (10.0, 12.5, 15.0, 20.0, 25.0, 30.0)]), lambda fps: F.abs(F.col("clip_frame_count") - span * fps - 1) <= 1)
    return e.select("evidence_id", whole.alias("whole")).distinct().groupBy("whole").agg(F.count(F.lit(1)).alias("n"))


def recorded_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions, told by the folder, whose evidence has a clip (P16 proper is a column of ``evidence_packages``)."""
    e = table(spark, folder, "evidence_artifacts").where("event_dir is not null")
    parts = F.split("event_dir", "/")
    return e.select(F.get(parts, F.lit(1)).alias("camera_id"), F.get(parts, F.lit(2)).alias("session_id"), F.contains("clip_path", F.lit(".mp4")).alias("has_clip")).groupBy("camera_id", "session_id").agg(F.bool_or("has_clip").alias("recorded"))


def first_label_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The first three broken label lines of each split, in the order of image and line."""
    from vigil.operators.datasets import judged
    from vigil.plans.datasets import _lines

    bad = judged(_lines(spark, folder)).where("error is not null").select("split", "image", "line_no", "error")
    return bad.withColumn("n", F.row_number().over(W.partitionBy("split").orderBy("image", "line_no", "error"))).where("n <= 3")


QUERIES = {f.__name__: f for f in (stream_rule_events, stream_zone_occupancy, stream_conflation, local_track_ids, clip_integrity, recorded_flag, first_label_errors)}

from vigil.plans.datasets import _VERDICT  # noqa: E402

SQL = {
    "stream_rule_events": f"{P._ALL} select camera_id, session_id, module_id, zone_id, track_id, frame_number from every_event",
    "stream_zone_occupancy": f"with {P._OCC} select camera_id, session_id, zone_id, frame_number, occupancy from occ",
    "stream_conflation": "select cast(epoch_us(ts) // 21600000000 % 4 as int) batch, concat('cam_', user_id % 5) camera_id, max(event_id) sequence, count(*) received, count(*) - 1 dropped from events group by 1, 2",
    "local_track_ids": f"""with {P._OBS}, f as (select camera_id, session_id, track_id, min(frame_number) first_frame from obs group by 1, 2, 3)
select *, cast(row_number() over (partition by camera_id, session_id order by first_frame, track_id) as int) local_id from f""",
    "clip_integrity": """with e as (select distinct evidence_id, clip_frame_count n, actual_clip_end_seconds - actual_clip_start_seconds s from evidence_artifacts
  where evidence_id is not null and clip_frame_count is not null and actual_clip_end_seconds is not null and actual_clip_start_seconds is not null),
w as (select distinct evidence_id, list_bool_or([abs(n - s * f - 1) <= 1 for f in [10.0::double, 12.5, 15.0, 20.0, 25.0, 30.0]]) whole from e)
select whole, count(*) n from w group by 1""",
    "recorded_flag": """select str_split(event_dir, '/')[2] camera_id, str_split(event_dir, '/')[3] session_id, bool_or(contains(clip_path, '.mp4')) recorded from evidence_artifacts where event_dir is not null group by 1, 2""",
    "first_label_errors": f"""with {_VERDICT} select split, image, line_no, verdict error, cast(row_number() over (partition by split order by image, line_no, verdict) as int) n from judged where verdict <> 'valid'
qualify row_number() over (partition by split order by image, line_no, verdict) <= 3""",
}
