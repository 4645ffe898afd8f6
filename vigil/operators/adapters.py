"""Driver tables as records of the monitored site: observations, frames, zones, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.geometry import edges
from vigil.session import table

FRAME_SECONDS = 21_600  # six hours of events are one frame
TRACK = ["camera_id", "session_id", "track_id"]
SQUARE = [(10.0, 10.0), (90.0, 10.0), (90.0, 90.0), (10.0, 90.0)]
ZONES = [
    ("A", "loading bay", "restricted", True, SQUARE, 0),
    ("B", "walkway", "counting", True, [(100.0, 20.0), (130.0, 20.0), (130.0, 60.0), (100.0, 60.0)], 1),
    ("C", "press area", "restricted", True, [(200.0, 0.0), (260.0, 0.0), (260.0, 99.0), (200.0, 99.0)], 2),
    ("D", "closed gate", "restricted", False, SQUARE, 3),
]
CONFIRM, TTL = 21_600.0, 86_400.0


def micros(column: str) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def event_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Events with camera, session, frame and the number of their properties."""
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.concat(F.lit("cam_"), (F.col("user_id") % 5).cast("string")).alias("camera_id"), F.lit("s1").alias("session_id"),
        F.col("user_id").alias("track_id"), F.floor(micros("ts") / (FRAME_SECONDS * 1_000_000)).alias("frame_number"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """One observation a track and frame: the latest event.  Laid out by track, so that rule windows need no exchange."""
    rows = event_frames(spark, folder).where("user_id is not null and ts is not null").repartition(*TRACK)
    last = F.row_number().over(W.partitionBy(*TRACK, "frame_number").orderBy(F.desc("ts"), F.desc("event_id")))
    return rows.withColumn("_n", last).where("_n = 1").select(
        *TRACK, "frame_number", (F.col("frame_number") * float(FRAME_SECONDS)).alias("timestamp_seconds"),
        F.col("value").alias("x"), F.col("k").cast("double").alias("y"), (F.lit(20) + F.col("event_id") % 80).cast("double").alias("height"),
        ((F.col("event_id") % 100) / 100).alias("confidence"), "event_id",
    )


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Every frame of each camera and session between its first and last, also those without observation."""
    span = event_frames(spark, folder).groupBy("camera_id", "session_id").agg(F.min("frame_number").alias("a"), F.max("frame_number").alias("z"))
    return span.select("camera_id", "session_id", F.explode(F.sequence("a", "z")).alias("frame_number")).withColumn("timestamp_seconds", F.col("frame_number") * float(FRAME_SECONDS))


def zones(spark: SparkSession, cameras: int = 5) -> DataFrame:
    """The enabled and disabled zones of every camera, with edges made once; a configuration table."""
    rows = [(f"cam_{c}", i, n, t, e, CONFIRM, CONFIRM, TTL, o, [{"x": x, "y": y} for x, y in p]) for c in range(cameras) for i, n, t, e, p, o in ZONES]
    schema = "camera_id string, zone_id string, zone_name string, zone_type string, enabled boolean, confirm_inside_seconds double, confirm_outside_seconds double, state_ttl_seconds double, zone_ordinal int, polygon array<struct<x:double,y:double>>"
    return spark.createDataFrame(rows, schema).withColumn("edges", edges(F.col("polygon")))
