"""Spatial and temporal rules over observations, as windows.

The state machines of entry, occupancy and lone-person rules are gaps-and-islands over ordered observations; all windows
of a rule cluster on the same leading keys, so that one exchange serves them.  Only the low-movement rule, whose anchor
depends on earlier anchors, is a fold; it runs over sorted rows in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.geometry import bounds, in_box, point_in_polygon

EPS = 1e-9
SESSION = ["camera_id", "session_id"]
TRACK = [*SESSION, "track_id"]
ORDER = ["timestamp_seconds", "frame_number"]


def membership(observations: DataFrame, zones: DataFrame) -> DataFrame:
    """Each observation with each enabled zone of its camera and whether its point lies inside.

    Zones are configuration that the driver has read from a file, so their size is bounded and they are broadcast; the
    observations, of which one camera may have most, stay where they are.
    """
    known = zones.where("enabled").withColumn("box", bounds(F.col("polygon"))).drop("polygon")
    x, y = F.col("x"), F.col("y")
    # most points miss the box, and only the others need the edges
    inside = F.when(in_box(x, y, F.col("box")), point_in_polygon(x, y, F.col("edges"))).otherwise(False)
    return observations.join(F.broadcast(known), "camera_id").withColumn("inside", inside).drop("edges", "box")


def ttl_segments(rows: DataFrame, keys: list[str], ttl: Column) -> DataFrame:
    """Number the stretches of a key that gaps of more than ``ttl`` seconds separate (equal gaps don't)."""
    w = W.partitionBy(*keys).orderBy(*ORDER)
    late = (F.col("timestamp_seconds") - F.lag("timestamp_seconds").over(w)) > ttl
    return rows.withColumn("segment", F.sum(F.when(late, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def debounce(member: DataFrame) -> DataFrame:
    """Confirmed state of each track in each zone: ``qualified``, ``before`` and ``confirmed`` (true, false, null unknown).

    A state is confirmed when raw membership has stayed the same for the zone's time; a confirmed state lasts until the
    other is confirmed or the track is unseen for longer than the zone's time to live.
    """
    keys = [*TRACK, "zone_id"]
    rows = ttl_segments(member, keys, F.col("state_ttl_seconds"))
    segment = [*keys, "segment"]
    w = W.partitionBy(*segment).orderBy(*ORDER)
    before = F.lag("inside").over(w)
    rows = rows.withColumn("_new", F.when(before.isNull() | (before != F.col("inside")), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    since = F.first("timestamp_seconds").over(W.partitionBy(*segment, "run").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
    lasted = F.col("timestamp_seconds") - since + EPS
    need = F.when(F.col("inside"), F.col("confirm_inside_seconds")).otherwise(F.col("confirm_outside_seconds"))
    rows = rows.withColumn("qualified", F.when(lasted >= need, F.col("inside")))
    rows = rows.withColumn("before", F.last("qualified", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return rows.withColumn("confirmed", F.coalesce("qualified", "before")).drop("_new")


def restricted_entries(states: DataFrame) -> DataFrame:
    """BAR-001: a track confirmed outside a restricted zone becomes confirmed inside."""
    return states.where("zone_type = 'restricted' and qualified and not before").select(
        *TRACK, F.lit("BAR-001").alias("module_id"), F.lit("restricted_zone_entry").alias("event_type"), "zone_id", "zone_name", *ORDER, "confidence"
    )


def occupancy(states: DataFrame, frames: DataFrame, zones: DataFrame) -> DataFrame:
    """IDT-004: confirmed tracks per frame and enabled zone, zero where there are none."""
    held = states.where("confirmed").groupBy(*SESSION, "zone_id", "frame_number").agg(
        F.count(F.lit(1)).alias("_n"), F.min("track_id").alias("lone_track"), F.array_join(F.transform(F.sort_array(F.collect_set("track_id")), lambda t: t.cast("string")), ",").alias("_ids")
    )
    spine = frames.join(F.broadcast(zones.where("enabled").select("camera_id", "zone_id", "zone_name", "zone_ordinal")), "camera_id")
    return spine.join(held, [*SESSION, "zone_id", "frame_number"], "left").select(
        *SESSION, "zone_id", "zone_name", *ORDER, F.coalesce("_n", F.lit(0)).alias("occupancy"), "lone_track", F.coalesce("_ids", F.lit("")).alias("inside_track_ids")
    )


def lone_person(occupied: DataFrame, confirm: float, reset: float) -> DataFrame:
    """EXC-002 timeline: ``status``, ``elapsed`` and ``is_event`` per frame and zone; the spine must hold empty frames."""
    keys = [*SESSION, "zone_id"]
    w = W.partitionBy(*keys).orderBy(*ORDER)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = occupied.withColumn("alone", F.col("occupancy") == 1)
    changed = F.lag("alone").over(w)
    rows = rows.withColumn("_run", F.sum(F.when(changed.isNull() | (changed != F.col("alone")), 1).otherwise(0)).over(upto))
    since = F.first("timestamp_seconds").over(W.partitionBy(*keys, "_run").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_clears", ~F.col("alone") & (F.col("timestamp_seconds") - since + EPS >= reset))
    rows = rows.withColumn("_episode", F.sum(F.col("_clears").cast("int")).over(upto))
    e = W.partitionBy(*keys, "_episode").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_since", F.min(F.when(F.col("alone"), F.col("timestamp_seconds"))).over(e))
    rows = rows.withColumn("_due", F.col("alone") & (F.col("timestamp_seconds") - F.col("_since") + EPS >= confirm))
    rows = rows.withColumn("_seen", F.sum(F.col("_due").cast("int")).over(e))
    idle = F.col("_since").isNull() | F.col("_clears")
    status = F.when(F.col("alone"), F.when(F.col("_seen") > 0, "active").otherwise("confirming")).otherwise(F.when(idle, "clear").otherwise("resetting"))
    return rows.select(
        *keys, *ORDER, "occupancy", "lone_track", status.alias("status"), F.when(idle, 0.0).otherwise(F.col("timestamp_seconds") - F.col("_since")).alias("elapsed"),
        (F.col("_due") & (F.col("_seen") == 1)).alias("is_event"),
    )


def lone_person_events(timeline: DataFrame) -> DataFrame:
    return timeline.where("is_event").select(
        *SESSION, F.col("lone_track").alias("track_id"), F.lit("EXC-002").alias("module_id"), F.lit("buddy_required_single_person").alias("event_type"), "zone_id", *ORDER, "occupancy"
    )


def eligible(states: DataFrame) -> DataFrame:
    """Observations confirmed inside some zone, with the first such zone by order of configuration."""
    w = W.partitionBy(*TRACK, "frame_number").orderBy("zone_ordinal")
    return states.where("confirmed").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*TRACK, *ORDER, "x", "y", "height", "zone_id")


MOVEMENT = "camera_id string, session_id string, track_id long, timestamp_seconds double, frame_number long, zone_id string, elapsed double, is_event boolean"


def low_movement(rows: DataFrame, no_movement: float, ratio: float, least_pixels: float, ttl: float) -> DataFrame:
    """ERG-006: seconds since a track last moved by more than its threshold, and one event an episode.

    Rows of a track lie in one partition in order of time; the fold holds one anchor and never a whole track, and goes from anchor
    to anchor over arrays.
    """

    def leaves(x: np.ndarray, y: np.ndarray, h: np.ndarray, i: int, end: int, anchor: tuple[float, float, float]) -> int:
        """The first row from ``i`` on, before ``end``, that is further from the anchor than its threshold; ``end`` if none is."""
        ax, ay, ah = anchor
        width = 64
        while i < end:
            z = min(end, i + width)
            far = np.hypot(x[i:z] - ax, y[i:z] - ay) > np.maximum(least_pixels, ratio * np.maximum(ah, h[i:z]))
            if far.any():
                return i + int(far.argmax())
            i, width = z, 2 * width
        return end

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor, since, seen, done = None, (0.0, 0.0, 0.0), 0.0, 0.0, False
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            t, x, y, h = (pdf[c].to_numpy(float) for c in ("timestamp_seconds", "x", "y", "height"))
            names = [pdf[c].to_numpy() for c in TRACK]
            fresh = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in names]) | (np.diff(t) > ttl)]
            if tuple(c[0] for c in names) == key and not t[0] - seen > ttl:
                fresh[0] = False
            elapsed, events = np.zeros(n), np.zeros(n, bool)
            starts = np.flatnonzero(fresh).tolist()
            # from anchor to anchor: rows between two anchors are judged together
            for a, z in zip(starts if fresh[0] else [0, *starts], [*(starts[1:] if fresh[0] else starts), n]):
                i = a
                while i < z:
                    if i > a or fresh[a]:
                        anchor, since, done = (x[i], y[i], h[i]), t[i], False
                    j = leaves(x, y, h, i + 1 if i > a or fresh[a] else i, z, anchor)
                    if j == i:  # the first row of a batch leaves the anchor of the batch before
                        anchor, since, done = (x[i], y[i], h[i]), t[i], False
                        j = leaves(x, y, h, i + 1, z, anchor)
                    elapsed[i:j] = t[i:j] - since
                    if not done:
                        due = elapsed[i:j] + EPS >= no_movement
                        if due.any():
                            events[i + int(due.argmax())] = done = True
                    i = j
            key, seen = tuple(c[-1] for c in names), t[-1]
            yield pdf[["camera_id", "session_id", "track_id", "timestamp_seconds", "frame_number", "zone_id"]].assign(elapsed=elapsed, is_event=events)

    return rows.repartition(*TRACK).sortWithinPartitions(*TRACK, *ORDER).mapInPandas(fold, MOVEMENT)


def low_movement_events(timeline: DataFrame) -> DataFrame:
    return timeline.where("is_event").select(
        *TRACK, F.lit("ERG-006").alias("module_id"), F.lit("prolonged_low_movement").alias("event_type"), "zone_id", *ORDER, F.col("elapsed").alias("stationary_duration_seconds")
    )


def event_id(prefix: Column, *natural: str) -> Column:
    """A deterministic id: normalised prefix and 16 digits of a digest of the natural key, so retries repeat it."""
    cleaned = F.translate(F.lower(F.trim(prefix)), "-", "_")
    return F.concat(cleaned, F.lit("_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in natural]), 256), 1, 16))


def safety_events(entries: DataFrame, lone: DataFrame, still: DataFrame, zones: DataFrame) -> DataFrame:
    """The three rules' events in one form, temporal ones with their zone's name."""
    names = zones.select("camera_id", "zone_id", "zone_name").distinct()
    parts = entries.drop("zone_name").unionByName(lone, allowMissingColumns=True).unionByName(still, allowMissingColumns=True)
    natural = [*TRACK, "module_id", "zone_id", "frame_number"]
    prefix = F.concat(F.when(F.col("module_id") == "BAR-001", F.lit("bar")).otherwise(F.col("module_id")), F.lit("_"), F.col("track_id").cast("string"))
    return parts.join(F.broadcast(names), ["camera_id", "zone_id"], "left").select(
        event_id(prefix, *natural).alias("event_id"), *TRACK, "module_id", "event_type", "zone_id", "zone_name",
        F.bround("timestamp_seconds", 3).alias("source_timestamp_seconds"), "frame_number", F.bround("confidence", 4).alias("detection_confidence"),
        F.bround("stationary_duration_seconds", 2).alias("stationary_duration_seconds"), F.col("occupancy").cast("int").alias("zone_occupancy"),
        F.lit("1.0").alias("schema_version"), F.lit("unclassified").alias("severity"), F.lit("new").alias("status"),
    )


def clip_bounds(t: Column, duration: Column, before: float = 5.0, after: float = 5.0) -> list[Column]:
    """Start, end, seconds before and seconds after of an event's clip, inside the source, to milliseconds."""
    start = F.greatest(F.lit(0.0), t - before)
    end = F.greatest(start, F.least(duration, t + after))
    return [F.bround(start, 3).alias("clip_start"), F.bround(end, 3).alias("clip_end"), F.greatest(F.lit(0.0), F.bround(t - start, 3)).alias("pre"), F.greatest(F.lit(0.0), F.bround(end - t, 3)).alias("post")]
