"""Queries of the spatial and temporal rules, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions import geometry as G
from vigil.operators import adapters as A
from vigil.operators import rules as R
from vigil.session import Scratch

EXC_CONFIRM, EXC_RESET = 21_600.0, 43_200.0
ERG = dict(no_movement=172_800.0, ratio=0.10, least_pixels=5.0, ttl=604_800.0)


def _states(spark: SparkSession, folder: str) -> DataFrame:
    return R.debounce(R.membership(A.observations(spark, folder), A.zones(spark)))


def _occupied(spark: SparkSession, folder: str) -> DataFrame:
    return R.occupancy(_states(spark, folder), A.frames(spark, folder), A.zones(spark))


def _timeline(spark: SparkSession, folder: str) -> DataFrame:
    return R.lone_person(_occupied(spark, folder), EXC_CONFIRM, EXC_RESET)


def _movement(spark: SparkSession, folder: str) -> DataFrame:
    return R.low_movement(R.eligible(_states(spark, folder)), **ERG)


def observation_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    """Detections of the person class above a confidence, clipped boxes that aren't degenerate, bottom centre."""
    crops = _boxes(spark, folder)
    kept = crops.where("class_id = 0 and confidence >= 0.25 and confidence <= 1 and not isnan(confidence)")
    corners = G.clip_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(640), F.lit(360))
    boxed = kept.select("event_id", "confidence", *[c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"))]).where("x2 > x1 and y2 > y1")
    cx, cy = G.bottom_centre(F.col("x1"), F.col("x2"), F.col("y2"))
    return boxed.select("event_id", "confidence", "x1", "y1", "x2", "y2", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), cx.alias("centre_x"), cy.alias("centre_y"))


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Raw detections made of events: corners as doubles, some beyond the frame."""
    return A.event_frames(spark, folder).select(
        "event_id", (F.col("event_id") % 3).alias("class_id"), ((F.col("event_id") % 101) / 100).alias("confidence"),
        (F.col("value") * 4 - 50).alias("x1"), (F.col("k") * 4.0 - 20).alias("y1"), (F.col("value") * 4 + F.col("k") - 60).alias("x2"), (F.col("k") * 4.5 + 10).alias("y2"),
    )


def box_round_clip(spark: SparkSession, folder: str) -> DataFrame:
    """Rounded and clipped corners."""
    corners = G.clip_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(640), F.lit(360))
    return _boxes(spark, folder).select("event_id", *[c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"))])


def padded_crop_box(spark: SparkSession, folder: str) -> DataFrame:
    """Crop boxes widened by 12 %, empty ones left out."""
    x1, y1, x2, y2 = (F.col(f"person_box_{c}") for c in ("x1", "y1", "x2", "y2"))
    box = G.padded_box(x1, y1, x2, y2, F.lit(1280), F.lit(720))
    from vigil.session import table

    return table(spark, folder, "person_crops").where("crop_id is not null").select("crop_id", *[c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"))]).where("x2 > x1 and y2 > y1").distinct()


def polygon_area(spark: SparkSession, folder: str) -> DataFrame:
    """Area of each zone."""
    return A.zones(spark).select("camera_id", "zone_id", "enabled", G.area(F.col("edges")).alias("area"))


def point_in_polygon_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Observations in enabled zones of their camera."""
    return R.membership(A.observations(spark, folder), A.zones(spark)).where("inside").select(*R.TRACK, "frame_number", "zone_id")


def ttl_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of each track without a gap over the time to live."""
    rows = R.ttl_segments(A.observations(spark, folder), R.TRACK, F.lit(A.TTL))
    return rows.groupBy(*R.TRACK, "segment").agg(F.count(F.lit(1)).alias("n"), F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"))


def debounce_state(spark: SparkSession, folder: str) -> DataFrame:
    """Confirmed state of each track and zone."""
    state = F.when(F.col("confirmed"), "inside").when(~F.col("confirmed"), "outside").otherwise("unknown")
    return _states(spark, folder).select(*R.TRACK, "zone_id", "frame_number", "inside", state.alias("state"))


def bar_001_restricted_entry(spark: SparkSession, folder: str) -> DataFrame:
    """Entries into restricted zones."""
    return R.restricted_entries(_states(spark, folder))


def idt_004_zone_occupancy(spark: SparkSession, folder: str) -> DataFrame:
    """Occupancy of every frame and zone."""
    return _occupied(spark, folder).select(*R.SESSION, "zone_id", "frame_number", "occupancy")


def idt_004_max_occupancy(spark: SparkSession, folder: str) -> DataFrame:
    """A2: highest occupancy per zone."""
    return _occupied(spark, folder).groupBy(*R.SESSION, "zone_id").agg(F.max("occupancy").alias("max_occupancy"))


def inside_track_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A3: confirmed tracks of each frame and zone."""
    return _occupied(spark, folder).where("occupancy > 0").select(*R.SESSION, "zone_id", "frame_number", "inside_track_ids")


def exc_002_lone_person(spark: SparkSession, folder: str) -> DataFrame:
    """A zone with one person for too long."""
    return R.lone_person_events(_timeline(spark, folder))


def exc_002_status_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Status and elapsed time of every frame and zone."""
    return _timeline(spark, folder).select(*R.SESSION, "zone_id", "frame_number", "status", "elapsed")


def erg_006_low_movement(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks that hardly move for too long."""
    return R.low_movement_events(_movement(spark, folder))


def erg_006_elapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds since each eligible observation's track moved."""
    return _movement(spark, folder).select(*R.TRACK, "frame_number", "zone_id", "elapsed")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    states, zones = Scratch(spark).save(_states(spark, folder)), A.zones(spark)  # three rules read them
    lone = R.lone_person_events(R.lone_person(R.occupancy(states, A.frames(spark, folder), zones), EXC_CONFIRM, EXC_RESET))
    return R.safety_events(R.restricted_entries(states), lone, R.low_movement_events(R.low_movement(R.eligible(states), **ERG)), zones)


def safety_events_union(spark: SparkSession, folder: str) -> DataFrame:
    """All rules' events in one form with deterministic ids; -1 where a rule gives no occupancy."""
    return _events(spark, folder).withColumn("zone_occupancy", F.coalesce("zone_occupancy", F.lit(-1)))


def events_per_module(spark: SparkSession, folder: str) -> DataFrame:
    """A4: events of each rule."""
    return _events(spark, folder).groupBy("module_id").agg(F.count(F.lit(1)).alias("n_events"))


def evidence_clip_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Clip windows of events, clamped to the source."""
    t, length = (F.col("event_id") % 1000) / 8, (F.lit(20) + F.col("user_id") % 100).cast("double")
    return A.event_frames(spark, folder).select("event_id", *R.clip_bounds(t, length))


def evidence_frame_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of the camera within a day before and after each entry, the last one included.

    The range is cut into buckets of its own width, so the join is an equi-join with at most three buckets an event.
    """
    day = 86_400.0
    entries = bar_001_restricted_entry(spark, folder).select(*R.TRACK, "zone_id", F.col("frame_number").alias("event_frame"), (F.col("timestamp_seconds") - day).alias("a"), (F.col("timestamp_seconds") + day).alias("z"))
    left = entries.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / day), F.floor(F.col("z") / day))))
    right = A.frames(spark, folder).withColumn("bucket", F.floor(F.col("timestamp_seconds") / day))
    met = left.join(right, [*R.SESSION, "bucket"]).where("timestamp_seconds >= a and timestamp_seconds <= z")
    return met.groupBy(*R.TRACK, "zone_id", "event_frame").agg(F.count(F.lit(1)).alias("n_frames"), F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"))


def recent_label_banner(spark: SparkSession, folder: str) -> DataFrame:
    """For every frame the last three entries of its camera within a day, also where the frame itself has none.

    Each entry carries the two before it, and a frame takes the last entry up to it, so that no window holds a list.
    """
    frames = A.frames(spark, folder).select(*R.SESSION, "timestamp_seconds", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("track_id"), F.lit(None).cast("string").alias("zone_id"), "frame_number")
    entries = bar_001_restricted_entry(spark, folder).select(*R.SESSION, "timestamp_seconds", F.lit(0).alias("kind"), "track_id", "zone_id", "frame_number")
    w = W.partitionBy(*R.SESSION).orderBy("timestamp_seconds", "kind", "frame_number", "track_id", "zone_id")
    label = F.when(F.col("kind") == 0, F.struct(F.col("timestamp_seconds").alias("t"), F.concat("zone_id", F.lit(":"), F.col("track_id").cast("string")).alias("text")))
    rows = entries.unionByName(frames).withColumn("e0", label)
    last = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("e1", F.when(F.col("kind") == 0, last("e0")))
    rows = rows.withColumn("e2", F.when(F.col("kind") == 0, last(F.when(F.col("kind") == 0, F.struct(F.col("e1").alias("e"))))["e"]))
    held = F.last(F.when(F.col("kind") == 0, F.struct("e0", "e1", "e2")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("held", held).where("kind = 1 and held is not null")
    recent = [F.when(F.col(f"held.{e}.t") >= F.col("timestamp_seconds") - 86_400, F.col(f"held.{e}.text")) for e in ("e2", "e1", "e0")]
    return rows.select(*R.SESSION, "frame_number", F.concat_ws(",", *recent).alias("banner")).where("banner <> ''")


def review_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct moments around entries that a reviewer looks at."""
    t = F.col("timestamp_seconds") / 1000
    return bar_001_restricted_entry(spark, folder).select(*R.SESSION, F.explode(F.array(F.bround(F.greatest(F.lit(0.0), t - 2), 3), F.bround(t, 3), F.bround(t + 0.7, 3))).alias("review_at")).distinct()


def interval_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Evenly spaced moments from each order's date over an interval of its own length."""
    from vigil.session import table

    start, end = (F.col("o_orderkey") % 50).cast("double"), (F.col("o_orderkey") % 50 + F.col("o_custkey") % 4 + 0.75)
    n = F.ceil((end - start) / 0.5)
    return table(spark, folder, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"), start.alias("s")).select("o_orderkey", (F.col("s") + F.col("i") * 0.5).alias("sample_at"))


def detection_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Observations, distinct tracks, most tracks at once and mean confidence per camera."""
    obs = A.observations(spark, folder)
    per = obs.groupBy(*R.SESSION, "frame_number").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy(*R.SESSION).agg(F.max("n").alias("max_simultaneous"))
    return obs.groupBy(*R.SESSION).agg(F.count(F.lit(1)).alias("n_observations"), F.count_distinct("track_id").alias("n_tracks"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).join(most, R.SESSION)


QUERIES = {
    f.__name__: f
    for f in (
        bar_001_restricted_entry, observation_sanitize, box_round_clip, padded_crop_box, polygon_area, point_in_polygon_membership, ttl_segments, debounce_state,
        idt_004_zone_occupancy, idt_004_max_occupancy, inside_track_ids, exc_002_lone_person, exc_002_status_timeline, erg_006_low_movement, erg_006_elapsed,
        safety_events_union, events_per_module, evidence_clip_bounds, evidence_frame_range_join, recent_label_banner, review_timestamps, interval_samples, detection_totals,
    )
}

_EDGES = ", ".join(
    f"('{z}', '{name}', '{kind}', {o}, {enabled}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)"
    for z, name, kind, enabled, p, o in A.ZONES for a, b in zip(p, p[1:] + p[:1])
)
_EV = """
ev as (select event_id, ts, user_id, event_type, value, concat('cam_', user_id % 5) camera_id, 's1' session_id, user_id track_id,
  epoch_us(ts) // 21600000000 frame_number, cast(props->>'k' as int) k from events)"""
_OBS = _EV + """,
obs as (select camera_id, session_id, track_id, frame_number, frame_number * 21600.0::double timestamp_seconds, value x, k::double y,
  (20 + event_id % 80)::double height, (event_id % 100) / 100 confidence, event_id
  from ev qualify row_number() over (partition by camera_id, session_id, track_id, frame_number order by ts desc, event_id desc) = 1)"""
_MEMBER = _OBS + f""",
edges(zone_id, zone_name, zone_type, zone_ordinal, enabled, x1, y1, x2, y2) as (values {_EDGES}),
member as (
  select camera_id, session_id, track_id, frame_number, timestamp_seconds, x, y, height, confidence, zone_id, zone_name, zone_type, zone_ordinal,
    bool_or(abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) <= 1e-9 and x between least(x1, x2) - 1e-9 and greatest(x1, x2) + 1e-9 and y between least(y1, y2) - 1e-9 and greatest(y1, y2) + 1e-9)
    or count(*) filter (where (y1 > y) <> (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / nullif(y2 - y1, 0)) % 2 = 1 inside
  from obs cross join edges where enabled group by all)"""
_STATES = _MEMBER + """,
g1 as (select *, case when timestamp_seconds - lag(timestamp_seconds) over w > 86400 then 1 else 0 end late from member
  window w as (partition by camera_id, session_id, track_id, zone_id order by timestamp_seconds, frame_number)),
g2 as (select *, sum(late) over (partition by camera_id, session_id, track_id, zone_id order by timestamp_seconds, frame_number rows unbounded preceding) segment from g1),
g3 as (select *, case when inside is distinct from lag(inside) over (partition by camera_id, session_id, track_id, zone_id, segment order by timestamp_seconds, frame_number) then 1 else 0 end fresh from g2),
g4 as (select *, sum(fresh) over (partition by camera_id, session_id, track_id, zone_id, segment order by timestamp_seconds, frame_number rows unbounded preceding) run from g3),
g5 as (select *, case when timestamp_seconds - min(timestamp_seconds) over (partition by camera_id, session_id, track_id, zone_id, segment, run) + 1e-9 >= 21600 then inside end qualified from g4),
g6 as (select *, last_value(qualified ignore nulls) over (partition by camera_id, session_id, track_id, zone_id, segment order by timestamp_seconds, frame_number rows between unbounded preceding and 1 preceding) "before" from g5),
states as (select *, coalesce(qualified, "before") confirmed from g6),
bar as (select camera_id, session_id, track_id, 'BAR-001' module_id, 'restricted_zone_entry' event_type, zone_id, zone_name, timestamp_seconds, frame_number, confidence
  from states where zone_type = 'restricted' and qualified and not "before")"""
_OCC = _STATES + """,
spine as (select camera_id, session_id, unnest(range(a, z + 1)) frame_number from (select camera_id, session_id, min(frame_number) a, max(frame_number) z from ev group by 1, 2)),
held as (select camera_id, session_id, zone_id, frame_number, count(*) n, min(track_id) lone, string_agg(cast(track_id as varchar), ',' order by track_id) ids from states where confirmed group by 1, 2, 3, 4),
occ as (select s.camera_id, s.session_id, z.zone_id, z.zone_name, s.frame_number, s.frame_number * 21600.0::double timestamp_seconds, coalesce(h.n, 0) occupancy, h.lone, coalesce(h.ids, '') ids
  from spine s cross join (select distinct zone_id, zone_name from edges where enabled) z left join held h using (camera_id, session_id, zone_id, frame_number))"""
_EXC = _OCC + """,
x1 as (select *, occupancy = 1 alone from occ),
x2 as (select *, case when alone is distinct from lag(alone) over (partition by camera_id, session_id, zone_id order by frame_number) then 1 else 0 end c from x1),
x3 as (select *, sum(c) over (partition by camera_id, session_id, zone_id order by frame_number rows unbounded preceding) run from x2),
x4 as (select *, not alone and timestamp_seconds - min(timestamp_seconds) over (partition by camera_id, session_id, zone_id, run) + 1e-9 >= 43200 clears from x3),
x5 as (select *, sum(clears::int) over (partition by camera_id, session_id, zone_id order by frame_number rows unbounded preceding) episode from x4),
x6 as (select *, min(case when alone then timestamp_seconds end) over (partition by camera_id, session_id, zone_id, episode order by frame_number rows unbounded preceding) since from x5),
x7 as (select *, coalesce(alone and timestamp_seconds - since + 1e-9 >= 21600, false) due from x6),
x8 as (select *, sum(due::int) over (partition by camera_id, session_id, zone_id, episode order by frame_number rows unbounded preceding) seen from x7),
exc as (select *, since is null or clears idle, due and seen = 1 is_event from x8)"""
_ERG = """,
el as (select * from states where confirmed qualify row_number() over (partition by camera_id, session_id, track_id, frame_number order by zone_ordinal) = 1),
seq as (select *, row_number() over (partition by camera_id, session_id, track_id order by timestamp_seconds, frame_number) i from el),
erg(camera_id, session_id, track_id, i, timestamp_seconds, frame_number, zone_id, ax, ay, ah, since, done, is_event) as (
  select camera_id, session_id, track_id, i, timestamp_seconds, frame_number, zone_id, x, y, height, timestamp_seconds, false, false from seq where i = 1
  union all
  select s.camera_id, s.session_id, s.track_id, s.i, s.timestamp_seconds, s.frame_number, s.zone_id, case when m.moved then s.x else e.ax end, case when m.moved then s.y else e.ay end,
    case when m.moved then s.height else e.ah end, case when m.moved then s.timestamp_seconds else e.since end,
    case when m.moved then false else e.done or s.timestamp_seconds - e.since + 1e-9 >= 172800 end,
    not m.moved and not e.done and s.timestamp_seconds - e.since + 1e-9 >= 172800
  from erg e join seq s on s.camera_id = e.camera_id and s.session_id = e.session_id and s.track_id = e.track_id and s.i = e.i + 1,
  lateral (select s.timestamp_seconds - e.timestamp_seconds > 604800 or sqrt((s.x - e.ax) ** 2 + (s.y - e.ay) ** 2) > greatest(5.0, 0.1 * greatest(e.ah, s.height)) moved) m)"""
_ALL = "with recursive " + _EXC + _ERG + """,
every_event as (
  select camera_id, session_id, track_id, module_id, event_type, zone_id, timestamp_seconds, frame_number, confidence, null::double still, null::bigint occ from bar
  union all select camera_id, session_id, lone, 'EXC-002', 'buddy_required_single_person', zone_id, timestamp_seconds, frame_number, null, null, occupancy from exc where is_event
  union all select camera_id, session_id, track_id, 'ERG-006', 'prolonged_low_movement', zone_id, timestamp_seconds, frame_number, null, timestamp_seconds - since, null from erg where is_event)"""
_CLIP = "greatest(0.0, t - 5) a, greatest(greatest(0.0, t - 5), least(d, t + 5)) z"
_ROUND = "cast(greatest(0, least({n} - 1, round_even({c}, 0))) as int)"
_CORNERS = ", ".join(f"{_ROUND.format(n=n, c=c)} {c}" for c, n in (("x1", 640), ("y1", 360), ("x2", 640), ("y2", 360)))
_RAW = f"with {_EV}, raw as (select event_id, event_id % 3 class_id, (event_id % 101) / 100 confidence, value * 4 - 50 x1, k * 4.0::double - 20 y1, value * 4 + k - 60 x2, k * 4.5::double + 10 y2 from ev)"
_PAD = "cast(round_even((person_box_{b}2 - person_box_{b}1) * 0.12::double, 0) as int)"

SQL = {
    "bar_001_restricted_entry": f"with {_STATES} select * from bar",
    "observation_sanitize": f"""{_RAW}, c as (select event_id, confidence, {_CORNERS} from raw where class_id = 0 and confidence >= 0.25 and confidence <= 1)
select *, x2 - x1 width, y2 - y1 height, cast(floor((x1 + x2) / 2) as int) centre_x, y2 centre_y from c where x2 > x1 and y2 > y1""",
    "box_round_clip": f"{_RAW} select event_id, {_CORNERS} from raw",
    "padded_crop_box": f"""select * from (select distinct crop_id, greatest(0, person_box_x1 - {_PAD.format(b='x')}) x1, greatest(0, person_box_y1 - {_PAD.format(b='y')}) y1,
  least(1280, person_box_x2 + {_PAD.format(b='x')}) x2, least(720, person_box_y2 + {_PAD.format(b='y')}) y2 from person_crops where crop_id is not null) where x2 > x1 and y2 > y1""",
    "polygon_area": f"""with edges(zone_id, zone_name, zone_type, zone_ordinal, enabled, x1, y1, x2, y2) as (values {_EDGES})
select concat('cam_', c) camera_id, zone_id, enabled, abs(sum(x1 * y2 - x2 * y1)) / 2 area from edges, range(5) t(c) group by c, zone_id, enabled""",
    "point_in_polygon_membership": f"with {_MEMBER} select camera_id, session_id, track_id, frame_number, zone_id from member where inside",
    "ttl_segments": f"""with {_OBS}, a as (select *, case when timestamp_seconds - lag(timestamp_seconds) over (partition by camera_id, session_id, track_id order by frame_number) > 86400 then 1 else 0 end late from obs),
b as (select *, cast(sum(late) over (partition by camera_id, session_id, track_id order by frame_number rows unbounded preceding) as bigint) segment from a)
select camera_id, session_id, track_id, segment, count(*) n, min(frame_number) first_frame, max(frame_number) last_frame from b group by 1, 2, 3, 4""",
    "debounce_state": f"with {_STATES} select camera_id, session_id, track_id, zone_id, frame_number, inside, case when confirmed then 'inside' when not confirmed then 'outside' else 'unknown' end state from states",
    "idt_004_zone_occupancy": f"with {_OCC} select camera_id, session_id, zone_id, frame_number, occupancy from occ",
    "idt_004_max_occupancy": f"with {_OCC} select camera_id, session_id, zone_id, max(occupancy) max_occupancy from occ group by 1, 2, 3",
    "inside_track_ids": f"with {_OCC} select camera_id, session_id, zone_id, frame_number, ids inside_track_ids from occ where occupancy > 0",
    "exc_002_lone_person": f"with {_EXC} select camera_id, session_id, lone track_id, 'EXC-002' module_id, 'buddy_required_single_person' event_type, zone_id, timestamp_seconds, frame_number, occupancy from exc where is_event",
    "exc_002_status_timeline": f"""with {_EXC} select camera_id, session_id, zone_id, frame_number,
  case when alone then case when seen > 0 then 'active' else 'confirming' end when idle then 'clear' else 'resetting' end status, case when idle then 0.0::double else timestamp_seconds - since end elapsed from exc""",
    "erg_006_low_movement": f"with recursive {_STATES}{_ERG} select camera_id, session_id, track_id, 'ERG-006' module_id, 'prolonged_low_movement' event_type, zone_id, timestamp_seconds, frame_number, timestamp_seconds - since stationary_duration_seconds from erg where is_event",
    "erg_006_elapsed": f"with recursive {_STATES}{_ERG} select camera_id, session_id, track_id, frame_number, zone_id, timestamp_seconds - since elapsed from erg",
    "safety_events_union": f"""{_ALL} select
  concat(case when module_id = 'BAR-001' then 'bar' else translate(lower(module_id), '-', '_') end, '_', track_id, '_', substr(sha256(concat_ws('|', camera_id, session_id, track_id, module_id, zone_id, frame_number)), 1, 16)) event_id,
  camera_id, session_id, track_id, module_id, event_type, zone_id, zone_name, round_even(timestamp_seconds, 3) source_timestamp_seconds, frame_number, round_even(confidence, 4) detection_confidence,
  round_even(still, 2) stationary_duration_seconds, coalesce(cast(occ as int), -1) zone_occupancy, '1.0' schema_version, 'unclassified' severity, 'new' status
from every_event left join (select distinct zone_id, zone_name from edges) using (zone_id)""",
    "events_per_module": f"{_ALL} select module_id, count(*) n_events from every_event group by 1",
    "evidence_clip_bounds": f"""with c as (select event_id, (event_id % 1000) / 8 t, (20 + user_id % 100)::double d from events), b as (select *, {_CLIP} from c)
select event_id, round_even(a, 3) clip_start, round_even(z, 3) clip_end, greatest(0.0, round_even(t - a, 3)) pre, greatest(0.0, round_even(z - t, 3)) post from b""",
    "evidence_frame_range_join": f"""with {_OCC} select b.camera_id, b.session_id, b.track_id, b.zone_id, b.frame_number event_frame, count(*) n_frames, min(s.frame_number) first_frame, max(s.frame_number) last_frame
from bar b join spine s on s.camera_id = b.camera_id and s.session_id = b.session_id and s.frame_number * 21600.0 between b.timestamp_seconds - 86400 and b.timestamp_seconds + 86400 group by 1, 2, 3, 4, 5""",
    "recent_label_banner": f"""with {_OCC}, r as (select a.camera_id, a.session_id, a.frame_number, b.frame_number f, b.track_id, b.zone_id
  from (select *, frame_number * 21600.0::double timestamp_seconds from spine) a join bar b on a.camera_id = b.camera_id and a.session_id = b.session_id and b.timestamp_seconds between a.timestamp_seconds - 86400 and a.timestamp_seconds
  qualify row_number() over (partition by a.camera_id, a.session_id, a.frame_number order by b.frame_number desc, b.track_id desc, b.zone_id desc) <= 3)
select camera_id, session_id, frame_number, string_agg(concat(zone_id, ':', track_id), ',' order by f, track_id, zone_id) banner from r group by 1, 2, 3""",
    "review_timestamps": f"""with {_STATES} select distinct camera_id, session_id, unnest([round_even(greatest(0.0, timestamp_seconds / 1000 - 2), 3), round_even(timestamp_seconds / 1000, 3), round_even(timestamp_seconds / 1000 + 0.7, 3)]) review_at from bar""",
    "interval_samples": """select o_orderkey, (o_orderkey % 50)::double + i * 0.5 sample_at from orders, lateral (select unnest(range(cast(ceil((o_custkey % 4 + 0.75) / 0.5) as bigint))) i)""",
    "detection_totals": f"""with {_OBS}, p as (select camera_id, session_id, frame_number, count(*) n from obs group by 1, 2, 3), m as (select camera_id, session_id, max(n) max_simultaneous from p group by 1, 2)
select o.camera_id, o.session_id, count(*) n_observations, count(distinct track_id) n_tracks, round(avg(confidence), 6) mean_confidence, any_value(max_simultaneous) max_simultaneous from obs o join m using (camera_id, session_id) group by 1, 2""",
}
