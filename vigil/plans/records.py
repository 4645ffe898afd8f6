"""Queries over event, audit and status records, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.text import instant
from vigil.operators import adapters as A
from vigil.operators import records as R
from vigil.session import Scratch, table

NOW = "2021-02-15T00:00:00+00:00"
STALE_SECONDS = 30.0


def recent_events_top50(spark: SparkSession, folder: str) -> DataFrame:
    """O1: the newest state of each event, latest source second first (else creation, else 0), ties by id."""
    events = R.newest(table(spark, folder, "safety_events").where("event_id is not null"), ["event_id"], [F.desc_nulls_last("ingested_at"), F.asc("status")])
    created = A.micros("created_at_utc") / 1e6
    key = F.coalesce("source_timestamp_seconds", created, F.lit(0.0))
    return events.select("event_id", "camera_id", "module_id", "status", F.round(key, 3).alias("sort_key")).orderBy(F.desc("sort_key"), "event_id").limit(50)


def audit_dedup_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Audit entries once a (time, camera, session, event, action), newest time text first, 100 of them."""
    keys = ["audit_timestamp_utc", "camera_id", "session_id", "event_id", "action"]
    rows = R.with_context(table(spark, folder, "audit_log")).groupBy(*keys).agg(F.min("audit_id").alias("audit_id"))
    return rows.orderBy(F.desc(F.coalesce("audit_timestamp_utc", F.lit(""))), "audit_id").limit(100).select("audit_id", "action", F.coalesce("audit_timestamp_utc", F.lit("")).alias("audit_timestamp_utc"))


def audit_path_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Camera and session of audit rows, from the path where the record lacks them."""
    rows = R.with_context(table(spark, folder, "audit_log").select("audit_id", "camera_id", "session_id", "log_path"))
    return rows.select("audit_id", F.coalesce("camera_id", F.lit("?")).alias("camera_id"), F.coalesce("session_id", F.lit("?")).alias("session_id")).distinct()


def audit_details_parse(spark: SparkSession, folder: str) -> DataFrame:
    """details that can be parsed, and those cut short, per action."""
    rows = table(spark, folder, "audit_log").where("details is not null")
    bad = F.try_parse_json("details").isNull()
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_malformed"), F.count(F.when(~bad, F.get_json_object("details", "$.track_id"))).alias("n_with_track"))


def runtime_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Age of each camera's last readable status at a given moment; stale above 30 s."""
    rows = table(spark, folder, "runtime_status").select("camera_id", F.unix_micros(instant(F.col("updated_at_utc"))).alias("at"))
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.max("at")) / 1e6)
    return rows.where("at is not null").groupBy("camera_id").agg(F.round(age, 3).alias("age_seconds"), (age > STALE_SECONDS).alias("is_stale"))


def camera_zone_left_join(spark: SparkSession, folder: str) -> DataFrame:
    """Cameras with the number and names of their enabled zones, also cameras without any."""
    cameras = A.event_frames(spark, folder).select("camera_id").distinct()
    zones = A.zones(spark, 3).where("enabled").groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.coalesce("zone_name", "zone_id", F.lit("unnamed")))), ",").alias("names"))
    return cameras.join(zones, "camera_id", "left").select("camera_id", F.coalesce("n", F.lit(0)).alias("zone_count"), F.coalesce("names", F.lit("")).alias("zone_names"), F.col("n").isNotNull().alias("has_zone"))


def controls_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Defaults, of which only ``enabled`` of known entries may be overridden."""
    defaults = table(spark, folder, "part").where("p_partkey is not null").select(F.col("p_partkey").alias("control_id"), F.col("p_name").alias("label"), (F.col("p_size") > 10).alias("enabled"))
    overrides = table(spark, folder, "supplier").select((F.col("s_suppkey") * 3).alias("control_id"), (F.col("s_acctbal") > 0).alias("_enabled"))
    return defaults.join(overrides, "control_id", "left").select("control_id", "label", F.coalesce("_enabled", "enabled").alias("enabled"))


def zone_usability(spark: SparkSession, folder: str) -> DataFrame:
    """Why a camera's zones can't be used, in the order in which reasons count, per last metrics of a session."""
    rows = table(spark, folder, "rtsp_metrics").where("metric_id is not null")
    last = R.newest(rows, ["session_id"], [F.desc("snapshot_at"), F.desc("metric_id")])
    configured = F.col("camera_id").rlike("0[0-9]$")
    expected = (F.col("decoded_width") == 1280) & (F.col("decoded_height") == 720)
    why = F.when(~configured, "not_configured").when(~F.coalesce(expected, F.lit(False)), "resolution_mismatch").when(F.col("resolution_changes") > 0, "not_fixed").otherwise("enabled")
    return last.groupBy(why.alias("zone_status")).agg(F.count(F.lit(1)).alias("n_sessions"))


def conflate_latest_frame(spark: SparkSession, folder: str) -> DataFrame:
    """The frame that each camera's trigger delivers, and what it drops."""
    return R.conflate(A.event_frames(spark, folder), ["camera_id"], "frame_number", "event_id")


def frame_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """received = processed + dropped per camera."""
    c = R.conflate(A.event_frames(spark, folder), ["camera_id"], "frame_number", "event_id")
    return c.groupBy("camera_id").agg(F.sum("received").alias("received"), F.count(F.lit(1)).alias("processed"), F.sum("dropped").alias("dropped"), (F.sum("received") == F.count(F.lit(1)) + F.sum("dropped")).alias("balanced"))


def read_failure_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of at least two failed reads of a camera."""
    return R.failure_runs(A.event_frames(spark, folder).select("camera_id", "event_id", "event_type"), ["camera_id"], "event_id", F.col("event_type") == "error", 2, Scratch(spark))


def resolution_changes(spark: SparkSession, folder: str) -> DataFrame:
    """T4: changes of a session's decoded size; after one, fixed geometry no longer holds."""
    rows = table(spark, folder, "rtsp_metrics").where("metric_id is not null").dropDuplicates(["metric_id"])
    seen = R.changes(rows, ["session_id"], ["snapshot_at", "metric_id"], F.concat_ws("x", F.col("decoded_width").cast("string"), F.col("decoded_height").cast("string")))
    return seen.groupBy("session_id").agg(F.sum(F.col("changed").cast("int")).alias("n_changes"), F.max("ever").alias("geometry_lost"))


def throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Frames processed per second of each session that ran."""
    s = table(spark, folder, "rtsp_metrics").groupBy("session_id").agg(F.max("frames_processed").alias("f"), F.max(F.when(~F.isnan("runtime_seconds"), F.col("runtime_seconds"))).alias("s"))
    return s.where("s > 0 and f is not null").select("session_id", F.round(F.col("f") / F.col("s"), 6).alias("frames_per_second"))


def status_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and distinct sessions per camera and state."""
    return table(spark, folder, "runtime_status").groupBy("camera_id", "state").agg(F.count_distinct("status_id").alias("n_records"), F.count_distinct("session_id").alias("n_sessions"))


def event_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Events per camera and 30-unit block of source time, the tumbling window of source groups."""
    e = table(spark, folder, "safety_events").where("source_timestamp_seconds is not null and not isnan(source_timestamp_seconds)")
    return e.groupBy("camera_id", F.floor(F.col("source_timestamp_seconds") / 30).alias("block")).agg(F.count_distinct("event_id").alias("n_events"))


QUERIES = {
    f.__name__: f
    for f in (
        recent_events_top50, audit_dedup_latest, audit_path_fallback, audit_details_parse, runtime_freshness, camera_zone_left_join, controls_overlay, zone_usability,
        conflate_latest_frame, frame_accounting, read_failure_runs, resolution_changes, throughput, status_summary, event_hours,
    )
}

_EV = "ev as (select event_id, event_type, concat('cam_', user_id % 5) camera_id, epoch_us(ts) // 21600000000 frame_number from events)"
_PARTS = "str_split(log_path, '/')"
_CONTEXT = f"""ctx as (select * replace (
  coalesce(camera_id, case when len({_PARTS}) >= 3 then {_PARTS}[1] end) as camera_id,
  coalesce(session_id, case when len({_PARTS}) >= 3 then {_PARTS}[2] when len({_PARTS}) = 2 then {_PARTS}[1] end) as session_id) from audit_log)"""
_AT = "epoch_us(try_cast(case when regexp_matches(trim({0}), '(Z|[+-]\\d\\d:?\\d\\d)$') then trim({0}) else trim({0}) || '+00:00' end as timestamptz))"
_CONF = f"{_EV}, conf as (select camera_id, frame_number, max(event_id) latest, count(*) received, count(*) - 1 dropped from ev group by 1, 2)"

SQL = {
    "recent_events_top50": f"""with s as (select *, round(coalesce(source_timestamp_seconds, epoch_us(created_at_utc) / 1e6, 0), 3) sort_key from safety_events where event_id is not null
  qualify row_number() over (partition by event_id order by ingested_at desc nulls last, status) = 1)
select event_id, camera_id, module_id, status, sort_key from s order by sort_key desc, event_id limit 50""",
    "audit_dedup_latest": f"""with {_CONTEXT}, d as (select audit_timestamp_utc, action, min(audit_id) audit_id from ctx group by audit_timestamp_utc, camera_id, session_id, event_id, action)
select audit_id, action, coalesce(audit_timestamp_utc, '') audit_timestamp_utc from d order by coalesce(audit_timestamp_utc, '') desc, audit_id limit 100""",
    "audit_path_fallback": f"with {_CONTEXT} select distinct audit_id, coalesce(camera_id, '?') camera_id, coalesce(session_id, '?') session_id from ctx",
    "audit_details_parse": """select action, count(*) n_rows, count(*) filter (where not json_valid(details)) n_malformed,
  count(case when json_valid(details) then json_extract_string(details, '$.track_id') end) n_with_track from audit_log where details is not null group by 1""",
    "runtime_freshness": f"""with s as (select camera_id, {_AT.format('updated_at_utc')} t from runtime_status),
a as (select camera_id, greatest(0.0, (epoch_us(timestamptz '{NOW}') - max(t)) / 1e6) age from s where t is not null group by 1)
select camera_id, round(age, 3) age_seconds, age > 30 is_stale from a""",
    "camera_zone_left_join": f"""with {_EV}, z as (select concat('cam_', c) camera_id, count(*) n, string_agg(name, ',' order by name) names
  from range(3) t(c), (values ('loading bay'), ('walkway'), ('press area')) v(name) group by 1)
select c.camera_id, coalesce(n, 0) zone_count, coalesce(names, '') zone_names, n is not null has_zone from (select distinct camera_id from ev) c left join z using (camera_id)""",
    "controls_overlay": """select p_partkey control_id, p_name label, coalesce(s_acctbal > 0, p_size > 10) enabled from part left join supplier on s_suppkey * 3 = p_partkey where p_partkey is not null""",
    "zone_usability": """with l as (select * from rtsp_metrics where metric_id is not null qualify row_number() over (partition by session_id order by snapshot_at desc, metric_id desc) = 1)
select case when not regexp_matches(camera_id, '0[0-9]$') then 'not_configured' when not coalesce(decoded_width = 1280 and decoded_height = 720, false) then 'resolution_mismatch'
  when resolution_changes > 0 then 'not_fixed' else 'enabled' end zone_status, count(*) n_sessions from l group by 1""",
    "conflate_latest_frame": f"with {_CONF} select * from conf",
    "frame_accounting": f"with {_CONF} select camera_id, cast(sum(received) as bigint) received, count(*) processed, cast(sum(dropped) as bigint) dropped, sum(received) = count(*) + sum(dropped) balanced from conf group by 1",
    "read_failure_runs": f"""with {_EV}, r as (select *, row_number() over (partition by camera_id order by event_id) - row_number() over (partition by camera_id, event_type = 'error' order by event_id) run from ev)
select camera_id, min(event_id) "first", max(event_id) "last", count(*) n_failed from r where event_type = 'error' group by camera_id, run having count(*) >= 2""",
    "resolution_changes": """with m as (select *, concat_ws('x', decoded_width, decoded_height) v from rtsp_metrics where metric_id is not null qualify row_number() over (partition by metric_id) = 1),
c as (select session_id, coalesce(v <> lag(v) over (partition by session_id order by snapshot_at, metric_id), false) changed from m)
select session_id, cast(sum(changed::int) as bigint) n_changes, bool_or(changed) geometry_lost from c group by 1""",
    "throughput": """with s as (select session_id, max(frames_processed) f, max(case when not isnan(runtime_seconds) then runtime_seconds end) s from rtsp_metrics group by 1)
select session_id, round(f / s, 6) frames_per_second from s where s > 0 and f is not null""",
    "status_summary": "select camera_id, state, count(distinct status_id) n_records, count(distinct session_id) n_sessions from runtime_status group by 1, 2",
    "event_hours": """select camera_id, cast(floor(source_timestamp_seconds / 30) as bigint) block, count(distinct event_id) n_events from safety_events
where source_timestamp_seconds is not null and not isnan(source_timestamp_seconds) group by 1, 2""",
}
