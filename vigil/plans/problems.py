"""Queries for the general training-data problems (2 and 5) and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import references as R
from vigil.operators import spikes as S
from vigil.session import Scratch, table


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    audit, evidence, events = (table(spark, folder, t) for t in ("audit_log", "evidence_artifacts", "safety_events"))
    refs = R.references(audit, "audit_log", "audit_id", "event_id", "ingested_at").unionByName(
        R.references(evidence, "evidence_artifacts", "evidence_id", "event_id", "saved_at")
    )
    scratch = Scratch(spark)
    refs, alive = scratch.save(refs), scratch.save(R.living(events, "event_id", "status", "ingested_at"))
    total = scratch.count(refs)
    return refs, scratch.save(R.orphan_keys(refs, alive, total)), total


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """References of audit_log and evidence_artifacts that lead to no event."""
    return R.orphan_rows(*_references(spark, folder))


def p2_orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    """References and orphans per table and month of arrival."""
    return R.orphan_report(*_references(spark, folder)[:2])


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    return S.flagged(S.camera_readings(table(spark, folder, "runtime_status"), table(spark, folder, "rtsp_metrics")), S.LIMITS)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that cannot be right for their camera."""
    return _flagged(spark, folder).select("source_table", "row_id", "field_name")


def p5_flag_report(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged readings per camera, field and reason."""
    return _flagged(spark, folder).groupBy("source_table", "field_name", "camera_id", "reason").agg(F.count(F.lit(1)).alias("n_flagged"))


QUERIES = {f.__name__: f for f in (p2_found, p2_orphan_report, p5_found, p5_flag_report)}

_NORMAL = "nullif(translate(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '-', '_'), '')"
_REFS = f"""
refs as (
  select * from (
    select 'audit_log' ref_table, audit_id ref_id, {_NORMAL.format('event_id')} ref_key,
      coalesce(strftime(ingested_at, '%Y-%m'), 'unknown') ref_period
    from audit_log qualify row_number() over (partition by audit_id order by ingested_at nulls last) = 1
    union all
    select 'evidence_artifacts', evidence_id, {_NORMAL.format('event_id')}, coalesce(strftime(saved_at, '%Y-%m'), 'unknown')
    from evidence_artifacts qualify row_number() over (partition by evidence_id order by saved_at nulls last) = 1
  ) where ref_key is not null),
alive as (
  select ref_key from (
    select {_NORMAL.format('event_id')} ref_key, status from safety_events
    qualify row_number() over (partition by {_NORMAL.format('event_id')} order by ingested_at desc nulls last) = 1
  ) where lower(trim(status)) is distinct from 'deleted'),
orphans as (select * from refs where ref_key not in (select ref_key from alive where ref_key is not null))
"""
SQL = {
    "p2_found": f"with {_REFS} select ref_table, ref_id from orphans",
    "p2_orphan_report": f"""with {_REFS}
select r.ref_table, r.ref_period, count(*) n_refs, count(o.ref_key) n_orphans, count(distinct o.ref_key) n_orphan_keys
from refs r left join orphans o on o.ref_table = r.ref_table and o.ref_id = r.ref_id group by 1, 2""",
}


def _flag_sql(rounds: int = 8) -> str:
    """The verdicts on readings as SQL, with rounds written out; enough of them for tables whose rounds end by then."""
    at = "epoch_us(try_cast(case when regexp_matches(trim({0}), '(Z|[+-]\\d\\d:?\\d\\d)$') then trim({0}) else trim({0}) || '+00:00' end as timestamptz))".format("updated_at_utc")
    series = "source_table, field_name, camera_id, session_id"
    status = "coalesce(camera_id, '') camera_id, coalesce(session_id, '') session_id, status_id row_id, coalesce({0}, epoch_us(received_at)) moment, coalesce(lower(trim(state)) = 'running', false) eligible".format(at)
    w = f"over (partition by {series} order by pos rows between unbounded preceding and 1 preceding)"
    v = f"over (partition by {series} order by pos rows between 1 following and unbounded following)"
    sides = f"(list(struct_pack(x := \"value\", p := pos)) filter (good) {w})[-{S.SIDE}:] b, (list(struct_pack(x := \"value\", p := pos)) filter (good) {v})[:{S.SIDE}] a"
    level = "list_aggregate(list_transform({0}, lambda q: q.x), 'median')"
    levels = f"{level.format('b')} lb, {level.format('a')} la"
    clip = f"greatest(-{S.CLIP} * spread, least({S.CLIP} * spread, {{0}}))"
    ctes = [f"""s as (select * from runtime_status where status_id is not null qualify row_number() over (partition by status_id order by received_at nulls first) = 1),
m as (select * from rtsp_metrics where metric_id is not null qualify row_number() over (partition by metric_id order by snapshot_at nulls first) = 1),
raw as (
  select 'runtime_status' source_table, 'processing_fps' field_name, {status}, processing_fps::double "value", null::double bound from s where processing_fps is not null
  union all select 'runtime_status', 'frames_dropped', {status}, frames_dropped::double, frames_received::double from s where frames_dropped is not null
  union all select 'rtsp_metrics', 'reported_source_fps', coalesce(camera_id, ''), coalesce(session_id, ''), metric_id, epoch_us(snapshot_at), true, reported_source_fps::double, null from m where reported_source_fps is not null),
placed as (select *, row_number() over (partition by {series} order by moment nulls first, row_id) pos from raw),
stepped as (select *, abs("value" - lag("value") over o) s1, abs("value" - lag("value", 2) over o) s2 from placed window o as (partition by {series} order by pos)),
usual as (select source_table, field_name, camera_id, quantile_disc(s1, 0.5) filter (where isfinite(s1)) spread, quantile_disc(s2, 0.5) filter (where isfinite(s2)) spread2 from stepped group by 1, 2, 3),
known as materialized (
  select p.*, coalesce(spread, 0) spread, case when spread > 0 then greatest(-{S.PHI}, least({S.PHI}, coalesce(pow(spread2 / spread, 2) - 1, 0))) else 0 end phi,
    not isfinite("value") or "value" < 0 or (field_name <> 'frames_dropped' and ("value" > 240 or (field_name = 'reported_source_fps' and "value" = 0))) or (field_name = 'frames_dropped' and coalesce("value" > bound, false)) bad,
    {S.TIMES} * coalesce(spread, 0) + 1e-9 * greatest(1, case when isfinite("value") then abs("value") else 0 end) allow
  from placed p join usual using (source_table, field_name, camera_id)),
rate0 as materialized (select *, not bad good from known where field_name <> 'frames_dropped'),
count0 as materialized (select *, not bad good from known where field_name = 'frames_dropped')"""]
    for r in range(rounds):
        ctes.append(f"""rate{r + 1} as materialized (
  select * exclude (a, b, lb, la, good), good and not coalesce(len(b) > 0 and len(a) > 0
    and abs("value" - (lb + pow(phi, pos - b[-1].p) * {clip.format('b[-1].x - lb')})) > allow and abs("value" - (la + pow(phi, a[1].p - pos) * {clip.format('a[1].x - la')})) > allow, false) good
  from (select *, {levels} from (select *, {sides} from rate{r})))""")
        wrong = 'coalesce("value" > la, false) or coalesce("value" < lb, false)'
        if r < rounds // 2:
            wrong = f"({wrong}) and coalesce(lb <= la, false)"
        ctes.append(f"""count{r + 1} as materialized (
  select * exclude (a, b, lb, la, good), good and not ({wrong}) good from (select *, {levels} from (select *, {sides} from count{r})))""")
    ctes.append(f"""ends as (select *, {levels}, b[-1].x xb, a[1].x xa from (select *, {sides} from rate{rounds})),
outliers as (select *, pos - row_number() over (partition by {series} order by pos) run from ends where not good and not bad),
spikes as (select o.source_table, o.field_name, o.row_id from outliers o join (
  select {series}, run, count(*) n, coalesce(bool_and(case when pos = lo then coalesce(abs(xb - lb) <= allow, false) end) and bool_and(case when pos = hi then coalesce(abs(xa - la) <= allow, false) end), false) held
  from (select *, min(pos) over (partition by {series}, run) lo, max(pos) over (partition by {series}, run) hi from outliers) group by {series}, run) g
  on o.source_table = g.source_table and o.field_name = g.field_name and o.camera_id = g.camera_id and o.session_id = g.session_id and o.run = g.run where held and n <= {S.LONGEST}),
turns as (select *, sum((coalesce("value" <> p, true))::int) over (partition by {series} order by pos) run from (select *, lag("value") over (partition by {series} order by pos) p from known)),
stuck as (select source_table, field_name, row_id from turns where spread > 0 and isfinite("value") qualify count(*) over (partition by {series}, run) >= {S.STUCK}),
verdicts as (
  select k.source_table, k.field_name, k.camera_id, k.row_id, case when k.bad then 'limit' when sp.row_id is not null then 'spike' when not c.good then 'disorder' when st.row_id is not null then 'stuck' end reason
  from known k left join spikes sp on sp.source_table = k.source_table and sp.field_name = k.field_name and sp.row_id = k.row_id
    left join count{rounds} c on c.source_table = k.source_table and c.field_name = k.field_name and c.row_id = k.row_id
    left join stuck st on st.source_table = k.source_table and st.field_name = k.field_name and st.row_id = k.row_id
  where k.eligible)""")
    return "with " + ",\n".join(ctes)


_FLAGS = _flag_sql()
SQL["p5_found"] = f"{_FLAGS} select source_table, row_id, field_name from verdicts where reason is not null"
SQL["p5_flag_report"] = f"{_FLAGS} select source_table, field_name, camera_id, reason, count(*) n_flagged from verdicts where reason is not null group by 1, 2, 3, 4"
