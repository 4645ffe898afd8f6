"""Event, audit and status records: read models, ingestion accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.operators.ordered import runs
from vigil.operators.skew import skew_join
from vigil.session import Scratch


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def path_context(path: Column) -> tuple[Column, Column]:
    """Camera and session that a path below the log root tells: both from depth three on, the session alone at depth two."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(0))), F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).when(F.size(parts) == 2, F.get(parts, F.lit(0)))


def with_context(audit: DataFrame) -> DataFrame:
    """Audit rows whose missing camera or session comes from their log's path."""
    camera, session = path_context(F.col("log_path"))
    return audit.withColumn("camera_id", F.coalesce("camera_id", camera)).withColumn("session_id", F.coalesce("session_id", session))


def conflate(rows: DataFrame, keys: list[str], trigger: str, sequence: str) -> DataFrame:
    """Latest wins: of a key's rows in a trigger the last is processed, the others are dropped and counted."""
    return rows.groupBy(*keys, trigger).agg(F.max(sequence).alias("latest"), F.count(F.lit(1)).alias("received")).withColumn("dropped", F.col("received") - 1)


def failure_runs(rows: DataFrame, keys: list[str], order: str, failed: Column, threshold: int, scratch: Scratch) -> DataFrame:
    """Runs of consecutive failures of at least ``threshold``: each would have made the reader connect again."""
    found = runs(rows, keys, order, failed, scratch)
    return found.where(F.col("n") >= threshold).select(*keys, "first", "last", F.col("n").alias("n_failed"))


BACKOFF = (1.0, 2.0, 4.0, 8.0, 10.0)  # fixed values: seconds to wait before the next attempt, the last one from then on
MOST_FAILURES = 5


def lifecycle(rows: DataFrame, key: str, order: str, failed: Column, scratch: Scratch, backoff: tuple[float, ...] = BACKOFF, most: int = MOST_FAILURES) -> DataFrame:
    """(key, n_failures, n_waits, seconds_waited, terminal_at) of each reader that failed: a good row resets the backoff, and
    ``most`` failures in a row end the reader, after which nothing counts; ``terminal_at`` is null for a reader that went on.
    """
    found = runs(rows, [key], order, failed, scratch, most)
    ended = F.when(F.col("n") >= most, F.get("marks", F.lit(most - 1)))
    terminal = found.groupBy(key).agg(F.min(ended).alias("terminal_at"))
    live = found.join(terminal, key).where("terminal_at is null or first <= terminal_at")
    n = F.least(F.col("n"), F.lit(most))
    waits = n - F.when(F.col("n") >= most, 1).otherwise(0)  # after the last failure nobody waits
    total = F.lit(0.0)
    for i in range(most):
        total = total + F.when(waits > i, backoff[min(i, len(backoff) - 1)]).otherwise(0.0)
    return live.select(key, "terminal_at", n.alias("n"), waits.alias("w"), total.alias("s")).groupBy(key).agg(
        F.sum("n").alias("n_failures"), F.sum("w").alias("n_waits"), F.sum("s").alias("seconds_waited"), F.min("terminal_at").alias("terminal_at")
    )


def snapshot(rows: DataFrame, key: str, order: str, at: str, failed: Column) -> DataFrame:
    """Counters of each reader as they stand at its last row: frames, failed reads, those in a row at the end, seconds to the first frame and in all.

    ``at`` is in microseconds.
    """
    marked = rows.select(key, F.col(order).alias("_o"), F.col(at).alias("_t"), F.coalesce(failed, F.lit(False)).alias("_f"))
    good = F.when(~F.col("_f"), F.col("_o"))
    one = marked.groupBy(key).agg(
        F.count_if(~F.col("_f")).alias("frames_received"), F.count_if("_f").alias("failed_reads"), F.max(good).alias("_last"), F.min("_t").alias("_a"), F.max("_t").alias("_z"), F.min(F.when(~F.col("_f"), F.col("_t"))).alias("_first")
    )
    tail = skew_join(marked.where("_f"), one.select(key, "_last"), key).where("_last is null or _o > _last").groupBy(key).agg(F.count(F.lit(1)).alias("consecutive_failed_reads"))
    return one.join(tail, key, "left").select(
        key, "frames_received", "failed_reads", F.coalesce("consecutive_failed_reads", F.lit(0)).alias("consecutive_failed_reads"),
        ((F.col("_first") - F.col("_a")) / 1e6).alias("time_to_first_frame"), ((F.col("_z") - F.col("_a")) / 1e6).alias("runtime_seconds"),
    )


def finite_run(rows: DataFrame, key: str, at: str, failed: Column, duration: float, first_frame: float) -> DataFrame:
    """(key, n_frames, stopped): frames of each reader within ``duration`` seconds of its start, none if the first comes later than
    ``first_frame`` seconds; why the run stopped.  ``at`` is in microseconds."""
    starts = rows.groupBy(key).agg(F.min(at).alias("_a"), F.max(at).alias("_z"), F.min(F.when(~failed, F.col(at))).alias("_f"))
    within = skew_join(rows, starts, key).where(~failed & (F.col(at) <= F.col("_a") + duration * 1e6)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    late = F.col("_f").isNull() | (F.col("_f") > F.col("_a") + first_frame * 1e6)
    return starts.join(within, key, "left").select(
        key, F.when(late, 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n_frames"),
        F.when(late, "no first frame").when(F.col("_z") > F.col("_a") + duration * 1e6, "duration").otherwise("end of source").alias("stopped"),
    )


def changes(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Each row with whether ``value`` differs from the last one known before it, and whether it ever did so far."""
    w = W.partitionBy(*keys).orderBy(*order)
    seen = rows.withColumn("_v", value)
    before = F.last("_v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    changed = seen.withColumn("changed", F.coalesce(F.col("_v") != before, F.lit(False)))
    return changed.withColumn("ever", F.max("changed").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_v")
