"""References to records that do not exist."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import canonical_id, strip
from vigil.operators.skew import hot_keys, skew_join

HEAVY = 1 / 10_000  # share of all references from which on a key is heavy


def references(df: DataFrame, table: str, row_id: str, key: str, arrived: str, period: str = "yyyy-MM") -> DataFrame:
    """(ref_table, ref_id, ref_key, ref_period) of a table's references, one row a row id.

    A record delivered more than once counts in its first delivery.  Rows whose key is null or blank refer to
    nothing and are left out; a null arrival gives the period ``unknown``.  Rows without row id can't be
    told apart, so each distinct (key, period) of them counts once.
    """
    rows = df.select(
        F.lit(table).alias("ref_table"), F.col(row_id).alias("ref_id"), canonical_id(F.col(key)).alias("ref_key"),
        F.coalesce(F.date_format(arrived, period), F.lit("unknown")).alias("ref_period"), F.col(arrived).alias("_arrived"),
    )
    first = rows.where("ref_id is not null").groupBy("ref_table", "ref_id").agg(
        F.min(F.struct(F.col("_arrived").isNull(), "_arrived", "ref_key", "ref_period")).alias("r")
    ).select("ref_table", "ref_id", "r.ref_key", "r.ref_period")
    nameless = rows.where("ref_id is null").select("ref_table", "ref_id", "ref_key", "ref_period").distinct()
    return first.unionByName(nameless).where("ref_key is not null")


def living(records: DataFrame, key: str, status: str | None = None, newest: str | None = None, gone: str = "deleted") -> DataFrame:
    """(ref_key) of the records that exist: those whose newest row doesn't have the status ``gone``.

    Of rows equally new, one that exists wins; a null time is older than any other; a null status exists.
    """
    rows = records.select(
        canonical_id(F.col(key)).alias("ref_key"),
        (F.col(newest) if newest else F.lit(0)).alias("_at"),
        (~F.coalesce(F.lower(strip(F.col(status))) == gone, F.lit(False)) if status else F.lit(True)).alias("_lives"),
    ).where("ref_key is not null")
    return rows.groupBy("ref_key").agg(F.max(F.struct("_at", "_lives")).alias("r")).where("r._lives").select("ref_key")


def heavy(total: int) -> int:
    """The least references of a heavy key: HEAVY of all of them."""
    return max(2, math.ceil(total * HEAVY))


def orphan_keys(refs: DataFrame, alive: DataFrame, total: int, hot: DataFrame | None = None) -> DataFrame:
    """(ref_table, ref_key, ref_period, n_refs) of references whose key is not among ``alive``; ``total`` is the number of references.

    References are counted per key and period first, so a hot key shrinks to one row a period before anything
    moves.  The heavy keys (at most ``skew.MOST_HOT``) are checked by broadcasts, the others by a shuffled
    anti-join; both give counts of orphans, which are put together.
    """
    counts = refs.groupBy("ref_table", "ref_key", "ref_period").agg(F.count(F.lit(1)).alias("n_refs"))
    hot = F.broadcast(hot_keys(counts, "ref_key", rows="n_refs", at_least=heavy(total)) if hot is None else hot)
    found = F.broadcast(alive.join(hot, "ref_key", "left_semi"))
    weighty = counts.join(hot, "ref_key", "left_semi").join(found, "ref_key", "left_anti")
    light = counts.join(hot, "ref_key", "left_anti").join(alive, "ref_key", "left_anti")
    return weighty.unionByName(light)


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per table and period: references, orphan references and distinct orphan keys.  Empty input gives no rows."""
    total = refs.groupBy("ref_table", "ref_period").agg(F.count(F.lit(1)).alias("n_refs"))
    lost = orphans.groupBy("ref_table", "ref_period").agg(F.sum("n_refs").alias("n_orphans"), F.count(F.lit(1)).alias("n_orphan_keys"))
    return total.join(lost, ["ref_table", "ref_period"], "left").select(
        "ref_table", "ref_period", "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.coalesce("n_orphan_keys", F.lit(0)).alias("n_orphan_keys")
    )


def orphan_rows(refs: DataFrame, orphans: DataFrame, total: int) -> DataFrame:
    """(ref_table, ref_id) of the references behind ``orphans``; hot keys by broadcast, the rest shuffled."""
    keys = orphans.select("ref_key").distinct()
    return skew_join(refs, keys, "ref_key", "left_semi", hot_keys(orphans, "ref_key", rows="n_refs", at_least=heavy(total))).select("ref_table", "ref_id")
