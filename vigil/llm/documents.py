"""Documents as the text operators take them: one row an id, sources in one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import strip
from vigil.session import Scratch

FEW = 100_000  # repeated ids that are broadcast at most; more are shuffled


def source_name(source: Column) -> Column:
    """Stripped, in lower case, blanks and hyphens as underscores; null for blank."""
    bare = F.regexp_replace(F.lower(strip(source)), r"[\s\-]+", "_")
    return F.when(bare != "", bare)


def once(rows: DataFrame, row_id: str, scratch: Scratch) -> DataFrame:
    """One row an id: of a record delivered more than once the smallest row.  Rows without id are left out.

    Only the ids are shuffled to find repeats; of the rows themselves only the repeated ones move.
    """
    repeated = scratch.save(rows.where(F.col(row_id).isNotNull()).groupBy(row_id).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(row_id))
    few = F.broadcast(repeated) if scratch.count(repeated) <= FEW else repeated
    columns = rows.columns
    single = rows.where(F.col(row_id).isNotNull()).join(few, row_id, "left_anti").select(*columns)
    again = rows.join(few, row_id, "left_semi").groupBy(row_id).agg(F.min(F.struct(*[c for c in columns if c != row_id])).alias("_r"))
    return single.unionByName(again.select(row_id, "_r.*").select(*columns))
