"""Positions and running totals in a global order, without one task ever seeing a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import Scratch

_LOW = (1 << 33) - 1  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def index_rows(df: DataFrame, order: list[str], scratch: Scratch, name: str = "row_index", partitions: int | None = None) -> DataFrame:
    """``df`` with its 0-based position in the order of the columns ``order``, which must be a total order.

    Range partitions are sorted and written; only one count per partition goes to the driver.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.save(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    return with_offsets(placed, name)


def with_offsets(placed: DataFrame, name: str) -> DataFrame:
    """Turn ``_at`` (partition and place in it) of a saved, range-sorted table into a global position."""
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    start, before = {}, 0
    for p, n in sorted((r.p, r.n) for r in sizes):
        start[p], before = before, before + n
    return placed.withColumn(name, lookup(part, start) + F.col("_at").bitwiseAND(F.lit(_LOW))).drop("_at")


def lookup(key: Column, values: dict[int, int]) -> Column:
    """A literal map from partition numbers to offsets; its size is the number of partitions."""
    if not values:
        return F.lit(0).cast("long")
    pairs = [F.lit(x).cast("long") for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key.cast("long"))


def runs(df: DataFrame, keys: list[str], order: str, flag: Column, scratch: Scratch, marks: int = 1) -> DataFrame:
    """Stretches of consecutive rows of a key that meet ``flag``: keys, ``first`` and ``last`` order values, ``n`` and ``marks``, the first few
    order values.

    Rows are sorted by range, so a key may lie in many tasks.  A task folds its rows in constant memory; stretches that touch the
    end of a task, at most two a task, are put together on the driver.  Keys are texts, ``order`` is a whole number, unique in its key.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(order).isNotNull()).select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], F.col(order).cast("long").alias("o"), F.coalesce(flag, F.lit(False)).alias("f"))
    schema = ", ".join(f"{k} string" for k in keys) + ", first long, last long, n long, marks array<long>, part int, begins boolean, ends boolean"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held, at_start, seen = TaskContext.get().partitionId(), None, True, False
        names = [*keys, "first", "last", "n", "marks", "part", "begins", "ends"]
        for pdf in batches:
            if not len(pdf):
                continue
            seen, out = True, []
            new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
            if held is not None:
                new[0] = tuple(pdf[keys].iloc[0]) != held[0]
            cut = new | (pdf.f != pdf.f.shift()).to_numpy()
            cut[0] = held is None or new[0] or not pdf.f.iloc[0]
            for _, g in pdf.groupby(cut.cumsum(), sort=False):
                if not g.f.iloc[0]:
                    if held is not None:
                        out.append((*held[0], *held[1:], False))
                    held, at_start = None, False
                    continue
                o = g.o.tolist()
                if held is not None and tuple(g[keys].iloc[0]) == held[0]:
                    held = (held[0], held[1], o[-1], held[3] + len(o), (held[4] + o[:marks])[:marks], part, held[6])
                    continue
                if held is not None:
                    out.append((*held[0], *held[1:], False))
                held = (tuple(g[keys].iloc[0]), o[0], o[-1], len(o), o[:marks], part, at_start)
                at_start = False
            yield pd.DataFrame(out, columns=names)
        if held is not None:
            yield pd.DataFrame([(*held[0], *held[1:], True)], columns=names)
        elif seen:  # tells that the task had rows
            yield pd.DataFrame([(*[""] * len(keys), 0, 0, 0, [], part, True, False)], columns=names)

    made = scratch.save(rows.repartitionByRange(parts, *keys, "o").sortWithinPartitions(*keys, "o").mapInPandas(fold, schema))
    edge = made.where("begins or ends").orderBy("part", F.desc("begins"), F.desc("n")).collect()  # at most three a task
    parts_seen = {p: i for i, p in enumerate(sorted({r.part for r in edge}))}
    joined: list[list] = []
    for r in edge:
        if not r.n:
            continue
        key = [r[k] for k in keys]
        last = joined[-1] if joined else None
        if last and r.begins and last[-2] and last[: len(keys)] == key and parts_seen[r.part] == parts_seen[last[-1]] + 1:
            last[len(keys) + 1], last[len(keys) + 2] = r.last, last[len(keys) + 2] + r.n
            last[len(keys) + 3] = (last[len(keys) + 3] + list(r.marks))[:marks]
            last[-2], last[-1] = r.ends, r.part
        else:
            joined.append([*key, r.first, r.last, r.n, list(r.marks), r.ends, r.part])
    columns = [*keys, "first", "last", "n", "marks"]
    put = spark.createDataFrame([j[:-2] for j in joined], ", ".join(f"{k} string" for k in keys) + ", first long, last long, n long, marks array<long>")
    return made.where("not (begins or ends)").select(*columns).unionByName(put)
