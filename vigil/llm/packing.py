"""Filling fixed-capacity containers with items.

Linear grouping: large items are ordered by length and cut into groups of equal cardinality; within a group lengths are
rounded up to its largest.  For these few lengths the configurations of a container are optimised by column generation,
which needs only the groups' lengths and sizes.  Actual documents then take the places of their group by rank, and
small items go best-fit into what is left, in shards of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.ordered import index_rows
from vigil.session import Scratch

GROUPS = 48
SMALL = 8  # an item of at most 1/SMALL of the capacity is small
SHARD = 40_000  # containers and small items of a best-fit shard, about

PLACED = "container_id string, item_id long, token_start long, n_tokens long"


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The filling of one container that is worth most."""
    most = capacity // int(sizes.min())
    value, chosen = np.zeros(capacity + 1), []
    for _ in range(most):
        grid = np.full((len(sizes), capacity + 1), -1.0)
        for g, s in enumerate(sizes):
            grid[g, s:] = value[: capacity + 1 - s] + worth[g]
        best = grid.argmax(0)
        top = grid[best, np.arange(capacity + 1)]
        better = top > value + 1e-12
        chosen.append(np.where(better, best, -1))
        if not better.any():
            break
        value = np.where(better, top, value)
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(chosen):
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(value[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(items of each size, how many containers) that hold exactly ``demand`` items of ``sizes`` in few containers.

    The linear relaxation is solved by column generation until the best configuration left out could no longer save half a
    container: a configuration worth v bounds the optimum by 1 / v of what is reached.  Demands are raised by different tiny amounts on
    the way, so that no step stands still.  Whole parts are kept and the rest is filled first-fit decreasing.
    """
    if not sizes:
        return []
    s, d = np.array(sizes, np.int64), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    raised = d + 1e-7 * (1 + np.arange(len(d)))
    while True:
        worth = np.linalg.solve(basis.T, np.ones(len(s)))
        value, column = _best_configuration(s, worth, capacity)
        if value <= 1 + 1e-7 or (worth @ d) * (1 - 1 / value) < 0.5:
            break
        x, w = np.linalg.solve(basis, raised), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(w > 1e-9, x / np.where(w > 1e-9, w, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.maximum(np.linalg.solve(basis, d), 0)
    whole = np.floor(x + 1e-9).astype(np.int64)
    left = np.array(demand, np.int64)
    plan: dict[tuple[int, ...], int] = {}
    for column, times in zip(basis.T.astype(np.int64), whole):
        times = int(min([times, *(left[column > 0] // column[column > 0])]))
        if times > 0:
            plan[tuple(column.tolist())] = plan.get(tuple(column.tolist()), 0) + times
            left -= column * times
    while left.any():
        room, column = capacity, np.zeros(len(s), np.int64)
        for g in np.argsort(-s, kind="stable"):
            column[g] = min(left[g], room // s[g])
            room -= column[g] * s[g]
        times = int((left[column > 0] // column[column > 0]).min())
        plan[tuple(column.tolist())] = plan.get(tuple(column.tolist()), 0) + times
        left -= column * times
    return sorted(plan.items())


def _places(bounds: list[int], plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Rank ranges of items and the configuration, and its places for the group, that each range fills."""
    low, config, each = [], [], []
    for g in range(len(bounds) - 1):
        at = bounds[g]
        for p, (column, times) in enumerate(plan):
            if column[g]:
                low.append(at), config.append(p), each.append(column[g])
                at += column[g] * times
    return np.array(low, np.int64), np.array(config, np.int64), np.array(each, np.int64)


def _best_fit(containers: list[tuple[str, int]], items: pd.DataFrame, capacity: int, prefix: str) -> pd.DataFrame:
    from bisect import bisect_left, insort

    by_room: dict[int, list[str]] = {}
    for name, room in containers:
        if room > 0:
            by_room.setdefault(room, []).append(name)
    rooms, opened, names = sorted(by_room), 0, []
    items = items.sort_values(["n_tokens", "item_id", "token_start"], ascending=[False, True, True])
    for size in items.n_tokens.tolist():
        i = bisect_left(rooms, size)
        if i < len(rooms):
            room = rooms[i]
            held = by_room[room]
            name = held.pop()
            if not held:
                del by_room[room], rooms[i]
        else:
            name, room = f"{prefix}{opened}", capacity
            opened += 1
        names.append(name)
        if room > size:
            if room - size not in by_room:
                by_room[room - size] = []
                insort(rooms, room - size)
            by_room[room - size].append(name)
    return pd.DataFrame({"container_id": np.array(names, object), **{c: items[c].to_numpy() for c in ("item_id", "token_start", "n_tokens")}})


def pack(items: DataFrame, item_id: str, size: str, capacity: int, scratch: Scratch | None = None) -> DataFrame:
    """(container_id, item_id, token_start, n_tokens): every item, or part of an oversized one, in a container.

    An item over ``capacity`` is divided into parts of exactly that size and a rest; no other item is divided.
    Items of size 0 or null need no room and come out with a null container; items must have distinct ids.
    An empty input gives no rows.
    """
    scratch = scratch or Scratch(items.sparkSession)
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    full = F.floor(F.col("size") / capacity)
    parts = rows.where("size > 0").select(
        "item_id", F.explode(F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), full), lambda k: F.struct((k * capacity).alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("size") - k * capacity).alias("n_tokens"))),
        )).alias("p"),
    ).select("item_id", "p.*").where("n_tokens > 0")
    parts = scratch.save(parts)
    empty = rows.where("size <= 0").select(F.lit(None).cast("string").alias("container_id"), "item_id", F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("n_tokens"))
    exact = parts.where(F.col("n_tokens") == capacity).select(F.format_string("full-%d-%d", "item_id", "token_start").alias("container_id"), "item_id", "token_start", "n_tokens")
    large = index_rows(parts.where((F.col("n_tokens") < capacity) & (F.col("n_tokens") * SMALL > capacity)), ["n_tokens", "item_id", "token_start"], scratch, "rank")
    # at most ``capacity`` rows: lengths are whole numbers below it
    histogram = sorted((r.n_tokens, r.n) for r in large.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in histogram)
    groups = min(GROUPS, total)
    bounds = [total * g // groups for g in range(groups + 1)] if groups else [0]
    upto, lengths = np.cumsum([n for _, n in histogram]), [s for s, _ in histogram]
    rounded = [lengths[int(np.searchsorted(upto, b, side="left"))] for b in bounds[1:]]
    plan = configurations(rounded, [b - a for a, b in zip(bounds, bounds[1:])], capacity)
    low, config, each = _places(bounds, plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            at = np.searchsorted(low, rank, side="right") - 1
            copy = (rank - low[at]) // each[at]
            names = [f"conf-{p}-{c}" for p, c in zip(config[at].tolist(), copy.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[b.column(b.schema.get_field_index(c)) for c in ("item_id", "token_start", "n_tokens")]], names=["container_id", "item_id", "token_start", "n_tokens"])

    placed = scratch.save(large.select("item_id", "token_start", "n_tokens", "rank").mapInArrow(place, PLACED))
    small = parts.where(F.col("n_tokens") * SMALL <= capacity)
    shards = max(1, scratch.count(parts) // SHARD)
    rooms = placed.groupBy("container_id").agg((F.lit(capacity) - F.sum("n_tokens")).alias("room")).withColumn("shard", F.pmod(F.xxhash64("container_id"), F.lit(shards)))
    dealt = small.withColumn("deal", F.pmod(F.xxhash64("item_id", "token_start"), F.lit(shards)))

    def fit(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("container_id")
        return _best_fit(list(zip(left.container_id.tolist(), left.room.tolist())), right, capacity, f"rest-{key[0]}-")

    fitted = rooms.groupBy("shard").cogroup(dealt.groupBy("deal")).applyInPandas(fit, PLACED)
    return exact.unionByName(placed).unionByName(fitted).unionByName(empty)


def fill_report(packed: DataFrame, by: str = "limit_tokens") -> DataFrame:
    """Per limit: containers, tokens in them, the least number of containers that could do, and the share filled."""
    one = packed.where("container_id is not null").groupBy(by, "container_id").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("n"))
    return one.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_items"), F.sum("held").alias("n_tokens"), F.max("held").alias("fullest"),
        F.ceil(F.sum("held") / F.first(F.col(by))).alias("least_containers"), (F.sum("held") / (F.count(F.lit(1)) * F.first(F.col(by)))).alias("filled"),
    )
