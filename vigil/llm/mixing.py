"""Mixing sources to target weights.

The documents of a source, in a seeded order, form one stream of tokens that is cut into blocks of fixed length.  Each
output shard draws how many of its slots go to each source from a multinomial distribution; slots that a source got
beyond its number of slots, spread evenly over its draws, are redrawn among the sources that lack some.  The slots of a source
are numbered through all shards; slot j takes, in pass j // blocks over the source, the block that a pseudorandom
permutation of that pass gives for j % blocks; a source's last block, if it is short, comes last.  So a block occurs at most once a pass and a document at most ``max_repeats``
times.  Slots and blocks meet in a join on (source, block).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.documents import source_name
from vigil.session import Scratch

BLOCK = 128
SHARD = 256  # slots of an output shard
TOLERANCE = 0.01  # of all slots that a source may have over its share because others can't serve theirs


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def targets(table: DataFrame) -> list[Target]:
    """The target table, which is configuration of fixed size; a source named twice has its shares added."""
    out: dict[str, Target] = {}
    for r in table.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0").collect():
        old = out.get(r.source, Target(r.source, 0.0, 0))
        out[r.source] = Target(r.source, old.share + r.target_share, max(old.repeats, r.max_repeats or 0))
    return sorted(out.values(), key=lambda t: t.source)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """The places of ``index`` in the permutation of range(n) that ``key`` (one a row) names: a Feistel network walked into range."""
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    out, todo = np.asarray(index, np.uint64).copy(), np.arange(len(index))
    key = np.broadcast_to(np.asarray(key, np.uint64), out.shape)
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & low
            for r in range(4):
                left, right = right, left ^ (_mix(right + key[todo] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(r + 1)) & low)
            out[todo] = (left << shift) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _served(share: dict[str, float], most: dict[str, int], over: float, slots: float) -> dict[str, float]:
    """Slots that sources take of ``slots`` if each may have ``over`` more than its share, as far as it can serve them."""
    return {s: max(0.0, min(most[s], (w + over) * slots)) for s, w in share.items()}


def slots_by_source(share: dict[str, float], most: dict[str, int], wanted: int | None = None, tolerance: float = TOLERANCE) -> dict[str, int]:
    """Slots of each source: its share of all slots plus one and the same excess, but no more than ``most``.

    What scarce and missing sources leave of their shares (``share`` may sum to less than 1) is spread evenly over the others, which keeps
    the largest excess over a share as small as it can be.  The total is ``wanted``, as far as the sources can serve it, or the
    largest for which the excess is at most ``tolerance``, on top of what missing sources alone make it.
    """
    if not share:
        return {}
    missing = max(0.0, 1 - sum(share.values())) / len(share)
    allowed = tolerance if missing < tolerance else missing + tolerance
    if wanted is None:
        low, high = 0, sum(most.values())
        while low < high:  # the share that can be served falls as the total grows
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(_served(share, most, allowed, middle).values()) >= middle - 1e-6 else (low, middle - 1)
        total = low
    else:
        total = min(wanted, sum(most.values()))
    if total <= 0:
        return {s: 0 for s in share}
    less, more = -1.0, 1.0
    for _ in range(100):
        over = (less + more) / 2
        less, more = (over, more) if sum(_served(share, most, over, total).values()) < total else (less, over)
    exact = _served(share, most, more, total)
    slots = {s: math.floor(x + 1e-9) for s, x in exact.items()}
    order = sorted(share, key=lambda s: (slots[s] - exact[s], s))
    while sum(slots.values()) < total:
        for s in order:
            if sum(slots.values()) < total and slots[s] < most[s]:
                slots[s] += 1
    while sum(slots.values()) > total:
        slots[max(slots, key=lambda s: (slots[s] - exact[s], s))] -= 1
    return slots


def _running(sources: list[str]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of the source up to and with the row, within the partition."""
        held = dict.fromkeys(sources, 0)
        for b in batches:
            pdf = b.to_pandas()
            pdf["upto"] = pdf.groupby("source")["n_tokens"].cumsum() + pdf["source"].map(held)
            for s, x in pdf.groupby("source")["upto"].max().items():
                held[s] = int(x)
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    return add


@dataclass
class Mixture:
    drawn: DataFrame  # shard, slot, source, pass, block, doc_id, token_start, token_end
    report: DataFrame


def mix(sizes: DataFrame, wanted: list[Target], scratch: Scratch, total_tokens: int | None = None, seed: int = 0, tolerance: float = TOLERANCE) -> Mixture:
    """Draw from documents (doc_id, source, n_tokens), one row a document, toward the shares ``wanted``.

    The total is ``total_tokens``, or the largest for which no source gets more than ``tolerance`` over its target because others can't
    serve theirs.  A source that can't serve its share is used up to its repeats; what it leaves, and shares of sources without
    tokens or repeats, are spread evenly over the others (``feasible_share``).  Documents of sources without target, and empty ones,
    are not drawn.
    """
    spark = sizes.sparkSession
    names = [t.source for t in wanted]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sizes.where(F.col("source").isin(names) & (F.col("n_tokens") > 0)).select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"), F.xxhash64("doc_id", F.lit(seed)).alias("h"))
    order = ["source", "h", "doc_id"]
    placed = scratch.save(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(_running(names), "doc_id long, source string, n_tokens long, h long, upto long")
        .withColumn("part", F.spark_partition_id())
    )
    # one row a partition and source that occurs in it
    sums = sorted((r.source, r.part, r.n) for r in placed.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")).collect())
    held, offsets = {}, []
    for source, part, n in sums:
        offsets.append((source, part, held.get(source, 0)))
        held[source] = held.get(source, 0) + n
    blocks = {s: -(-n // BLOCK) for s, n in held.items()}
    usable = [t for t in wanted if held.get(t.source) and t.repeats > 0]
    whole = sum(t.share for t in wanted)
    share = {t.source: t.share / whole for t in usable}
    repeats = {t.source: t.repeats for t in usable}
    due = slots_by_source(share, {s: blocks[s] * repeats[s] for s in share}, None if total_tokens is None else -(-total_tokens // BLOCK), tolerance)
    slots = sum(due.values())
    picked = sorted(share)
    weights = np.array([due[s] / max(1, slots) for s in picked])
    shards = -(-slots // SHARD)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of each shard's slots by source, and how many the partition gave the source before."""
        from pyspark import TaskContext

        before, part = np.zeros(len(picked), np.int64), TaskContext.get().partitionId()
        for pdf in batches:
            out = []
            for shard in pdf.id.tolist():
                n = min(SHARD, slots - shard * SHARD)
                counts = np.random.default_rng((seed, shard)).multinomial(n, weights)
                out += [(part, shard, k, int(before[k]), int(c), int(f)) for k, (c, f) in enumerate(zip(counts, np.cumsum(counts) - counts)) if c]
                before += counts
            yield pd.DataFrame(out, columns=["part", "shard", "k", "before", "n", "first"])

    draws = scratch.save(spark.range(0, shards, 1, max(1, min(parts, shards))).mapInPandas(draw, "part int, shard long, k int, before long, n int, first int"))
    given: dict[int, int] = {}
    start: dict[tuple[int, int], int] = {}
    for part, k, n in sorted((r.part, r.k, r.n) for r in draws.groupBy("part", "k").agg(F.sum("n").alias("n")).collect()):
        start[part, k] = given.get(k, 0)
        given[k] = given.get(k, 0) + n
    drawn_slots = np.array([given.get(k, 0) for k in range(len(picked))], np.int64)
    more = drawn_slots - np.array([due[s] for s in picked], np.int64)
    over, lack = np.maximum(more, 0), np.cumsum(np.maximum(-more, 0))  # as many in all
    over_first = np.cumsum(over) - over

    def settle(k: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source and number of the slots after those beyond a source's number have gone to the sources that lack some."""
        gone = j * over[k] // drawn_slots[k]  # of the source's slots before this one
        moved = np.flatnonzero((j + 1) * over[k] // drawn_slots[k] > gone)
        k_new, j_new = k.copy(), j - gone
        if len(moved):
            i = permuted(over_first[k[moved]] + gone[moved], int(over.sum()), _mix(np.array([seed + 1], np.uint64)))
            to = np.searchsorted(lack, i, side="right")
            k_new[moved], j_new[moved] = to, drawn_slots[to] + i - (lack[to] - np.maximum(-more, 0)[to])
        return k_new, j_new

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf.n.to_numpy()
            row = np.repeat(np.arange(len(pdf)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            k, shard = pdf.k.to_numpy()[row], pdf.shard.to_numpy()[row]
            base = np.array([start[p, q] for p, q in zip(pdf.part.tolist(), pdf.k.tolist())], np.int64)
            k, j = settle(k, base[row] + pdf.before.to_numpy()[row] + step)
            turn, block = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            for q in np.unique(k):
                own = k == q
                count = blocks[picked[q]]
                turn[own] = j[own] // count
                with np.errstate(over="ignore"):
                    key = _mix(turn[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int(q) * 1_000_003 + seed))
                place, whole = j[own] % count, held[picked[q]] // BLOCK
                inner = place < whole  # a short last block stays last
                place[inner] = permuted(place[inner], whole, key[inner])
                block[own] = place
            slot, key = pdf["first"].to_numpy()[row] + step, _mix(shard.astype(np.uint64) + np.uint64(seed))
            size = np.minimum(SHARD, slots - shard * SHARD)
            for n in np.unique(size):  # the last shard may be smaller
                own = size == n
                slot[own] = permuted(slot[own], int(n), key[own])
            yield pd.DataFrame({"shard": shard, "slot": slot, "source": np.array(picked, object)[k], "pass": turn, "block": block})

    chosen = draws.mapInPandas(expand, "shard long, slot long, source string, pass long, block long")
    shift = F.broadcast(spark.createDataFrame(offsets, "source string, part int, _offset long"))
    first = F.col("_offset") + F.col("upto") - F.col("n_tokens")
    pieces = placed.where(F.col("source").isin(picked)).join(shift, ["source", "part"]).select("doc_id", "source", first.alias("a"), (first + F.col("n_tokens")).alias("z")).select(
        "doc_id", "source", "a", "z", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("z") - 1) / BLOCK))).alias("block")
    ).select("doc_id", "source", "block", (F.greatest(F.col("block") * BLOCK, "a") - F.col("a")).alias("token_start"), (F.least((F.col("block") + 1) * BLOCK, "z") - F.col("a")).alias("token_end"))
    # slots come out of few rows of draws, which the planner would take for a small side
    drawn = scratch.save(chosen.join(pieces.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "pass", "block", "doc_id", "token_start", "token_end"))
    moved = {s: -int(more[k]) for k, s in enumerate(picked)}  # slots redrawn to the source, below 0: away from it
    goal = F.broadcast(spark.createDataFrame([(t.source, t.share, due.get(t.source, 0) / max(1, slots), t.repeats, held.get(t.source, 0), moved.get(t.source, 0)) for t in wanted], "source string, target_share double, feasible_share double, max_repeats int, available_tokens long, slots_moved long"))
    used = drawn.groupBy("source").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("_n"), F.max("pass").alias("_p"))
    total = F.broadcast(used.agg(F.sum("_n").alias("_all")))
    n = F.coalesce("_n", F.lit(0))
    reached = F.coalesce(n / F.col("_all"), F.lit(0.0))
    report = goal.join(used, "source", "left").crossJoin(total).select(
        "source", "target_share", "feasible_share", "max_repeats", "available_tokens", n.alias("n_tokens"), reached.alias("share"),
        F.greatest(F.col("target_share") - reached, F.lit(0.0)).alias("shortfall"), (F.coalesce("_p", F.lit(-1)) + 1).cast("int").alias("repeats"), "slots_moved"
    )
    return Mixture(drawn, report)


def by_document(drawn: DataFrame) -> DataFrame:
    """(source, doc_id, repeats, n_tokens): the chosen documents, in how many passes, and their tokens in all."""
    return drawn.groupBy("source", "doc_id").agg(F.count_distinct("pass").alias("repeats"), F.sum(F.col("token_end") - F.col("token_start")).alias("n_tokens"))
