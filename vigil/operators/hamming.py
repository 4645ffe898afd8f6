"""Exact joins of 64-bit fingerprints within a Hamming radius, by equal blocks that are refined where they are crowded.

Among ``radius + keep`` blocks of bits at least ``keep`` are the same in two fingerprints within ``radius``.  So each pair
meets in a cell (mask, bits under the mask) of some choice of ``keep`` blocks.  A cell that would compare too many
pairs is not compared but split once more by blocks of the bits outside its mask, where the same argument holds; after
three steps at most 8 bits, or 256 different fingerprints, are left in a cell.  No cell is dropped or capped.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import Scratch

CROWDED = 1_000_000  # pairs compared in one cell before it is refined
STEPS = 3


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@lru_cache(maxsize=None)
def masks(outside: int, radius: int, keep: int) -> tuple[int, ...]:
    """All unions of ``keep`` of the ``radius + keep`` blocks of the bits that the mask ``outside`` leaves free."""
    free = [i for i in range(64) if not outside >> i & 1]
    parts = radius + keep
    blocks = [sum(1 << i for i in free[k * len(free) // parts : (k + 1) * len(free) // parts]) for k in range(parts)]
    return tuple(sorted({outside | sum(chosen) for chosen in combinations(blocks, keep)}))


def bit_distance(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def near_pairs(left: DataFrame, right: DataFrame, radius: int, scratch: Scratch, keep: int = 3, on: list[str] | None = None, also: Column | None = None) -> DataFrame:
    """Distinct (hl, hr) at Hamming distance ``radius`` or less; ``left`` has hl, ``right`` hr, both without nulls.

    Further columns of either side may join by equality (``on``, the same name in both) or by the condition ``also``;
    a pair is kept if one of its row combinations meets them.
    """
    on = on or []
    kept = []
    first = F.explode(F.array(*[F.lit(_signed(m)) for m in masks(0, radius, keep)]))
    sides = [side.withColumn("mask", first).withColumn("cell", F.col(h).bitwiseAND(F.col("mask"))) for side, h in ((left, "hl"), (right, "hr"))]
    key = ["mask", "cell", *on]
    level = list(masks(0, radius, keep))
    for step in range(STEPS):
        last = step == STEPS - 1
        crowded = None
        if not last:
            counts = [s.groupBy("mask", "cell").agg(F.count(F.lit(1)).alias(n)) for s, n in zip(sides, ("nl", "nr"))]
            crowded = scratch.save(counts[0].join(counts[1], ["mask", "cell"]).where(F.col("nl") * F.col("nr") > CROWDED).select("mask", "cell"))
            if not scratch.count(crowded):
                crowded = None
        calm = sides if crowded is None else [s.join(crowded, ["mask", "cell"], "left_anti") for s in sides]
        near = bit_distance(F.col("hl"), F.col("hr")) <= radius
        # the planner sees neither how many cells a row is put into nor how small a file packs rows, so it must not broadcast
        met = calm[0].join(calm[1].hint("merge"), key).where(near if also is None else also & near)
        kept.append(scratch.save(met.select("hl", "hr").distinct()))
        if crowded is None:
            break
        # (mask, next mask): at most 20 * 20 and 400 * 20 rows, fixed by construction
        finer = [(_signed(m), _signed(n)) for m in level for n in masks(m, radius, keep)]
        level = sorted({n for m in level for n in masks(m, radius, keep)})
        table = F.broadcast(left.sparkSession.createDataFrame(finer, "mask long, finer long"))
        sides = [
            s.join(crowded, ["mask", "cell"], "left_semi").join(table, "mask").drop("mask", "cell").withColumnRenamed("finer", "mask")
            .withColumn("cell", F.col(h).bitwiseAND(F.col("mask"))).distinct()
            for s, h in zip(sides, ("hl", "hr"))
        ]
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.distinct() if len(kept) > 1 else out
