"""Splits that keep related records together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import split_name, strip
from vigil.llm.components import hash_to_min
from vigil.operators.skew import HOT_ROWS, hot_list, skew_join
from vigil.session import Scratch

TRIES = 64  # seeds of the hashing that are weighed for each class of sizes
FRACTIONS = (1 / 16, 1 / 256, 1 / 4096)  # of all rows, the least sizes of the classes of components but the last


def key_value(value: Column, file_suffix: bool = False) -> Column:
    """A key stripped and in lower case, without file suffix if asked; null for blank."""
    bare = F.lower(strip(value))
    if file_suffix:
        bare = F.regexp_replace(bare, r"\.[a-z0-9]{1,5}$", "")
    return F.when(bare != "", bare)


def related(records: DataFrame, row_id: str, keys: dict[str, Column], scratch: Scratch, **carry: Column) -> DataFrame:
    """(row_id, one column a key, carried columns, component): rows that share a key value have one component.

    A row is one record however often delivered (the smallest of its rows counts).  Nodes are key values; a row
    ties its key values together, and components of nodes come from hash-to-min.  A row whose keys are all
    null is a component of its own.
    """
    names = list(keys)
    rows = records.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("row_id"), F.struct(*[c.alias(k) for k, c in keys.items()], *[c.alias(k) for k, c in carry.items()]).alias("r"))
    rows = scratch.save(rows.groupBy("row_id").agg(F.min("r").alias("r")).select("row_id", "r.*"))
    nodes = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k))) for i, k in enumerate(names)]
    first = F.coalesce(*nodes)
    ties = rows.select(first.alias("a"), F.explode(F.array(*nodes)).alias("b")).where("a is not null and b is not null").distinct()
    found = hash_to_min(ties, scratch).withColumnRenamed("node", "_node")
    placed = rows.withColumn("_node", first)
    joined = skew_join(placed.where("_node is not null"), found, "_node").drop("_node")
    alone = placed.where("_node is null").drop("_node").withColumn("component", F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    return scratch.save(joined.unionByName(alone))


def inconsistent(rows: DataFrame, keys: list[str], split: str) -> DataFrame:
    """(key_field, key_value) of key values that bear two or more splits in a table made by ``related``.

    Only components with two splits can hold such a key, so their rows alone are looked at.  Null splits and null
    keys say nothing.
    """
    mixed = rows.where(F.col(split).isNotNull()).groupBy("component").agg(F.min(split).alias("x"), F.max(split).alias("y")).where("x <> y").select("component")
    held = skew_join(rows.where(F.col(split).isNotNull()), mixed, "component", "left_semi")
    long = held.select(F.col(split).alias("s"), F.explode(F.array(*[F.struct(F.lit(k).alias("key_field"), F.col(k).alias("key_value")) for k in keys])).alias("k"))
    return long.where("k.key_value is not null").groupBy("k.key_field", "k.key_value").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y").select("key_field", "key_value")


def _choice(weights: dict[str, float], seed: Column) -> Column:
    """The split of a component by weighted rendezvous hashing: of the scores -ln(h) / weight, h uniform, the smallest wins."""
    uniform = lambda s: (F.xxhash64("component", F.lit(s), seed).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    return F.array_min(F.array(*[F.struct((-F.log(uniform(s)) / w).alias("x"), F.lit(s).alias("s")) for s, w in sorted(weights.items()) if w > 0]))["s"]


def assign(rows: DataFrame, shares: dict[str, float], scratch: Scratch, seed: int = 0, tries: int = TRIES) -> DataFrame:
    """``rows`` with the column ``split`` such that components stay whole and splits come near ``shares``.

    Every component chooses by weighted rendezvous hashing.  Components are hashed by classes of size, those with at least a
    FRACTIONS[0] of all rows first: the weights of a class are what the larger classes left of the targets, and of ``tries``
    seeds the one is taken whose choices leave the class nearest to them.  One aggregate a class weighs all seeds; a number
    a seed and split comes to the driver.  Shares that are not positive get nothing; no rows give no rows.
    """
    sizes = scratch.save(rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")), total=F.sum("n"), most=F.max("n"))
    total = scratch.watched(sizes, "total") or 0
    wanted = {s: w for s, w in shares.items() if w and w > 0}
    lack = {s: total * w / sum(wanted.values()) for s, w in wanted.items()}
    bounds = [None, *[max(1, math.ceil(total * f)) for f in FRACTIONS], 1]
    chosen = None
    for upper, lower in zip(bounds, bounds[1:]):
        own = F.col("n") >= lower
        if upper is not None:
            own = own & (F.col("n") < upper)
        weights = {s: max(x, 0.0) for s, x in lack.items()}
        if not any(weights.values()):
            weights = wanted
        if not weights or (upper is not None and upper <= lower):
            continue
        tried = sizes.where(own).select("component", "n", F.explode(F.sequence(F.lit(seed), F.lit(seed + tries - 1))).alias("seed"))
        got: dict[int, dict[str, int]] = {}
        for r in tried.groupBy("seed", _choice(weights, F.col("seed")).alias("s")).agg(F.sum("n").alias("n")).collect():
            got.setdefault(r.seed, {})[r.s] = r.n
        if not got:
            continue
        held = sum(next(iter(got.values())).values())
        # what the class should give each split: its weight's part of the class
        due = {s: held * w / sum(weights.values()) for s, w in weights.items()}
        best = min(sorted(got), key=lambda k: max(abs(got[k].get(s, 0) - due[s]) for s in due))
        lack = {s: x - got[best].get(s, 0) for s, x in lack.items()}
        one = sizes.where(own).select("component", "n", _choice(weights, F.lit(best)).alias("split"))
        chosen = one if chosen is None else chosen.unionByName(one)
    if chosen is None:
        return rows.withColumn("split", F.lit(None).cast("string"))
    if (scratch.watched(sizes, "most") or 0) >= HOT_ROWS:
        return skew_join(rows, chosen.drop("n"), "component", "inner", hot_list(sizes, "component", "n"))
    return rows.join(chosen.drop("n"), "component")


def share_report(assigned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Rows, share and target of each split, also of a split that got no rows."""
    targets = F.broadcast(assigned.sparkSession.createDataFrame([(s, float(w)) for s, w in shares.items()], "split string, target_share double"))
    counted = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("component").alias("n_components"))
    total = F.broadcast(assigned.agg(F.count(F.lit(1)).alias("_total")))
    return targets.join(counted, "split", "left").crossJoin(total).select(
        "split", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_components", F.lit(0)).alias("n_components"),
        F.when(F.col("_total") > 0, F.coalesce("n_rows", F.lit(0)) / F.col("_total")).otherwise(F.lit(0.0)).alias("share"),
    )


def crops(person_crops: DataFrame, scratch: Scratch) -> DataFrame:
    """``related`` over crops by source group and clip, with the split they bear so far."""
    keys = {"source_group": key_value(F.col("source_group")), "source_clip": key_value(F.col("source_clip"), file_suffix=True)}
    return related(person_crops, "crop_id", keys, scratch, old_split=split_name(F.col("split")))
