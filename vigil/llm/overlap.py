"""Same or near-same records across splits.

A 64-bit fingerprint is a set of 64 shingles (position, bit).  Minwise hashing draws permutations of all shingles and keeps, of each, the
first shingle that the set holds.  Permutations are drawn within bands of positions: the positions lie in five
blocks, a band is two of them, and its ROWS minima together are the record's bucket in that band.  Two fingerprints within three bits are
the same in two blocks at least, so their sets are the same within some band and all its minima agree: they share a bucket
whatever the permutations are, and no pair is lost.  Unrelated ones agree in a minimum about one time in three.

Only buckets that hold records of both sides of the split are compared.  A bucket in which too many pairs would meet is hashed once
more, by bands of the positions outside its own, where the same argument holds; if it is crowded even then, it is cut into slices on
both sides, each met by each.  The exact Jaccard similarity of the sets decides: with d differing bits it is (64 - d) / (64 + d), so 61/67
stands for three bits.  Equal pixel hashes are a bucket of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import split_name, strip
from vigil.operators.hamming import bit_distance, masks
from vigil.operators.skew import HOT_ROWS, hot_list, skew_join
from vigil.session import Scratch

LEAST = Fraction(61, 67)
KEEP = 2  # blocks of a band; the others are as many as the bits that may differ
ROWS = 12  # minima of a band
CROWDED = 1_000_000  # pairs of a bucket beyond which it is hashed once more
SLICE = 1000  # records or fingerprints of one side that meet those of the other in one piece


def radius_of(least: Fraction) -> int:
    """The most differing bits d with (64 - d) / (64 + d) >= least."""
    return max(d for d in range(65) if Fraction(64 - d, 64 + d) >= least)


def similar(x: Column, y: Column, least: Fraction = LEAST) -> Column:
    """Whether the exact Jaccard similarity of two fingerprints as sets of (position, bit) is ``least`` or more."""
    d = bit_distance(x, y)
    return (F.lit(64) - d) * least.denominator >= (F.lit(64) + d) * least.numerator


@lru_cache(maxsize=256)
def _ranks(band: int) -> np.ndarray:
    """For ROWS permutations of the shingles of a band: the lowest rank that each content of each byte of a fingerprint has."""
    rng = np.random.Generator(np.random.Philox(key=band & (1 << 64) - 1))
    positions = [i for i in range(64) if band >> i & 1]
    out = np.full((ROWS, 8, 256), 255, np.uint8)
    content = np.arange(256)
    for p in range(ROWS):
        rank = rng.permutation(2 * len(positions)).astype(np.uint8)
        for j, i in enumerate(positions):
            own = np.where(content >> (i % 8) & 1, rank[2 * j + 1], rank[2 * j])
            out[p, i // 8] = np.minimum(out[p, i // 8], own)
    return out


def minima(h: np.ndarray, band: int) -> np.ndarray:
    """(rows, ROWS) minwise hashes of fingerprints under the permutations of a band."""
    table, parts = _ranks(band), h.astype(np.uint64).view(np.uint8).reshape(-1, 8)
    out = np.full((len(h), ROWS), 255, np.uint8)
    for b in range(8):
        if band >> 8 * b & 255:
            np.minimum(out, table[:, b, :].T[parts[:, b]], out=out)
    return out


def _bucket(low: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number for the minima of a band, told apart by ``key``."""
    x = np.asarray(key, np.uint64)
    with np.errstate(over="ignore"):
        for p in range(low.shape[1]):
            x = (x ^ low[:, p]) * np.uint64(0x9E3779B97F4A7C15)
            x = x ^ (x >> np.uint64(29))
    return x.view(np.int64)


def _hashed(rows: DataFrame, radius: int) -> DataFrame:
    """(h, bucket, band) of each fingerprint and band."""
    bands = masks(0, radius, KEEP)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy()
            got = np.stack([_bucket(minima(h, m), np.full(len(h), i, np.uint64)) for i, m in enumerate(bands)], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(h) + 1, dtype=np.int32) * len(bands), pa.array(got.ravel()))], names=["h", "buckets"])

    return rows.select("h").mapInArrow(sign, "h long, buckets array<long>")


def _hashed_again(rows: DataFrame, radius: int) -> DataFrame:
    """(h, buckets) of the bands of the positions outside the band of each row (h, bucket, band)."""
    bands = masks(0, radius, KEEP)
    finer = [[n & ~m for n in masks(m, radius, KEEP)] for m in bands]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, bucket, band = (b.column(i).to_numpy() for i in range(3))
            got = np.zeros((len(h), len(finer[0])), np.int64)
            for i in np.unique(band):
                own = band == i
                for j, m in enumerate(finer[i]):
                    got[own, j] = _bucket(minima(h[own], m), bucket[own].view(np.uint64) + np.uint64(j + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(h) + 1, dtype=np.int32) * got.shape[1], pa.array(got.ravel()))], names=["h", "buckets"])

    return rows.select("h", "bucket", "band").mapInArrow(sign, "h long, buckets array<long>")


def _shared(sides: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(bucket, n0, n1) of the buckets that hold fingerprints (h, bucket, ...) of both sides."""
    counted = [s.select("bucket", F.lit(1 - i).cast("long").alias("n0"), F.lit(i).cast("long").alias("n1")) for i, s in enumerate(sides)]
    both = counted[0].unionByName(counted[1]).groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return scratch.save(both.where("n0 > 0 and n1 > 0"), most=F.max(F.col("n0") * F.col("n1")))


def alike(train: DataFrame, held_out: DataFrame, scratch: Scratch, least: Fraction = LEAST) -> DataFrame:
    """Distinct (hl, hr) of different fingerprints (h) of two sides whose exact Jaccard similarity is ``least`` or more."""
    radius, names = radius_of(least), ("hl", "hr")
    explode = lambda signed: signed.select("h", F.posexplode("buckets").alias("band", "bucket"))
    sides = [explode(scratch.save(_hashed(s, radius))) for s in (train, held_out)]
    found = []
    for again in (True, False):
        shared = _shared(sides, scratch)
        crowded = F.col("n0") * F.col("n1") > CROWDED
        calm = shared.where(~crowded).select("bucket")
        rows = [s.select("bucket", F.col("h").alias(n)).join(calm, "bucket", "left_semi") for s, n in zip(sides, names)]
        # buckets hold more rows than the planner can tell, so it must not broadcast
        found.append(rows[0].join(rows[1].hint("merge"), "bucket").where(similar(F.col("hl"), F.col("hr"), least)).select(*names))
        if (scratch.watched(shared, "most") or 0) <= CROWDED:
            break
        full = scratch.save(shared.where(crowded))
        left_over = [skew_join(s, full.select("bucket"), "bucket", "left_semi") for s in sides]
        if again:
            sides = [explode(scratch.save(_hashed_again(s, radius))).select("h", "band", "bucket").distinct() for s in left_over]
            continue
        cuts = [F.ceil(F.col(n) / SLICE).cast("int").alias(n) for n in ("n0", "n1")]
        cut = []
        for i, (s, name) in enumerate(zip(left_over, names)):
            sized = skew_join(s.select("bucket", F.col("h").alias(name)), full.select("bucket", *cuts), "bucket")
            own, other = F.pmod(F.xxhash64(name), F.col(f"n{i}")).cast("int").alias(f"s{i}"), F.explode(F.sequence(F.lit(0), F.col(f"n{1 - i}") - 1)).alias(f"s{1 - i}")
            cut.append(sized.select("bucket", name, own, other))
        found.append(cut[0].join(cut[1].hint("merge"), ["bucket", "s0", "s1"]).where(similar(F.col("hl"), F.col("hr"), least)).select(*names))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return scratch.save(out.distinct())


def sides(images: DataFrame, row_id: str, split: str, exact: str, near: str, scratch: Scratch, **carry) -> tuple[DataFrame, DataFrame]:
    """Training rows and evaluation rows (id, side, exact, near, carried columns); a record counts once, others are out.

    A null or unknown split belongs to neither side; null hashes equal nothing.
    """
    rows = images.where(F.col(row_id).isNotNull()).select(
        F.col(row_id).alias("id"),
        F.struct(split_name(F.col(split)).alias("side"), F.when(strip(F.col(exact)) != "", F.lower(strip(F.col(exact)))).alias("exact"), F.col(near).cast("long").alias("near"), *[c.alias(k) for k, c in carry.items()]).alias("r"),
    )
    rows = scratch.save(rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*").where("side in ('train', 'val', 'test')"))
    return rows.where("side = 'train'"), rows.where("side <> 'train'")


def _near_classes(train: DataFrame, held_out: DataFrame, scratch: Scratch, least: Fraction) -> DataFrame:
    own = [s.where("near is not null").select(F.col("near").alias("h")).distinct() for s in (train, held_out)]
    return alike(*own, scratch, least)


def _members(rows: DataFrame, key: str, name: str, slices: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows with the slice of their class that they fall in, and the number of slices of each class that has several.

    The classes of more than SLICE rows that are listed are the hot ones, at most MOST_HOT; any other has at most a MOST_HOT-th of all rows.
    """
    known = rows.where(F.col(key).isNotNull())
    sizes = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = scratch.save(sizes.join(hot_list(sizes, key, "_n", at_least=SLICE + 1), key, "left_semi").select(F.col(key).alias(name), F.ceil(F.col("_n") / SLICE).cast("int").alias(slices)))
    cut = known.withColumnRenamed(key, name).join(F.broadcast(large), name, "left")
    return cut.withColumn(slices, F.pmod(F.xxhash64("id"), F.coalesce(slices, F.lit(1))).cast("int")), large


def _listed(classes: DataFrame, train: DataFrame, held_out: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """All pairs of members of classes (hl, hr); large classes are cut into slices, and the pieces of a class pair are separate keys."""
    a, large_a = _members(train, key, "hl", "sl", scratch)
    b, large_b = _members(held_out, key, "hr", "sr", scratch)
    pieces = classes
    for name, slices, large in (("hl", "sl", large_a), ("hr", "sr", large_b)):
        pieces = pieces.join(F.broadcast(large), name, "left").withColumn(slices, F.explode(F.sequence(F.lit(0), F.coalesce(slices, F.lit(1)) - 1)))
    a = a.select(F.col("id").alias("train_id"), "hl", "sl", F.col("near").alias("near_l"), F.col("exact").alias("exact_l"))
    b = b.select(F.col("id").alias("held_out_id"), "hr", "sr", F.col("near").alias("near_r"), F.col("exact").alias("exact_r"))
    return pieces.join(a, ["hl", "sl"]).join(b, ["hr", "sr"])


def overlaps(train: DataFrame, held_out: DataFrame, scratch: Scratch, least: Fraction = LEAST) -> DataFrame:
    """(train_id, held_out_id, how) of all pairs across the splits that are the same (exact) or else nearly so (near).

    Fingerprints and pixel hashes are compared once and then stand for their records.  A pair found by both comes from the
    fingerprints only, so that no two lists need be held against each other.
    """
    a, b = train.select("id", "near", "exact"), held_out.select("id", "near", "exact")
    tied = _near_classes(train, held_out, scratch, least)
    near = _listed(tied, a.withColumn("key", F.col("near")), b.withColumn("key", F.col("near")), "key", scratch)
    same = a.where("exact is not null").select("exact").distinct().join(b.select("exact").distinct(), "exact").select(F.col("exact").alias("hl"), F.col("exact").alias("hr"))
    exact = _listed(same, a.withColumn("key", F.col("exact")), b.withColumn("key", F.col("exact")), "key", scratch)
    exact = exact.where(~F.coalesce(similar(F.col("near_l"), F.col("near_r"), least), F.lit(False)))
    how = F.when(F.col("exact_l") == F.col("exact_r"), "exact").otherwise("near")
    return near.select("train_id", "held_out_id", how.alias("how")).unionByName(exact.select("train_id", "held_out_id", F.lit("exact").alias("how")))


def overlap_report(train: DataFrame, held_out: DataFrame, source: str, scratch: Scratch, least: Fraction = LEAST) -> DataFrame:
    """Per split and source of the held-out record: records that occur in training, and pairs that are the same or nearly so.

    Counted from classes of equal hashes and their sizes; no pair of records is listed.
    """
    a = scratch.save(train.groupBy("exact", "near").agg(F.count(F.lit(1)).alias("n_l")))
    b = scratch.save(held_out.groupBy("exact", "near", "side", F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_r")))
    tied = _near_classes(train, held_out, scratch, least)
    known = a.where("near is not null").groupBy("near").agg(F.sum("n_l").alias("n"))
    # records of training that are nearly the same, by fingerprint of the held-out record
    near = tied.join(known.withColumnRenamed("near", "hl"), "hl").groupBy(F.col("hr").alias("near")).agg(F.sum("n").alias("n_near"))
    pixels = a.where("exact is not null").groupBy("exact").agg(F.sum("n_l").alias("n_exact"))
    # of these, the ones that are the same anyway
    both = b.select("exact", "near").distinct().join(a.select("exact", F.col("near").alias("near_l"), "n_l"), "exact").where(similar(F.col("near"), F.col("near_l"), least)).groupBy("exact", "near").agg(F.sum("n_l").alias("n_both"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = b.join(near, "near", "left").join(pixels, "exact", "left").join(both, ["exact", "near"], "left")
    rows = rows.select("side", "source", "n_r", zero("n_exact").alias("x"), (zero("n_near") - zero("n_both")).alias("y")).where("x + y > 0")
    return rows.groupBy("side", "source").agg(F.sum("n_r").alias("n_records"), F.sum(F.col("x") * F.col("n_r")).alias("n_exact_pairs"), F.sum(F.col("y") * F.col("n_r")).alias("n_near_pairs"))
