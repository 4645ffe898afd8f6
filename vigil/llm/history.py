"""Deduplicating new batches against all history.

History is three append-only tables: keys (digests and names), a pivot table that holds every accepted fingerprint with its
Hamming distances to fixed pivots, and the number of fingerprints in each cell of pivot distances.  A batch is checked against
them and then appended; no batch is read again.

By the triangle inequality two fingerprints within the radius have distances to each pivot that differ by at most the
radius.  The pivots are no bits, four halfwords and four bytes of ones.  As the difference of the distances to no bits and to a block of ones
tells how many bits of the block are set, the inequality for all unions of blocks together says: the numbers of set bits of disjoint blocks
differ by at most the radius in sum.  That prunes in three steps.  The pivot table lies in folders by range of the distance to the
first pivot, and a batch reads the folders that its own distances touch.  The join runs on cells of the distances to the first five
pivots: a stored fingerprint lies in one cell, a new one looks into the cells around its own, so that a pair meets at
most once.  The other pivots prune what meets there, and the true distance decides.  A cell with many fingerprints is
cut into slices on both sides, each met by each; none is dropped or capped.

Distances of unrelated fingerprints to any pivot crowd around half of the bits, so the share of pairs that the cells leave is
constant (4 % for random bits, 0.12 % after the other pivots) and the work on them grows with batch times history.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.text import strip
from vigil.operators.hamming import bit_distance
from vigil.operators.skew import HOT_ROWS, hot_list
from vigil.session import Scratch

RADIUS = 3
RANGE = 4  # width of a range of distances to the first pivot
SLICE = 4096  # fingerprints of one side of a cell that are compared in one piece, about
ONE_TASK = 1_000_000  # keys of a batch up to which one task writes its fingerprints, so that none has to be sampled
HALFWORDS, BYTES = 4, 4
# fixed pivots: no bits, the four halfwords, and the lower byte of each halfword
PIVOTS = (0x0, 0xFFFF, 0xFFFF0000, 0xFFFF00000000, 0xFFFF000000000000, 0xFF, 0xFF0000, 0xFF00000000, 0xFF000000000000)
EMPTY_FILE = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes


def digest(text: Column) -> Column:
    """A SHA-256 as 64 lower-case hex digits however written; null for a stand-in, also that of an empty file."""
    bare = F.regexp_replace(F.lower(strip(text)), r"^sha-?256\s*[:=\-]?\s*(0x)?|^0x", "")
    real = bare.rlike(r"^[0-9a-f]{64}$") & ~bare.rlike(r"^(.)\1*$") & (bare != EMPTY_FILE)
    return F.when(real, bare)


def crop_name(text: Column) -> Column:
    """What a file name says of the crop: without folders, export suffix, file type, copy marks and letter case."""
    name = F.lower(strip(F.regexp_replace(text, r"^.*[/\\]", "")))
    name = F.regexp_replace(name, r"\.rf\.[0-9a-z]+(\.[a-z0-9]{1,5})?$", "")
    name = F.regexp_replace(name, r"[._](jpe?g|png|bmp|webp|gif|tiff?)$", "")
    # marks of copies may be nested to any depth
    name = F.regexp_replace(name, r"(?U)^(\s*(copy|kopie|copie|copia)( ?\(\d+\))? of )+", "")
    name = strip(F.regexp_replace(name, r"(?U)(\s*([ _]*\(\d+\)|\s-\s+(copy|kopie|copie|copia)|_copy\d*))+\s*$", ""))
    return F.when(name != "", name)


DISTANCES = [f"d{i}" for i in range(len(PIVOTS))]
CELL = 16 + 1 + 2 * RADIUS  # values of set bits of a halfword, with room for the radius
#: steps from a cell to the cells that hold fingerprints within the radius
AROUND = [sum(x * CELL ** (HALFWORDS - 1 - i) for i, x in enumerate(step)) for step in product(range(-RADIUS, RADIUS + 1), repeat=HALFWORDS) if sum(map(abs, step)) <= RADIUS]


def pivot_distances(h: str) -> list[str]:
    """SQL of the distances of the column ``h`` to the pivots."""
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in PIVOTS]
    return [f"cast(bit_count({h} ^ cast('{p}' as bigint)) as tinyint) d{i}" for i, p in enumerate(signed)]


def _cell() -> str:
    """SQL of the cell of the distances to the first five pivots.

    A block has (distance to no bits + its width - distance to the block) / 2 bits set.
    """
    bits = [f"(cast(d0 as int) + 16 - d{i}) div 2 + {RADIUS}" for i in range(1, 1 + HALFWORDS)]
    return "cast(" + " + ".join(f"({x}) * {CELL ** (HALFWORDS - 1 - i)}" for i, x in enumerate(bits)) + " as int) cell"


def _packed() -> str:
    """SQL of all distances in one number, seven bits each, so that a row stays narrow on its way."""
    return "(" + " | ".join(f"shiftleft(cast(d{i} as bigint), {7 * i})" for i in range(len(PIVOTS))) + ")"


def _prune(a: str, b: str) -> Column:
    """The triangle inequality for all unions of the pivots' blocks: half of what is summed up are the differences of set bits.

    With the differences e of distances, the bits set in the lower byte of a halfword differ by (e0 - e of the byte) / 2, those
    in the upper one by (e of the byte - e of the halfword) / 2.
    """
    e = [f"(shiftright({a}, {7 * i}) & 127) - (shiftright({b}, {7 * i}) & 127)" for i in range(len(PIVOTS))]
    parts = []
    for g in range(BYTES):
        half, low = e[1 + g], e[1 + HALFWORDS + g]
        parts.append(f"abs(({e[0]}) - ({low})) + abs(({low}) - ({half}))")
    return F.expr(f"{' + '.join(parts)} <= {2 * RADIUS}")


def with_keys(batch: DataFrame, *also: str) -> DataFrame:
    """(record_id, also, kind, key): digest, name and fingerprint of each record, without nulls."""
    values = [F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in (("d", "digest"), ("n", "name"), ("h", "h"))]
    return batch.select("record_id", *also, F.explode(F.array(*values)).alias("k")).select("record_id", *also, "k.kind", "k.key").where("key is not null")


def counted_keys(batch: DataFrame, *by: str) -> DataFrame:
    """(by, kind, key, n, h, distances of fingerprints) of the different keys."""
    counted = with_keys(batch, *by).groupBy(*by, "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("h", F.when(F.col("kind") == "h", F.col("key").cast("long"))).selectExpr(*by, "kind", "key", "n", "h", *pivot_distances("h"))


def key_facts() -> dict[str, Column]:
    """Of a batch's keys: the most records of one, and the ranges of the distance to the first pivot that are touched, as bits."""
    around = [F.expr(f"shiftleft(1L, cast(floor((d0 + {x}) / {RANGE}) as int))") for x in (-RADIUS, 0, RADIUS)]
    touched = F.bit_or(around[1].bitwiseOR(F.when(F.col("d0") >= RADIUS, around[0]).otherwise(F.lit(0))).bitwiseOR(around[2]))
    return {"most": F.max("n"), "touched": touched}


class PivotHistory:
    """Everything accepted so far.  ``check`` compares a batch with it, ``append`` adds the batch."""

    def __init__(self, spark: SparkSession, scratch: Scratch | None = None, root: str | None = None):
        self.spark, self.scratch = spark, scratch or Scratch(spark)
        self.root = root or f"{self.scratch.root}/history"
        self.parts = 0
        self.keyed: tuple[DataFrame, DataFrame] | None = None

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _keys(self, batch: DataFrame) -> DataFrame:
        """(kind, key, n, distances of fingerprints) of the batch's different keys, written once for check and append."""
        if self.keyed is None or self.keyed[0] is not batch:
            self.keyed = batch, self.scratch.save(counted_keys(batch), **key_facts())
        return self.keyed[1]

    def near(self, fingerprints: DataFrame, ranges: list[int]) -> DataFrame:
        """(hl) of different fingerprints (hl, distances) that have a stored one within the radius, once for each such pair.

        ``ranges`` are the ranges of the distance to the first pivot that the fingerprints touch; no other folder is read.
        """
        own = fingerprints.selectExpr("hl", _cell(), f"{_packed()} ql")
        # one text instead of many literals keeps the plan small
        around = lambda df: df.select("*", F.expr(f"explode(cast(split('{','.join(map(str, AROUND))}', ',') as array<int>))").alias("_step")).withColumn("cell", F.col("cell") + F.col("_step")).drop("_step")
        # cells are at most CELL ** HALFWORDS by construction, so their counts may be broadcast
        looked = around(own.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))).selectExpr("cell", "0L nr", "n nl")
        counts = self._table("cells", "cell int, n long").selectExpr("cell", "n nr", "0L nl").unionByName(looked).groupBy("cell").agg(F.sum("nr").alias("nr"), F.sum("nl").alias("nl"))
        few = F.broadcast(counts.where("nr > 0 and nl > 0").selectExpr("cell", f"cast(ceil(nr / {SLICE}) as int) sr", f"cast(ceil(nl / {SLICE}) as int) sl"))
        left = around(own).join(few, "cell").selectExpr("hl", "ql", "cell", "cast(pmod(xxhash64(hl), sl) as int) l", "explode(sequence(0, sr - 1)) r")
        table = self._table("pivots", "hr long, " + ", ".join(f"{c} tinyint" for c in DISTANCES) + ", range int").where(F.col("range").isin(ranges))
        right = table.selectExpr("hr", f"{_packed()} qr", _cell()).join(few, "cell").selectExpr("hr", "qr", "cell", "explode(sequence(0, sl - 1)) l", "cast(pmod(xxhash64(hr), sr) as int) r")
        # the planner can't see how many cells a row looks into, so it must not broadcast
        met = left.join(right.hint("merge"), ["cell", "l", "r"]).where(_prune("ql", "qr") & (bit_distance(F.col("hl"), F.col("hr")) <= RADIUS))
        return met.select("hl")

    def check(self, batch: DataFrame) -> DataFrame:
        """(record_id) of the batch's records (record_id, digest, name, h) that history already holds.

        Null digests, names and fingerprints equal nothing.  An empty history holds nothing.
        """
        if not self.parts:
            return batch.select("record_id").limit(0)
        keys = self._keys(batch)
        touched = self.scratch.watched(keys, "touched") or 0
        held = self._table("keys", "kind string, key string")
        if touched:
            near = self.near(keys.where("kind = 'h'").withColumnRenamed("h", "hl"), [k for k in range(64 // RANGE + 1) if touched >> k & 1])
            held = held.unionByName(near.select(F.lit("h").alias("kind"), F.col("hl").cast("string").alias("key")))
        rows = with_keys(batch)
        if (self.scratch.watched(keys, "most") or 0) < HOT_ROWS:
            # different keys lie as the join needs them; a broadcast of what was shuffled already would only cost the driver memory
            return rows.join(held.distinct().hint("merge"), ["kind", "key"], "left_semi").select("record_id").distinct()
        # one copied crop may be a third of a batch: its keys, of which there are at most MOST_HOT, are looked up by broadcast
        held = keys.select("kind", "key").join(held.distinct(), ["kind", "key"], "left_semi")
        held = self.scratch.save(held.select(F.struct("kind", "key").alias("k")))
        hot = F.broadcast(hot_list(keys.select(F.struct("kind", "key").alias("k"), "n"), "k", "n"))
        rows = rows.select("record_id", F.struct("kind", "key").alias("k"))
        hits = rows.join(hot, "k", "left_semi").join(F.broadcast(held.join(hot, "k", "left_semi")), "k", "left_semi")
        return hits.unionByName(rows.join(hot, "k", "left_anti").join(held, "k", "left_semi")).select("record_id").distinct()

    def append(self, batch: DataFrame) -> None:
        """Add the batch's different digests, names and fingerprints, the latter with their pivot distances."""
        keys = self._keys(batch)
        fresh = keys.where("kind = 'h'").withColumnRenamed("h", "hr").select("hr", *DISTANCES)
        ranged = fresh.withColumn("range", F.floor(F.col("d0") / RANGE).cast("int"))
        ranged = ranged.coalesce(1) if self.scratch.count(keys) <= ONE_TASK else ranged.repartitionByRange("range", *DISTANCES[1:3])
        jobs = (
            lambda: keys.where("kind <> 'h'").select("kind", "key").write.mode("append").parquet(f"{self.root}/keys"),
            lambda: ranged.write.mode("append").partitionBy("range").parquet(f"{self.root}/pivots"),
            lambda: fresh.selectExpr(_cell()).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{self.root}/cells"),
        )
        with ThreadPoolExecutor(len(jobs)) as pool:  # three small tables; each is written by its own job
            for done in [pool.submit(job) for job in jobs]:
                done.result()
        self.parts += 1


def held_before(records: DataFrame, row_id: str, round_: str, sha: str, name: str, fingerprint: str, scratch: Scratch | None = None) -> DataFrame:
    """(record_id, round) of records whose crop some lower round already holds; rounds go through a ``PivotHistory``.

    A record delivered twice counts once.  The number of rounds is small; a record without round is compared with
    nothing and held by nothing.
    """
    spark = records.sparkSession
    scratch = scratch or Scratch(spark)
    rows = records.where(F.col(row_id).isNotNull() & F.col(round_).isNotNull()).select(
        F.col(row_id).alias("record_id"),
        F.struct(F.col(round_).alias("round"), digest(F.col(sha)).alias("digest"), crop_name(F.col(name)).alias("name"), F.col(fingerprint).cast("long").alias("h")).alias("r"),
    )
    # in folders by round a batch reads its own rows, and no round's number gets into generated code, which so serves all rounds
    rows = scratch.save(rows.groupBy("record_id").agg(F.min("r").alias("r")).select("record_id", "r.*"), by=("round",))
    # the keys of all rounds are counted in one job; a round without any holds nothing and is held by nothing
    keys = scratch.parts(scratch.save(counted_keys(rows, "round"), by=("round",)), "round", **key_facts())
    history, found = PivotHistory(spark, scratch), []
    with ThreadPoolExecutor(1) as pool:
        for r in sorted(keys):
            batch = rows.where(F.col("round") == r)
            history.keyed = batch, keys[r]
            # the check has listed the files it reads, so what it finds can be written while the batch is appended
            writing = pool.submit(scratch.save, history.check(batch))
            history.append(batch)
            found.append(writing.result().withColumn("round", F.lit(r)))
    out = spark.createDataFrame([], f"record_id {rows.schema['record_id'].dataType.simpleString()}, round int")
    for part in found:
        out = out.unionByName(part)
    return out
