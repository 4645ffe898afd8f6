"""History check, splits, overlaps and consolidation against brute force, with nulls, ties, repeats and empty tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.llm import components, history, overlap, splits
from vigil.session import Scratch


def _groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _graphs():
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(100, 180)]
    cycle = [(i, i + 1) for i in range(300, 330)] + [(330, 300)]
    star = [(500, 500 + i) for i in range(1, 40)]
    lollipop = [(700 + i, 700 + j) for i in range(5) for j in range(i)] + [(704 + i, 705 + i) for i in range(20)]
    ladder = [(800 + 2 * i, 801 + 2 * i) for i in range(15)] + [(800 + i, 802 + i) for i in range(28)]
    loop = [(900, 901), (901, 902), (902, 900), (902, 903), (903, 904), (904, 902)]
    noise = [(rng.randrange(1000, 1150), rng.randrange(1000, 1150)) for _ in range(120)]
    every = path + cycle + star + lollipop + ladder + loop + noise + [(2000, 2000), (2001, 2002)]
    rng.shuffle(every)
    return [p if rng.random() < 0.5 else p[::-1] for p in every]


def test_consolidation(spark):
    pairs = _graphs()
    rows = [(a, b, "x") for a, b in pairs + pairs[:20]] + [(None, 5, "x"), (5, None, "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "a long, b long, label string")
    got = {r.node: r.group for r in components.consolidate(df, "a", "b").collect()}
    assert got == _groups(pairs)
    assert components.consolidate(df.limit(0), "a", "b").count() == 0
    assert [tuple(r) for r in components.consolidate(spark.createDataFrame([(7, 7)], "a long, b long"), "a", "b").collect()] == [(7, 7)]


def test_hash_to_min_also_with_hot_nodes(spark, monkeypatch):
    pairs = _graphs()
    df = spark.createDataFrame(pairs + [(None, 1)], "a long, b long")
    for hot in (100_000, 10):
        monkeypatch.setattr(components, "HOT_ROWS", hot)
        assert {r.node: r.component for r in components.hash_to_min(df, Scratch(spark)).collect()} == _groups(pairs)


CROPS = "crop_id long, source_group string, source_clip string, split string, component string, row_id int"


def _crops(spark, rows):
    return splits.crops(spark.createDataFrame([(*r, "x", 1) for r in rows], CROPS), Scratch(spark))


def test_inconsistent_keys(spark):
    rows = [
        (1, "G1 ", "clip_a.mp4", "train"), (2, "g1", "clip_a", "VAL"), (3, "g2", "clip_b", "train"), (4, "g2", "clip_b", None), (5, "g3", "CLIP_B", " Train"), (6, None, "clip_c", "valid"), (7, "g4", "clip_c", "validation"),
        (8, None, None, "test"), (9, "", " ", "train"), (10, "g5", None, "test"), (11, "g5", None, "val"), (11, "g5", None, "val"), (None, "g2", "clip_b", "test"),
    ]
    df = _crops(spark, rows)
    assert {tuple(r) for r in splits.inconsistent(df, ["source_group", "source_clip"], "old_split").collect()} == {("source_group", "g1"), ("source_clip", "clip_a"), ("source_group", "g5")}
    assert splits.inconsistent(_crops(spark, []), ["source_group", "source_clip"], "old_split").count() == 0


def test_assignment(spark):
    rng = random.Random(2)
    rows = [(i, f"g{rng.randrange(300)}", None, None) for i in range(4000)] + [(10_000 + i, "huge", f"c{i % 7}", None) for i in range(2000)] + [(20_000 + i, None, None, None) for i in range(10)]
    shares = {"train": 0.72, "val": 0.16, "test": 0.12}
    df = _crops(spark, rows)
    got = splits.assign(df, shares, Scratch(spark))
    assert got.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0 and got.count() == 6010
    report = {r.split: r.share for r in splits.share_report(got, shares).collect()}
    assert all(abs(report[s] - w) < 0.03 for s, w in shares.items()) and abs(sum(report.values()) - 1) < 1e-9
    assert Counter(r.split for r in got.collect()) == Counter(r.split for r in splits.assign(df.repartition(3), shares, Scratch(spark)).collect())
    assert splits.assign(_crops(spark, []), shares, Scratch(spark)).count() == 0


def test_rendezvous_follows_weights_and_hardly_moves(spark):
    df = _crops(spark, [(i, f"g{i}", None, None) for i in range(8000)])
    before = {r.row_id: r.split for r in splits.assign(df, {"train": 0.8, "val": 0.1, "test": 0.1}, Scratch(spark), tries=1).collect()}
    shares = Counter(before.values())
    assert abs(shares["train"] / 8000 - 0.8) < 0.02 and abs(shares["val"] / 8000 - 0.1) < 0.02
    after = {r.row_id: r.split for r in splits.assign(df, {"train": 0.75, "val": 0.15, "test": 0.1}, Scratch(spark), tries=1).collect()}
    assert sum(before[i] != after[i] for i in before) / 8000 < 0.12


def _hashes(rng, n):
    base = [rng.getrandbits(64) for _ in range(n)]
    out = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base]
    return [h - (1 << 64) if h >= 1 << 63 else h for h in out]


def _near(a, b):
    return a is not None and b is not None and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3


def test_overlaps(spark):
    rng = random.Random(3)
    hs = _hashes(rng, 120)
    names = ["train", "Train ", "val", "VALID", "validation", "test", None, "other"]
    rows = [(i, rng.choice(names), rng.choice([None, "", f"Ab{rng.randrange(60)}", f"aB{rng.randrange(60)}"]), rng.choice([None, h]) if rng.random() < 0.2 else h, "src", 1) for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows + rows[:10] + [(None, "train", "ab1", hs[0], "src", 1)], "image_id long, split string, pixel string, ph long, side string, near int")
    scratch = Scratch(spark)
    train, held = overlap.sides(df, "image_id", "split", "pixel", "ph", scratch, source=F.col("side"))
    pairs = overlap.overlaps(train, held, scratch)
    side = lambda s: {"train": "t", "val": "e", "valid": "e", "validation": "e", "test": "e"}.get((s or "").strip().lower())
    want = {(a[0], b[0]) for a in rows if side(a[1]) == "t" for b in rows if side(b[1]) == "e" and ((a[2] and b[2] and a[2].lower() == b[2].lower()) or _near(a[3], b[3]))}
    got = [(r.train_id, r.held_out_id) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    report = overlap.overlap_report(train, held, "source", scratch).collect()
    assert sum(r.n_exact_pairs + r.n_near_pairs for r in report) == len(want) and {r.source for r in report} == {"src"}
    t, h = overlap.sides(df.limit(0), "image_id", "split", "pixel", "ph", scratch, source=F.col("side"))
    assert overlap.overlaps(t, h, scratch).count() == 0


@pytest.mark.parametrize("crowded", [3, 200])
def test_crowded_buckets_are_hashed_again_and_sliced(spark, monkeypatch, crowded):
    monkeypatch.setattr(overlap, "CROWDED", crowded)
    monkeypatch.setattr(overlap, "SLICE", 7)
    rng = random.Random(8)
    common = rng.getrandbits(64)
    hs = [common ^ sum(1 << rng.randrange(20) for _ in range(rng.randrange(9))) for _ in range(300)] + [rng.getrandbits(64) for _ in range(100)]
    hs = [h - (1 << 64) if h >= 1 << 63 else h for h in dict.fromkeys(hs)]
    frame = lambda x: spark.createDataFrame([(h,) for h in x], "h long")
    got = [tuple(r) for r in overlap.alike(frame(hs[::2]), frame(hs[1::2]), Scratch(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in hs[::2] for b in hs[1::2] if _near(a, b)} and got


def test_bands_lose_no_pair_and_part_unrelated_ones():
    import numpy as np

    rng = np.random.default_rng(5)
    h = rng.integers(-(2**63), 2**63, 20_000)
    flips = np.zeros(len(h), np.int64)
    for _ in range(3):
        flips |= np.int64(1) << rng.integers(0, 63, len(h))
    met, apart = np.zeros(len(h), bool), 0
    for band in overlap.masks(0, 3, overlap.KEEP):
        low = overlap.minima(h, band)
        met |= (low == overlap.minima(h ^ flips, band)).all(1)
        apart += (low == np.roll(low, 1, axis=0)).all(1).mean()
        agree = (low == np.roll(low, 1, axis=0)).mean()
        assert abs(agree - 1 / 3) < 0.05  # the Jaccard similarity of unrelated fingerprints
    assert met.all() and apart < 1e-3


def test_large_classes_are_counted_and_listed_in_slices(spark):
    rows = spark.range(20_000).selectExpr("id image_id", "if(id < 10000, 'train', 'test') split", "cast(null as string) px", "if(id % 10000 < 9999, 77L, id) ph", "'s' src")
    scratch = Scratch(spark)
    train, held = overlap.sides(rows, "image_id", "split", "px", "ph", scratch, source=F.col("src"))
    (r,) = overlap.overlap_report(train, held, "source", scratch).collect()
    assert (r.n_records, r.n_exact_pairs, r.n_near_pairs) == (9999, 0, 9999 * 9999)
    few = [f.where("id % 10 = 0") for f in (train, held)]
    assert overlap.overlaps(*few, scratch).count() == 1000 * 1000


def test_jaccard_is_the_radius():
    assert overlap.radius_of(overlap.LEAST) == 3


NAMES = {
    "gate_cam_01_p00.jpg": "gate_cam_01_p00", "GATE_CAM_01_P00.JPG": "gate_cam_01_p00", "Copy of gate_cam_01_p00.jpg": "gate_cam_01_p00", "gate_cam_01_p00 (1).jpeg": "gate_cam_01_p00", "gate_cam_01_p00 - Copy.png": "gate_cam_01_p00",
    "upload/round5/gate_cam_01_p00.jpg": "gate_cam_01_p00", "a\\b\\gate_cam_01_p00.jpg": "gate_cam_01_p00", "gate_cam_01_p00_jpg.rf.9d6f195c4681.jpg": "gate_cam_01_p00", "Copy of Copy of gate_cam_01_p00 (2).jpg": "gate_cam_01_p00",
    "gate_cam_01_p01.jpg": "gate_cam_01_p01", "": None, None: None, ".jpg": None,
}
D = "3578dd134c000b9518d6b542c770056e1a778627b15e7e2c90d111687806c7e8"
DIGESTS = {D: D, "SHA256:" + D.upper(): D, f" sha256:{D}\n": D, "0x" + D: D, "n/a": None, "pending": None, "": None, None: None, "0" * 64: None, history.EMPTY_FILE: None, D[:63]: None}


def test_names_and_digests(spark):
    got = {r.n: r.c for r in spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", history.crop_name(F.col("n")).alias("c")).collect()}
    assert got == NAMES
    got = {r.n: r.c for r in spark.createDataFrame([(n,) for n in DIGESTS], "n string").select("n", history.digest(F.col("n")).alias("c")).collect()}
    assert got == DIGESTS


RECORDS = "record_id long, selection_round int, sha256 string, crop_filename string, perceptual_hash long, digest int, h string, name string"


def test_history(spark):
    rng = random.Random(4)
    rows = []
    for i, h in enumerate(_hashes(rng, 60)):
        digest = rng.choice([None, "n/a", "%064x" % rng.randrange(16, 60), ("%064x" % rng.randrange(16, 60)).upper()])
        rows.append((i, rng.choice([1, 2, 2, 3, None]), digest, rng.choice([None, f"c_{rng.randrange(90)}.jpg", f"Copy of C_{rng.randrange(90)}.PNG"]), rng.choice([h, h, h, None]), 1, "x", "y"))
    df = spark.createDataFrame(rows + rows[:9] + [(None, 3, None, None, rows[0][4], 1, "x", "y")], RECORDS)
    name = lambda n: n and n.lower().replace("copy of ", "").split(".")[0]
    good = lambda d: d and len(d) == 64 and d.lower()
    want = {
        a[0] for a in rows if a[1] is not None for b in rows
        if b[1] is not None and b[1] < a[1] and ((good(a[2]) and good(a[2]) == good(b[2])) or (a[3] and name(a[3]) == name(b[3])) or _near(a[4], b[4]))
    }
    args = ("record_id", "selection_round", "sha256", "crop_filename", "perceptual_hash")
    assert {r.record_id for r in history.held_before(df, *args).collect()} == want
    assert history.held_before(df.limit(0), *args).count() == 0


def test_batches_do_not_read_each_other_again(spark):
    batch = lambda ids: spark.createDataFrame([(i, f"{i:064x}", f"n{i}", i << 20) for i in ids], "record_id long, digest string, name string, h long")
    h = history.PivotHistory(spark)
    assert h.check(batch([1])).count() == 0
    h.append(batch([1, 2]))
    h.append(batch([3]))
    assert sorted(r.record_id for r in h.check(batch([3, 1, 200])).collect()) == [1, 3]
    assert spark.read.parquet(f"{h.root}/pivots").count() == 3
    with pytest.raises(Exception):
        h.append(batch([4]).select("record_id"))


def test_check_reads_only_touched_ranges(spark):
    batch = lambda hs: spark.createDataFrame([(i, None, None, h) for i, h in enumerate(hs)], "record_id long, digest string, name string, h long")
    h = history.PivotHistory(spark)
    low = [(1 << k) - 1 for k in range(4, 9)]
    h.append(batch(low))

    def read(hs):
        """Ranges that a batch touches, and the rows that the scan of these ranges reads."""
        touched = h.scratch.watched(h._keys(batch(hs)), "touched")
        ranges = [k for k in range(17) if touched >> k & 1]
        scan = h._table("pivots", "hr long, range int").where(F.col("range").isin(ranges)).select("hr")
        scan.collect()
        return ranges, scan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    before = read([1 << 5])
    h.append(batch([-1 ^ x for x in range(2000)]))  # far ranges
    assert read([1 << 5]) == before and before[0] == [0, 1] and before[1] < len(low)
    assert read([-1])[0] == [15, 16] and 0 < read([-1])[1] < 2000
    assert sorted(r.record_id for r in h.check(batch([low[0] ^ 8, -1 ^ 255 << 20, -1 ^ 3 ^ 1 << 40, 1 << 40])).collect()) == [0, 2]


def test_crowded_cells_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(history, "SLICE", 5)
    monkeypatch.setattr(history, "HOT_ROWS", 20)
    rng = random.Random(6)
    hs = [0xF0F0 << 20 ^ (1 << rng.randrange(48)) ^ (1 << rng.randrange(48)) ^ (1 << rng.randrange(48)) for _ in range(120)]
    frame = lambda ids: spark.createDataFrame([(i, None if i % 3 else "d", f"n{i}" if i % 2 else None, hs[i]) for i in ids], "record_id long, digest string, name string, h long")
    h = history.PivotHistory(spark)
    h.append(frame([i for i in range(60) if i % 3]))
    got = sorted(r.record_id for r in h.check(frame(range(60, 120))).collect())
    assert got == [i for i in range(60, 120) if any(_near(hs[i], hs[j]) for j in range(60) if j % 3)] and got
    h.append(frame([0]))
    assert {i for i in range(60, 120) if i % 3 == 0} <= {r.record_id for r in h.check(frame(range(60, 120))).collect()}


def test_rounds_start_few_jobs_and_broadcasts(spark):
    """Stages and broadcasts take the driver's memory whatever the size of the tables; p1_found went over its limit by them."""
    rng = random.Random(9)
    hs = _hashes(rng, 200)
    frame = lambda ids: spark.createDataFrame([(i, f"{i % 90:064x}", f"n{i % 70}", hs[i]) for i in ids], "record_id long, digest string, name string, h long")
    h = history.PivotHistory(spark)
    h.append(frame(range(200)))
    found = h.check(frame(range(200, 400)))
    assert len(found.collect()) == 200
    plan = found._jdf.queryExecution().executedPlan().executedPlan().toString()
    nodes = Counter(re.findall(r"(?m)^[\s:+\-*()\d]*(BroadcastExchange|Exchange)\b", plan))
    assert nodes["BroadcastExchange"] == 1 and nodes["Exchange"] <= 7

    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    df = spark.createDataFrame([(i, 1 + i % 5, None, f"c_{i % 89}.jpg", hs[i], 1, "x", "y") for i in range(400)], RECORDS)
    before = jobs()
    assert history.held_before(df, "record_id", "selection_round", "sha256", "crop_filename", "perceptual_hash").count()
    assert jobs() - before <= 15 * 5


def test_parts_have_their_own_counts(spark):
    scratch = Scratch(spark)
    saved = scratch.save(spark.range(10).selectExpr("id", "cast(id % 3 as int) part"), by=("part",))
    parts = scratch.parts(saved, "part", most=F.max("id"))
    assert {k: (scratch.count(p), scratch.watched(p, "most"), sorted(r.id for r in p.collect())) for k, p in parts.items()} == {0: (4, 9, [0, 3, 6, 9]), 1: (3, 7, [1, 4, 7]), 2: (3, 8, [2, 5, 8])}


def test_large_batches_are_written_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(history, "ONE_TASK", 10)
    rng = random.Random(10)
    hs = _hashes(rng, 100)
    frame = lambda ids: spark.createDataFrame([(i, None, None, hs[i]) for i in ids], "record_id long, digest string, name string, h long")
    h = history.PivotHistory(spark)
    h.append(frame(range(100)))
    assert sorted(r.hr for r in spark.read.parquet(f"{h.root}/pivots").collect()) == sorted(hs[:100])
    assert sorted(r.record_id for r in h.check(frame(range(100, 200))).collect()) == [i for i in range(100, 200) if any(_near(hs[i], x) for x in hs[:100])]


def test_more_rows_than_sums_of_hashes_could_hold(spark):
    """Changed rows are counted, so no number of rows overflows: 18 million rows of which one differs."""
    from vigil.llm.components import NEW, OLD

    both = spark.range(18_000_000).select(F.col("id").alias("v"), F.when(F.col("id") == 7, F.lit(OLD)).otherwise(F.lit(NEW + OLD)).alias("_in"))
    scratch = Scratch(spark)
    saved = scratch.save(both, F.col("_in") != OLD, ("_in",), changed=F.count_if(F.col("_in") != NEW + OLD))
    assert scratch.watched(saved, "changed") == 1 and scratch.count(saved) == 17_999_999 and saved.columns == ["v"]
