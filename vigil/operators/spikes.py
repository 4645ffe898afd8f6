"""Implausible spikes in measurements: physical limits, additive outliers, counter disorder and stuck runs.

A rate is modelled as a first-order autoregression about a level that may shift.  The coefficient and the scale are
those of the source (the camera's field), from medians of the absolute steps to the reading before and to the one before that, so that
neither spikes nor shifts of level bear on them.  A reading is forecast from the readings before it and from those after it; outliers are
taken out round by round until a round finds none.

Readings of many series are sorted once by range; a position in that order cuts them into chunks of equal size that
carry neighbours of both sides, so neither a hot camera nor an endless session ever lands in one task.  Every chunk tells which of its own
readings might look further than its neighbours, or still changed in its last round; if there are any, the chunks are judged again with
more of both.  So verdicts are those of the whole series wherever the cuts fall, and no round is left out.

Readings are many and narrow, so what is shuffled and kept is kept small: fields travel as numbers, bounds as one flag, sorted readings in
delta encoding, and to their chunks in pieces of columns rather than as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import instant
from vigil.operators.ordered import with_offsets
from vigil.session import Scratch

CHUNK = 65_536
HALO = 128  # neighbours of a chunk on either side at first
ROUNDS = 8  # of taking out outliers at first
WIDER = 4  # times as many of both where that doesn't do
CLIP = 3.0  # usual spreads that a neighbour's deviation from its level counts at most
PHI = 0.9  # the largest coefficient
SIDE = 5  # readings that make a level
LONGEST = 3  # readings of a spike
TIMES = 10.0  # usual spreads that a spike is off
STUCK = 8  # equal readings in a row

READINGS = "source_table string, field_name string, camera_id string, session_id string, row_id long, at timestamp, eligible boolean, value double, bound double"


@dataclass(frozen=True)
class Limits:
    """What a field can be: a rate with physical limits, or a running count that ``bound`` caps."""

    kind: str  # rate or count
    low: float = 0.0
    low_is_bad: bool = False
    high: float = float("inf")


def readings(df: DataFrame, source: str, field: str, row_id: str, at, eligible=None, bound: str | None = None, tie: str | None = None) -> DataFrame:
    """The readings of one field; see ``all_readings``."""
    return all_readings(df, source, {field: bound}, row_id, at, eligible, tie)


def all_readings(df: DataFrame, source: str, fields: dict[str, str | None], row_id: str, at, eligible=None, tie: str | None = None) -> DataFrame:
    """The readings of a table's fields in the schema ``READINGS``: without nulls, one a row id (the first delivered).

    ``fields`` names each field and, or null, the column that bounds it.  Rows without row id are left out of the
    result, as no case can name them; a null camera or session is a series of its own.
    """
    number = lambda c: F.col(c).cast("double")
    # plain columns of the numbers: an array of structs with names would double what is shuffled
    numbers = [number(c).alias(f"{n}{i}") for i, fb in enumerate(fields.items()) for n, c in zip("vb", fb) if c]
    values = [
        F.struct(F.lit(f).alias("field_name"), F.col(f"r.v{i}").alias("value"), (F.col(f"r.b{i}") if b else F.lit(None).cast("double")).alias("bound"))
        for i, (f, b) in enumerate(fields.items())
    ]
    rows = df.where(F.col(row_id).isNotNull()).select(
        F.col(row_id).cast("long").alias("row_id"),
        F.struct(
            (F.col(tie) if tie else F.lit(0)).alias("tie"), at.alias("at"), F.coalesce(F.col("camera_id"), F.lit("")).alias("camera_id"),
            F.coalesce(F.col("session_id"), F.lit("")).alias("session_id"), (F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))).alias("eligible"),
            *numbers,
        ).alias("r"),
    )
    return (
        rows.groupBy("row_id").agg(F.min("r").alias("r")).select("row_id", "r", F.explode(F.array(*values)).alias("x")).where("x.value is not null")
        .select(F.lit(source).alias("source_table"), "x.field_name", "r.camera_id", "r.session_id", "row_id", "r.at", "r.eligible", "x.value", "x.bound")
    )


def _neighbours(good: np.ndarray, series: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each reading the positions (or -1) of the k good readings of its series before it and after it."""
    n = len(good)
    where = np.flatnonzero(good)
    if not len(where):
        return np.full((n, k), -1), np.full((n, k), -1)
    rank = np.cumsum(good)  # good readings up to and with this one
    ahead = rank - good
    step = np.arange(k)
    before, after = ahead[:, None] - 1 - step, rank[:, None] + step
    out = []
    for p in (before, after):
        ok = (p >= 0) & (p < len(where))
        at = where[np.clip(p, 0, len(where) - 1)]
        ok &= series[at] == series[:, None]
        out.append(np.where(ok, at, -1))
    return out[0], out[1]


def _median(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row medians of values[at] over the places that are not -1; nan where there are none."""
    ok = at >= 0
    count = ok.sum(1)
    got = np.sort(np.where(ok, values[at], np.inf), axis=1)
    row = np.arange(len(at))
    lower, upper = got[row, np.maximum(count - 1, 0) // 2], got[row, np.minimum(count // 2, at.shape[1] - 1)]
    with np.errstate(invalid="ignore"):
        return np.where(count > 0, (lower + upper) / 2, np.nan)


class Sight:
    """Which readings of a chunk might be judged otherwise if more of the series were seen.

    ``cut`` tells whether the series goes on before the first and after the last reading.  A reading is unsure once it looked for
    neighbours beyond a cut, or at readings that were unsure.  ``late`` readings changed in the last round allowed.
    """

    def __init__(self, series: np.ndarray, cut: tuple[bool, bool]):
        n = len(series)
        new = np.r_[True, series[1:] != series[:-1]] if n else np.zeros(0, bool)
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        self.first, self.last = start[run], np.r_[start[1:], n][run] - 1 if n else start
        self.cut_before = (self.first == 0) & cut[0]
        self.cut_after = (self.last == n - 1) & cut[1]
        self.unsure, self.late = np.zeros(n, bool), np.zeros(n, bool)

    def looked(self, low: np.ndarray, high: np.ndarray) -> None:
        """Readings have looked as far as the positions ``low`` and ``high``, or past all of their series where these are -1."""
        beyond = ((low < 0) & self.cut_before) | ((high < 0) & self.cut_after)
        upto = np.r_[0, np.cumsum(self.unsure)]
        self.unsure |= beyond | (upto[np.where(high < 0, self.last, high) + 1] > upto[np.where(low < 0, self.first, low)])


def _rounds(find, good: np.ndarray, series: np.ndarray, k: int, rounds: int, sight: Sight) -> np.ndarray:
    """Take what ``find`` (positions of good neighbours before, after, good) finds out of ``good`` until it finds nothing."""
    calm = None
    for r in range(rounds):
        if calm is None:
            before, after = _neighbours(good, series, k)
            found = find(before, after, good)
            if found.any():
                good = good & ~found
                if r == rounds - 1:
                    sight.late |= found
            else:
                calm = before, after
        before_now = sight.unsure.sum()
        sight.looked(before[:, -1], after[:, -1])  # what lies beyond might have gone on
        if calm is not None and sight.unsure.sum() == before_now:
            break
    return good


def additive_outliers(x: np.ndarray, series: np.ndarray, spread: np.ndarray, phi: np.ndarray, usable: np.ndarray, rounds: int = 1000, sight: Sight | None = None) -> np.ndarray:
    """Spikes by robust autoregression with iterative tests of additive outliers against level shifts.

    The forecast of a reading is the level (the median of ``SIDE`` good readings) before it plus ``phi``, to the power of the steps
    between, times the nearest good reading's deviation from that level, clipped at CLIP spreads; the backcast is the same from after.
    A residual over TIMES spreads against the forecast alone is a shift of level; against both, the reading is an
    additive outlier.  Outliers leave levels and neighbours, and the next round begins.  At last only runs of at most ``LONGEST`` outliers
    stay whose neighbours hold the level on either side.
    """
    sight = sight or Sight(series, (False, False))
    allow = TIMES * spread + 1e-9 * np.maximum(1, np.abs(np.where(usable, x, 0)))
    place = np.arange(len(x))

    def levels(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level of the good readings at these positions, and the deviation from it that they forecast."""
        level = _median(x, at)
        near = np.where(at[:, 0] >= 0, x[at[:, 0]], np.nan)
        return level, phi ** np.abs(place - at[:, 0]) * np.clip(near - level, -CLIP * spread, CLIP * spread)

    def find(before: np.ndarray, after: np.ndarray, good: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            forecast, backcast = (np.add(*levels(at)) for at in (before, after))
            off, shifted = np.abs(x - forecast) > allow, ~(np.abs(x - backcast) > allow)
            return good & off & ~shifted & (before[:, 0] >= 0) & (after[:, 0] >= 0)

    good = _rounds(find, usable, series, SIDE, rounds, sight)
    outlier = usable & ~good
    if not outlier.any():
        return outlier
    before, after = _neighbours(good, series, SIDE)
    sight.looked(before[:, -1], after[:, -1])
    # runs of outliers in the order of readings, bounded by readings that hold the level
    starts = outlier & ~np.r_[False, outlier[:-1] & (series[1:] == series[:-1])]
    run = np.cumsum(starts) - 1
    length = np.bincount(run[outlier], minlength=starts.sum())
    first = np.flatnonzero(starts)
    last = first + length - 1
    prev, nxt = before[first, 0], after[last, 0]
    # a run is judged as one: unsure if any of it or of its neighbours is
    upto = np.r_[0, np.cumsum(sight.unsure)]
    doubt = upto[np.where(nxt >= 0, nxt, last) + 1] > upto[np.where(prev >= 0, prev, first)]
    with np.errstate(invalid="ignore"):
        held = (np.abs(x[prev] - _median(x, before[first])) <= allow[first]) & (np.abs(x[nxt] - _median(x, after[last])) <= allow[last]) & (prev >= 0) & (nxt >= 0)
    sight.unsure |= outlier & doubt[np.clip(run, 0, None)]
    return outlier & (held & (length <= LONGEST))[np.clip(run, 0, None)]


def disorder(x: np.ndarray, series: np.ndarray, usable: np.ndarray, rounds: int = 1000, sight: Sight | None = None) -> np.ndarray:
    """Readings of a running count above those that follow or below those before, by medians of ``SIDE`` on each side.

    A reading that both sides contradict goes first, since it also makes its neighbours look wrong.
    """
    sight = sight or Sight(series, (False, False))

    def find(strict: bool):
        def inner(before: np.ndarray, after: np.ndarray, good: np.ndarray) -> np.ndarray:
            low, high = _median(x, before), _median(x, after)
            with np.errstate(invalid="ignore"):
                out = good & ((x > high) | (x < low))
                # outside the span of both sides, which agree with each other
                return out & (low <= high) if strict else out
        return inner

    good = usable
    for strict in (True, False):
        good = _rounds(find(strict), good, series, SIDE, rounds, sight)
    return usable & ~good


def stuck_runs(x: np.ndarray, series: np.ndarray) -> np.ndarray:
    """Readings of runs of at least ``STUCK`` equal readings in a row."""
    if not len(x):
        return np.zeros(0, bool)
    new = np.r_[True, (x[1:] != x[:-1]) | (series[1:] != series[:-1])]
    run = np.cumsum(new) - 1
    return (np.bincount(run) >= STUCK)[run]


def flag(t: dict[str, np.ndarray], limits: dict[tuple[str, str], Limits], rounds: int = 1000, cut: tuple[bool, bool] = (False, False)) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the readings of one chunk (0 fine, 1 limit, 2 spike, 3 disorder, 4 stuck), and which of them more might change.

    ``kind`` is the place of a reading's field in ``limits``, ``above`` whether it exceeds its bound.  ``cut``: whether the series of the first and of the last reading go on beyond the chunk.
    """
    x, series, spread = t["value"], t["series"], t["spread"]
    code, unsure = np.zeros(len(x), np.int8), np.zeros(len(x), bool)
    for kind, rule in enumerate(limits.values()):
        own = t["kind"] == kind
        if not own.any():
            continue
        v, s, w, phi = x[own], series[own], np.nan_to_num(spread[own]), np.nan_to_num(t["phi"][own])
        finite = np.isfinite(v)
        with np.errstate(invalid="ignore"):
            off = ~finite | (v < rule.low) | (v > rule.high) | ((v == rule.low) & rule.low_is_bad)
            if rule.kind == "count":
                off |= t["above"][own]
        got = np.zeros(len(v), np.int8)
        got[stuck_runs(v, s) & finite & (w > 0)] = 4
        safe = np.where(finite, v, 0.0)
        sight = Sight(s, (cut[0] and bool(own[0]), cut[1] and bool(own[-1])))
        if rule.kind == "rate":
            got[additive_outliers(safe, s, w, phi, finite & ~off, rounds, sight)] = 2
        else:
            got[disorder(safe, s, finite & ~off, rounds, sight)] = 3
        got[off] = 1
        code[own], unsure[own] = got, sight.unsure | sight.late
    return code, unsure


NAMES = np.array(["", "limit", "spike", "disorder", "stuck"], dtype=object)
OPEN = "open"  # the reason of a row that stands for a chunk to be judged again


SERIES = ["source_table", "field_name", "camera_id", "session_id"]
KEYS = ["kind", "camera_id", "session_id"]  # the same with the field's place in the limits
SORTED = "kind byte, camera_id string, session_id string, row_id long, at long, eligible boolean, value double, above boolean"
STEPS = "step double, step2 double, edge boolean"


def _with_steps(batches: Iterator[pa.RecordBatch], series: list[str] = SERIES) -> Iterator[pa.RecordBatch]:
    """Adds the absolute steps from the reading before and from the one before that, null where the series or the partition begins.

    The first two and the last two rows of the partition are marked.
    """
    keys: list[np.ndarray] = [np.zeros(0, object)] * len(series)
    values, held, seen = np.zeros(0), None, 0

    def done(b: pa.RecordBatch, edge: np.ndarray) -> pa.RecordBatch:
        return b.append_column("edge", pa.array(edge))

    for b in batches:
        if not b.num_rows:
            continue
        keys = [np.concatenate([k, b.column(c).to_numpy(zero_copy_only=False)]) for k, c in zip(keys, series)]
        values = np.concatenate([values, b.column("value").to_numpy(zero_copy_only=False)])
        for name, lag in (("step", 1), ("step2", 2)):
            step = np.full(len(values), np.nan)
            if len(values) > lag:
                with np.errstate(invalid="ignore"):
                    step[lag:] = np.abs(values[lag:] - values[:-lag])
                step[lag:][~np.logical_and.reduce([k[lag:] == k[:-lag] for k in keys])] = np.nan
            step[~np.isfinite(step)] = np.nan
            b = b.append_column(name, pa.array(step[len(values) - b.num_rows:], from_pandas=True))
        edge = np.arange(seen, seen + b.num_rows) < 2
        seen += b.num_rows
        keys, values = [k[-2:] for k in keys], values[-2:]
        if held is not None and b.num_rows < 2:  # the last row but one may lie in the batch before
            b, edge = pa.Table.from_batches([held[0], b]).combine_chunks().to_batches()[0], np.r_[held[1], edge]
        elif held is not None:
            yield done(*held)
        held = b, edge
    if held is not None:
        held[1][-2:] = True
        yield done(*held)


def _seams(placed: DataFrame) -> list[tuple]:
    """Steps from one partition into the next, from at most four rows a partition."""
    rows = placed.where("edge").select("_at", *KEYS, "value").orderBy("_at").collect()
    out = []
    for j, r in enumerate(rows):
        place = r._at & (1 << 33) - 1
        steps = [None, None]
        for lag in (1, 2):
            if place < lag <= j and all(r[c] == rows[j - lag][c] for c in KEYS):
                step = abs(r.value - rows[j - lag].value)
                steps[lag - 1] = step if np.isfinite(step) else None
        if steps != [None, None]:
            out.append((*[r[c] for c in KEYS[:2]], *steps))
    return out


PIECE = "chunk long, start long, piece binary"


def _pieces(size: int, halo: int, last: int):
    """For ``mapInArrow``: readings that follow each other by ``position``, packed for every chunk of ``size`` that they are in or next to."""

    def packed(b: pa.RecordBatch) -> bytes:
        out = BytesIO()
        pq.write_table(
            pa.Table.from_batches([b]), out, compression="zstd", use_dictionary=["camera_id", "session_id", "value"],
            column_encoding={"row_id": "DELTA_BINARY_PACKED", "at": "DELTA_BINARY_PACKED"}, write_statistics=False, store_schema=False,
        )
        return out.getvalue()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            position = b.column("position").to_numpy()
            b = b.drop_columns(["position"])
            breaks = np.flatnonzero(np.diff(position) != 1) + 1  # one task may read several files
            for begin, end in zip([0, *breaks.tolist()], [*breaks.tolist(), len(position)]):
                start, stop = int(position[begin]), int(position[end - 1]) + 1
                for chunk in range(max(0, (start - halo) // size), min(last, (stop - 1 + halo) // size) + 1):
                    low, high = max(start, chunk * size - halo), min(stop, (chunk + 1) * size + halo)
                    yield pa.RecordBatch.from_pydict({"chunk": [chunk], "start": [low], "piece": [packed(b.slice(begin + low - start, high - low))]})

    return pieces


def _unpacked(pieces: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The readings of a chunk in their order, and their positions; cameras and sessions are dictionaries."""
    parts, positions = [], []
    for p in pieces.sort_by("start").to_pylist():
        parts.append(pq.read_table(BytesIO(p["piece"]), read_dictionary=["camera_id", "session_id"]))
        positions.append(np.arange(p["start"], p["start"] + len(parts[-1])))
    return pa.concat_tables(parts).unify_dictionaries().combine_chunks(), np.concatenate(positions)


def flagged(rows: DataFrame, limits: dict[tuple[str, str], Limits], scratch: Scratch | None = None) -> DataFrame:
    """(source_table, field_name, camera_id, session_id, row_id, at, value, reason) of implausible readings.

    ``rows`` has the schema ``READINGS``.  The usual spread of a camera's field is the median absolute step between
    neighbouring finite readings of its sessions (a sketch with relative rank error 1e-4); with spread 0 the
    camera reports a constant.  Its coefficient follows from the median step over two readings: for a first-order autoregression the
    squares of the two are as 1 : 1 + phi.  An empty input gives an empty result.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark)
    order = [*KEYS, "at", "row_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = F.coalesce(*[F.when((F.col("source_table") == source) & (F.col("field_name") == field), F.lit(i).cast("byte")) for i, (source, field) in enumerate(limits)])
    sortable = rows.select(
        kind.alias("kind"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("camera_id", "session_id")], "row_id", F.unix_micros("at").alias("at"),
        F.coalesce("eligible", F.lit(False)).alias("eligible"), "value",
        F.coalesce(F.col("value") > F.col("bound"), F.lit(False)).alias("above"),
    ).where("kind is not null")
    placed = scratch.save(
        sortable.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(lambda batches: _with_steps(batches, KEYS), f"{SORTED}, {STEPS}")
        .withColumn("_at", F.monotonically_increasing_id()),
        options={"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"},  # delta encoding
    )
    at = with_offsets(placed, "position")
    camera = KEYS[:2]
    steps = placed.where("step is not null or step2 is not null").select(*camera, "step", "step2")
    seams = _seams(placed)
    if seams:
        steps = steps.unionByName(spark.createDataFrame(seams, "kind byte, camera_id string, step double, step2 double"))
    usual = steps.groupBy(*camera).agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in ("step", "step2")])
    phi = F.when(F.col("step") > 0, F.least(F.lit(PHI), F.greatest(F.lit(-PHI), F.pow(F.col("step2") / F.col("step"), 2) - 1))).otherwise(F.lit(0.0))
    usual = usual.select(*camera, F.col("step").alias("spread"), F.coalesce(phi, F.lit(0.0)).alias("phi"))
    total, rounds, halo = scratch.count(placed), ROUNDS, HALO
    while True:
        final = max(0, total - 1) // CHUNK
        first, last = F.floor((F.col("position") - halo) / CHUNK), F.floor((F.col("position") + halo) / CHUNK)
        # what is usual for a chunk's cameras travels with it, so that no hot camera is joined row by row
        wanted = at.select(*camera, F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(final)))).alias("chunk")).distinct().join(usual, camera, "left").select(
            F.col("chunk").alias("for_chunk"), *[F.col(c).alias(f"for_{c}") for c in camera], "spread", "phi"
        )
        chunked = at.select(*[c.split()[0] for c in SORTED.split(", ")], "position").mapInArrow(_pieces(CHUNK, halo, final), PIECE)
        got = scratch.save(chunked.groupBy("chunk").cogroup(wanted.groupBy("for_chunk")).applyInArrow(_judge(limits, rounds, total), FOUND), F.col("reason") != OPEN, open=F.count_if(F.col("reason") == OPEN))
        if not scratch.watched(got, "open"):
            return got.withColumn("at", F.timestamp_micros("at"))
        scratch.drop(got)
        rounds, halo = rounds * WIDER, halo * WIDER


FOUND = "source_table string, field_name string, camera_id string, session_id string, row_id long, at long, value double, reason string"


def _judge(limits: dict[tuple[str, str], Limits], rounds: int, total: int):
    size = CHUNK
    sources, fields = (pa.array([k[i] for k in limits], pa.string()) for i in (0, 1))
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in FOUND.split(", ")])

    def judge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        t, position = _unpacked(left)
        c = {n: t[n].to_numpy() for n in ("kind", "value", "above", "eligible")}
        codes = {n: t[n].chunk(0).indices.to_numpy() for n in ("camera_id", "session_id")}
        ids = np.stack([c["kind"], codes["camera_id"], codes["session_id"]])
        c["series"] = np.cumsum(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(axis=0)])
        usual = {(r["for_kind"], r["for_camera_id"]): (r["spread"], r["phi"]) for r in right.to_pylist()}
        names = t["camera_id"].chunk(0).dictionary.to_pylist()
        cameras, of = np.unique(ids[:2], axis=1, return_inverse=True)
        known = np.array([usual.get((int(k), names[i]), (None, None)) for k, i in cameras.T], dtype=float).reshape(-1, 2)
        c["spread"], c["phi"] = known[of.reshape(-1)].T
        code, unsure = flag(c, limits, rounds, (bool(position[0] > 0), bool(position[-1] < total - 1)))
        own = position // size == key[0].as_py()
        found = np.flatnonzero((code > 0) & own & c["eligible"])
        reasons = NAMES[code[found]]
        if (unsure & own).any():
            found, reasons = np.append(found, 0), np.append(reasons, OPEN)
        rows, kinds = t.take(pa.array(found)), pa.array(c["kind"][found])
        return pa.Table.from_arrays([
            sources.take(kinds), fields.take(kinds), rows["camera_id"].cast(pa.string()), rows["session_id"].cast(pa.string()), rows["row_id"], rows["at"], rows["value"], pa.array(reasons, pa.string()),
        ], schema=schema)

    return judge


FPS = Limits("rate", 0.0, False, 240.0)
REPORTED_FPS = Limits("rate", 0.0, True, 240.0)
DROPPED = Limits("count")
LIMITS = {
    ("runtime_status", "processing_fps"): FPS,
    ("runtime_status", "frames_dropped"): DROPPED,
    ("rtsp_metrics", "reported_source_fps"): REPORTED_FPS,
}


def camera_readings(status: DataFrame, metrics: DataFrame) -> DataFrame:
    """The readings of the three monitored fields; a status row of unreadable time counts at its arrival."""
    when = F.coalesce(instant(F.col("updated_at_utc")), F.col("received_at").cast("timestamp"))
    running = F.lower(F.trim("state")) == "running"
    return all_readings(status, "runtime_status", {"processing_fps": None, "frames_dropped": "frames_received"}, "status_id", when, running, tie="received_at").unionByName(
        all_readings(metrics, "rtsp_metrics", {"reported_source_fps": None}, "metric_id", F.col("snapshot_at").cast("timestamp"))
    )
