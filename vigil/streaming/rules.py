"""The rules as a Structured Streaming query: one row a frame, state a camera and session.

A row holds a whole frame, also an empty one, so that its tracks are judged together.  The state machine follows the same
semantics as the windows in ``operators.rules``; a test holds one against the other.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

EPS = 1e-9
FRAME = "camera_id string, session_id string, frame_number long, timestamp_seconds double, tracks array<struct<track_id:long,x:double,y:double,height:double,confidence:double>>"
EVENTS = "camera_id string, session_id string, kind string, zone_id string, track_id long, frame_number long, timestamp_seconds double, value double"


@dataclass(frozen=True)
class Zone:
    zone_id: str
    restricted: bool
    polygon: tuple[tuple[float, float], ...]
    inside_after: float
    outside_after: float
    ttl: float

    def holds(self, x: float, y: float) -> bool:
        odd = False
        for (ax, ay), (bx, by) in zip(self.polygon, self.polygon[1:] + self.polygon[:1]):
            turn = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
            if abs(turn) <= EPS and min(ax, bx) - EPS <= x <= max(ax, bx) + EPS and min(ay, by) - EPS <= y <= max(ay, by) + EPS:
                return True
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                odd = not odd
        return odd


@dataclass(frozen=True)
class Thresholds:
    alone_after: float = 3.0
    reset_after: float = 1.0
    still_after: float = 600.0
    ratio: float = 0.10
    least_pixels: float = 5.0
    still_ttl: float = 2.0


@dataclass
class Machine:
    """All rules of one camera and session.  Everything it keeps is plain data, so that it pickles into the state."""

    zones: tuple[Zone, ...]
    limits: Thresholds
    presence: dict = field(default_factory=dict)  # (track, zone): last seen, raw side, since when, confirmed side
    alone: dict = field(default_factory=dict)  # zone: since, reset since, told
    anchors: dict = field(default_factory=dict)  # track: x, y, height, since, last seen, told
    clock: float | None = None

    def step(self, frame: int, t: float, tracks: Iterable[tuple[int, float, float, float]]) -> Iterator[tuple[str, str | None, int | None, float]]:
        """(kind, zone, track, value) of one frame; a frame older than the last gives one row of the kind late."""
        if self.clock is not None and t < self.clock:
            yield "late", None, None, self.clock - t
            return
        self.clock = t
        confirmed: dict[str, list[int]] = {z.zone_id: [] for z in self.zones}
        tracks = list(tracks)
        for track, x, y, _ in tracks:
            for z in self.zones:
                raw = z.holds(x, y)
                seen, side, since, sure = self.presence.get((track, z.zone_id), (None, raw, t, None))
                if seen is not None and t - seen > z.ttl:
                    side, since, sure = raw, t, None
                elif raw != side:
                    side, since = raw, t
                if t - since + EPS >= (z.inside_after if raw else z.outside_after):
                    if raw and sure is False and z.restricted:
                        yield "BAR-001", z.zone_id, track, t
                    sure = raw
                self.presence[track, z.zone_id] = (t, side, since, sure)
                if sure:
                    confirmed[z.zone_id].append(track)
        for z in self.zones:
            inside = confirmed[z.zone_id]
            yield "IDT-004", z.zone_id, None, float(len(inside))
            since, reset, told = self.alone.get(z.zone_id, (None, None, False))
            if len(inside) == 1:
                since, reset = t if since is None else since, None
                if not told and t - since + EPS >= self.limits.alone_after:
                    told = True
                    yield "EXC-002", z.zone_id, inside[0], t - since
            elif since is not None:
                reset = t if reset is None else reset
                if t - reset + EPS >= self.limits.reset_after:
                    since, reset, told = None, None, False
            self.alone[z.zone_id] = (since, reset, told)
        for track, x, y, height in tracks:
            where = next((z.zone_id for z in self.zones if track in confirmed[z.zone_id]), None)
            if where is None:
                continue
            ax, ay, ah, since, seen, told = self.anchors.get(track, (x, y, height, t, t, False))
            moved = math.hypot(x - ax, y - ay) > max(self.limits.least_pixels, self.limits.ratio * max(ah, height))
            if t - seen > self.limits.still_ttl or moved:
                ax, ay, ah, since, told = x, y, height, t, False
            if not told and t - since + EPS >= self.limits.still_after:
                told = True
                yield "ERG-006", where, track, t - since
            self.anchors[track] = (ax, ay, ah, since, t, told)
        self._forget(t)

    def _forget(self, t: float) -> None:
        """Drop tracks whose time to live is over, so that the state stays as small as the scene."""
        ttl = {z.zone_id: z.ttl for z in self.zones}
        self.presence = {k: v for k, v in self.presence.items() if t - v[0] <= ttl[k[1]]}
        self.anchors = {k: v for k, v in self.anchors.items() if t - v[4] <= self.limits.still_ttl}


def rule_stream(frames: DataFrame, zones: dict[str, tuple[Zone, ...]], limits: Thresholds, strict: bool = False, idle_seconds: int | None = None) -> DataFrame:
    """Events of a stream of frames in the schema ``FRAME``; late frames come out as rows or, if ``strict``, fail the query.

    With ``idle_seconds`` the state of a session that got no frame for so long, in processing time, is dropped.  That is for streams without
    end: a query with such a timeout goes on with empty batches, so it never ends by itself.
    """

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        camera, session = key
        if state.hasTimedOut:
            state.remove()
            return
        machine = pickle.loads(state.get[0]) if state.exists else Machine(zones.get(camera, ()), limits)
        rows = pd.concat(list(batches)).sort_values(["timestamp_seconds", "frame_number"])
        out = []
        for r in rows.itertuples(index=False):
            for kind, zone, track, value in machine.step(r.frame_number, r.timestamp_seconds, [(k["track_id"], k["x"], k["y"], k["height"]) for k in (r.tracks if r.tracks is not None else [])]):
                if kind == "late" and strict:
                    raise ValueError(f"{camera}/{session}: frame {r.frame_number} is {value} s late")
                out.append((camera, session, kind, zone, track, r.frame_number, r.timestamp_seconds, value))
        state.update((pickle.dumps(machine),))
        if idle_seconds is not None:
            state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"track_id": "Int64"})

    return frames.groupBy("camera_id", "session_id").applyInPandasWithState(advance, EVENTS, "machine binary", "append", GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout)
