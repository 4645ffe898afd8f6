"""Live ingestion: latest frame wins, everything else is counted as dropped."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def latest_per_camera(batch: DataFrame) -> DataFrame:
    """Of each camera's frames in a batch the one of the highest sequence, and the accounting received = 1 + dropped."""
    rest = [c for c in batch.columns if c not in ("camera_id", "sequence")]
    return batch.groupBy("camera_id").agg(F.max(F.struct("sequence", *rest)).alias("_r"), F.count(F.lit(1)).alias("received")).select("camera_id", "_r.*", "received", (F.col("received") - 1).alias("dropped"))


def conflating_writer(path: str):
    """A foreachBatch function that delivers ``latest_per_camera``; a batch that runs again replaces its own output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_per_camera(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


class FrameLog(DataSource):
    """Stream source over a log of reads, one JSON object a line: {"camera_id", "ok", "width", "height"}.

    Reads that fail count; ``threshold`` failures in a row count as a reconnection, and a good read ends the row.  Rows
    carry the counters as they stood at the read.
    """

    @classmethod
    def name(cls) -> str:
        return "frame_log"

    def schema(self) -> str:
        return "camera_id string, sequence long, width int, height int, failed_reads long, reconnects long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FrameLogReader(self.options["path"], int(self.options.get("threshold", "5")), int(self.options.get("rows", "10000")))


class FrameLogReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, threshold: int, rows: int):
        self.path, self.threshold, self.rows = path, threshold, rows

    def initialOffset(self) -> dict:
        return {"line": 0, "byte": 0, "cameras": {}}

    def _read(self, start: dict, until: int | None) -> tuple[list[tuple], dict]:
        cameras = {k: list(v) for k, v in start["cameras"].items()}
        out, line, byte = [], start["line"], start["byte"]
        if os.path.exists(self.path):
            with open(self.path, "rb") as f:
                f.seek(byte)
                while line < until if until is not None else len(out) < self.rows:
                    text = f.readline()
                    if not text.endswith(b"\n"):  # not wholly written yet
                        break
                    byte, line = byte + len(text), line + 1
                    try:
                        r = json.loads(text)
                        camera = r["camera_id"]
                    except (ValueError, KeyError, TypeError):
                        continue
                    sequence, failed, streak, reconnects = cameras.get(camera, [0, 0, 0, 0])
                    if r.get("ok", True):
                        sequence, streak = sequence + 1, 0
                        out.append((camera, sequence, r.get("width"), r.get("height"), failed, reconnects))
                    else:
                        failed, streak = failed + 1, streak + 1
                        if streak == self.threshold:
                            reconnects, streak = reconnects + 1, 0
                    cameras[camera] = [sequence, failed, streak, reconnects]
        return out, {"line": line, "byte": byte, "cameras": cameras}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._read(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._read(start, end["line"])[0])
