"""Session, table and scratch-table helpers.

Intermediate results that several later steps read, and every round of an iteration, are written as
Parquet below the shared folder named by ``spark.checkpoint.dir``.  That cuts the lineage and outlives a
lost executor.  Only where the setting is missing (tests, single machine) a temporary folder is used.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (one file or a folder of files) of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for scratch tables; it is removed when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(scratch_root, "local", None)
        if not base or not os.path.isdir(base):
            base = scratch_root.local = tempfile.mkdtemp(prefix="vigil-")
    root = f"{base.rstrip('/')}/vigil-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    return root


_roots: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may be gone already
        pass


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


class Scratch:
    """Scratch tables of one computation; ``drop`` frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
        self.seen: dict[int, dict] = {}
        self.paths: dict[int, str] = {}
        self.kept: list[DataFrame] = []  # so that no id is used twice
        self.made = 0

    def save(self, df: DataFrame, only: Column | None = None, drop: tuple[str, ...] = (), by: tuple[str, ...] = (), options: dict[str, str] | None = None, **watch: Column) -> DataFrame:
        """Write ``df`` and read it back.  ``count`` and ``watched`` then tell its number of rows and the aggregates
        ``watch`` without another job.  With ``only`` the aggregates see all rows, but just those that meet it are written and
        counted, without the columns ``drop``.  They lie in folders by the columns ``by``; ``options`` are the writer's."""
        path = f"{self.root}/{self.made}"
        self.made += 1
        seen = Observation()
        counted = F.count(F.lit(1)) if only is None else F.count_if(only)
        out = df.observe(seen, counted.alias("rows"), *[c.alias(k) for k, c in watch.items()])
        out = (out if only is None else out.where(only)).drop(*drop)
        out.write.options(**(options or {})).partitionBy(*by).parquet(path)
        back = self.spark.read.schema(out.schema).parquet(path)
        self.seen[id(back)] = seen.get
        self.paths[id(back)] = path
        self.kept.append(back)
        return back

    def parts(self, saved: DataFrame, by: str, **watch: Column) -> dict:
        """The parts of ``saved`` by each value of ``by``, of which there are few; one job finds the ``count`` and the aggregates ``watch`` of all."""
        parts = {}
        for row in saved.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in watch.items()]).collect():
            part = parts[row[by]] = saved.where(F.col(by) == row[by])
            self.seen[id(part)] = row.asDict()
            self.kept.append(part)
        return parts

    def count(self, saved: DataFrame) -> int:
        return self.seen[id(saved)].get("rows") or 0

    def watched(self, saved: DataFrame, name: str):
        return self.seen[id(saved)].get(name)

    def path(self, saved: DataFrame) -> str:
        return self.paths[id(saved)]

    def drop(self, *saved: DataFrame | None) -> None:
        for df in saved:
            if df is not None and id(df) in self.paths:
                _remove(self.spark, self.paths.pop(id(df)))
