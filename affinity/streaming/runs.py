"""A table of runs: what each micro-batch changed, merged by levels.

A streaming job writes one *run* per micro-batch, which holds only what the
batch changed. After every ``FAN`` runs of a level they are folded into one run of
the next, so a row is rewritten once per level (the logarithm of the number of
batches) and never because some other key changed. A reader takes, from batch 0
on, the longest run that starts where the last one ended, and folds those few.

Runs are Parquet folders under a shared path, named by level, first and last
batch, and count once Spark has marked them complete. A batch that is replayed after a failure
writes its own run again from the same inputs; runs that were folded are kept until
the next fold of their level. A run that is missing between two others is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Runs of one level that make one run of the next.
FAN = 8
_NAME = re.compile(r"L(\d+)-(\d+)-(\d+)$")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_dir(spark: SparkSession, root: str) -> list[str]:
    """Child names of a folder on whatever file system the path names (Hadoop FS API)."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    return [st.getPath().getName() for st in fs.listStatus(path)]


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@dataclass(frozen=True)
class Runs:
    """Runs under ``root``; ``fold`` merges the union of several of them, oldest and newest alike.

    ``fold`` must be associative: folding folded runs equals folding them all at once.
    ``by`` names columns that the runs' files are laid out by (a reader of few keys skips the rest).
    """

    root: str
    fold: Callable[[DataFrame], DataFrame]
    by: tuple[str, ...] = ()
    fan: int = FAN

    def _path(self, level: int, first: int, last: int) -> str:
        return f"{self.root.rstrip('/')}/L{level}-{first:010d}-{last:010d}"

    def _write(self, df: DataFrame, path: str) -> None:
        if self.by:
            df.repartition(*self.by).write.mode("overwrite").partitionBy(*self.by).parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)

    def add(self, changes: DataFrame, batch_id: int) -> None:
        """Write the run of a batch, then fold each level that the batch fills."""
        spark = changes.sparkSession
        self._write(changes, self._path(0, batch_id, batch_id))
        level, width = 1, self.fan
        while (batch_id + 1) % width == 0:
            first, child = batch_id + 1 - width, width // self.fan
            parts = [self._path(level - 1, a, a + child - 1) for a in range(first, batch_id + 1, child)]
            self._write(self.fold(self._read(spark, parts, changes.schema)), self._path(level, first, batch_id))
            for a in range(first - width, first, child):  # the parts of the fold before this one
                if a >= 0:
                    remove(spark, self._path(level - 1, a, a + child - 1))
            level, width = level + 1, width * self.fan

    def run(self, spark: SparkSession, batch_id: int, schema) -> DataFrame:
        """The run of one batch, as it was written."""
        return self._read(spark, [self._path(0, batch_id, batch_id)], schema)

    @staticmethod
    def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
        out = spark.read.schema(schema).parquet(paths[0])
        for p in paths[1:]:
            out = out.unionByName(spark.read.schema(schema).parquet(p))
        return out

    def cover(self, spark: SparkSession, before: int | None = None) -> list[str]:
        """The fewest complete runs that hold every batch (every one ``before`` a batch), in batch order.

        The parts of the newest fold of a level are still there, so a batch that is replayed finds what came before it.
        """
        found: dict[int, tuple[int, str]] = {}
        for name in list_dir(spark, self.root):
            m = _NAME.match(name)
            if m and exists(spark, f"{self.root}/{name}/_SUCCESS"):
                level, first, last = (int(x) for x in m.groups())
                if before is not None and last >= before:
                    continue
                found[first] = max(found.get(first, (-1, "")), (last, self._path(level, first, last)))
        end = max((last for last, _ in found.values()), default=-1)
        paths, at = [], 0
        end = end if before is None else before - 1
        while at <= end:
            if at not in found:
                raise RuntimeError(f"{self.root}: no run starts at batch {at}, though later ones are there")
            at, path = found[at][0] + 1, found[at][1]
            paths.append(path)
        return paths

    def read(self, spark: SparkSession, schema, before: int | None = None) -> DataFrame:
        """The table as of the newest complete batch, or as it was ``before`` one (without rows before the first)."""
        paths = self.cover(spark, before)
        if not paths:
            if before is not None:
                return spark.createDataFrame([], schema)
            raise RuntimeError(f"no state written under {self.root}")
        return self.fold(self._read(spark, paths, schema))
