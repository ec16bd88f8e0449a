"""Iteration to a fixed point: the one driver loop that every traversal runs on.

A round is one Spark job. Its result is written to the folder that driver and executors share, which cuts lineage and
outlives lost executors; rounds that no later one reads are deleted. The driver sees row counts only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Once a table is written, nobody reads the shuffles that made it.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Rounds:
    """Tables written between rounds."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("a cluster has to name its shared folder in spark.checkpoint.dir")
            root = "file://" + tempfile.mkdtemp(prefix="rounds-")
            spark.sparkContext.setCheckpointDir(root)
        self.root, self.n = f"{root.rstrip('/')}/rounds-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> tuple[DataFrame, str]:
        return self.append([df])

    def append(self, parts: Iterable[DataFrame]) -> tuple[DataFrame, str]:
        """Parts of one table, each written before the next is begun."""
        self.n += 1
        path, before = f"{self.root}/{self.n}", self.spark.conf.get(FREE_SHUFFLES)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            for df in parts:
                df.write.mode("append").parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path), path

    def load(self, paths: list[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*paths)

    def drop(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def frontier(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Breadth first: rows of ``start``, then what ``step`` makes of the newest rows and whose ``keys`` are new.

    ``start`` has to be distinct on ``keys``. A round joins the newest rows only; what is known is read, not redone.
    """
    rounds = Rounds(start.sparkSession)
    new, path = rounds.save(start)
    paths = [path]
    while not new.isEmpty():
        known = rounds.load(paths, new).select(keys)
        new, path = rounds.save(step(new).dropDuplicates(keys).join(known, keys, "left_anti").select(start.columns))
        paths.append(path)
    return rounds.load(paths, new)


def least_by_key(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], value: str) -> DataFrame:
    """Label correcting: per ``keys`` the row with the least ``value``, where ``step`` extends rows that got better."""
    rounds = Rounds(start.sparkSession)
    rest = [c for c in start.columns if c not in keys and c != value]
    best_of = lambda df: df.groupBy(*keys).agg(F.min(F.struct(value, *rest)).alias("b")).select(*keys, "b.*").select(start.columns)
    best, best_path = rounds.save(best_of(start))
    better, better_path = best, None
    while True:
        found = best_of(step(better))
        old = best.select(*keys, F.col(value).alias("__old"))
        gained, gained_path = rounds.save(found.join(old, keys, "left").filter(F.col("__old").isNull() | (F.col(value) < F.col("__old"))).drop("__old"))
        if better_path:
            rounds.drop(better_path)
        if gained.isEmpty():
            return best
        merged, merged_path = rounds.save(best.join(gained.select(keys), keys, "left_anti").select(start.columns).union(gained.select(start.columns)))
        rounds.drop(best_path)
        best, best_path, better, better_path = merged, merged_path, gained, gained_path
