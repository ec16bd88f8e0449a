"""Shared helpers of the training-data operators: tables, staged results, partition counts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

#: Once a table is written, nobody reads the shuffles that made it.
FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_BLOOM = "spark.sql.optimizer.runtime.bloomFilter."
SIFT = {f"{_BLOOM}enabled": "true", f"{_BLOOM}applicationSideScanSizeThreshold": "32m", f"{_BLOOM}creationSideThreshold": "512m"}
#: Rows of one key that a task takes whatever the table's size; beyond, as many as leave at most MOST_HOT keys split.
LEAST_HOT, MOST_HOT = 1024, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``; only Spark's reader opens the path.

    A table of fewer splits than there are cores, a single row group say, is dealt over them, so that none idles.
    """
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per context, through Spark's own file server."""
    sc = spark.sparkContext
    if not getattr(sc, "_archweave_shipped", False):
        root = Path(__file__).resolve().parents[1]
        path = f"{tempfile.mkdtemp(prefix='ship-')}/archweave.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"archweave/{f.relative_to(root)}")
        sc.addPyFile(path)
        sc._archweave_shipped = True
    # what a Python worker holds at once is bounded in rows and bytes, so long documents do not add up
    for key, most in BATCH.items():
        spark.conf.set(key, most)
    return spark


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for one action and are then what they were."""
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sifted(spark: SparkSession):
    """Joins of a large scan with a small filtered table drop rows by a Bloom filter before the shuffle.

    Spark bounds the filter's bits whatever the table holds (8 MB by default), and the join that follows is exact.
    """
    return settings(spark, SIFT)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, on one machine only, a local one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name its shared folder in spark.checkpoint.dir")
        set_dir = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


class Stage:
    """Tables written to the shared folder to cut lineage; ``drop`` frees those that are no longer read.

    A lost executor costs no more than the running stage: what is written here is read again from storage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, *told: Column) -> DataFrame:
        """The table as it is read from storage. Its number of rows, and what ``told`` says of it, are seen as it is written."""
        self.count += 1
        path, seen = f"{self.root}/{self.count}", Observation()
        with settings(self.spark, FREE_SHUFFLES):
            df.observe(seen, F.count(F.lit(1)).alias("rows"), *told).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at, out._seen = path, seen.get  # noqa: SLF001  drop() finds the files by the one, heat() the rows by the other
        return out

    def checked(self, df: DataFrame) -> tuple[DataFrame, tuple]:
        """``write``, and what tells one table's rows from another's: their number and the sum of their hashes."""
        out = self.write(df, F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum"))
        return out, (out._seen["rows"], out._seen["sum"])  # noqa: SLF001

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            if path := getattr(df, "_staged_at", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def heat(df: DataFrame, each: int = 1) -> int:
    """Rows of one key that one task takes. Of ``each`` rows a row of ``df``, a staged table, MOST_HOT keys at most have more."""
    return max(LEAST_HOT, -(-df._seen["rows"] * each // MOST_HOT))  # noqa: SLF001


def spread(df: DataFrame) -> DataFrame:
    """Each row once for each of the ``ways`` places that its key lies in, named by ``salt``."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))


def meet(big: DataFrame, small: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Equi-join of ``big`` with ``small``, a staged table with one row per key and the places it takes in ``ways``.

    Rows of ``big`` are dealt over the places of their key by the hash of ``by``; result columns ``ways`` and ``salt``
    say how. Sent to all tasks are the split keys only, at most MOST_HOT of them if ``ways`` goes by ``heat``.
    """
    split = F.broadcast(small.filter("ways > 1").select(*keys, "ways"))
    dealt = big.join(split, keys, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("ways", F.lit(1))).cast("int")).drop("ways")
    return dealt.join(spread(small), [*keys, "salt"])


_KEPT: dict[str, Callable[[], None]] = {}


def keeps(module: str, forget: Callable[[], None]) -> None:
    """A module of this process keeps what it has worked out from task to task; ``forget`` lets go of it."""
    _KEPT[module] = forget


def turn(module: str) -> None:
    """Before a module's stage runs in this process, the others let go: workers outlive stages, and their memories would add up."""
    for other, forget in list(_KEPT.items()):
        if other != module:
            forget()


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift a function on one Arrow batch to the iterator that mapInArrow wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn(fn.__module__)
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return run
