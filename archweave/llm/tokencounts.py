"""Token counts kept up to date by signed deltas.

A change is a signed row: +1 inserts a document, -1 deletes it, and a revision is its old row with -1 and its new row
with +1. A batch becomes additive totals by source, language and tokenizer version, written aside and moved into place
in one rename that never overwrites; a batch that is in place is never applied again, so a retry or a replay changes
nothing, and of two writers of one batch one alone reports success. Totals are the sum over the batches in place.
``compact`` folds them into one base with the names of its batches, so that what is read does not grow with time.

Defined results: null text counts as empty; null source or language is a group of its own; repeated rows count as
often as they occur; texts are counted whole; a batch without rows is committed as empty; groups whose documents have
all gone keep a row of zeros out of the totals; columns but those named are not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-pair vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Counter = Callable[[str], int]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def words_v1() -> Counter:
    return lambda text: len(text.encode("utf-8", "surrogatepass").split())


def byte_pairs(path: str = RANKS) -> Callable[[], Counter]:
    """A maker of counters; the driver reads the vocabulary, which travels with the task."""
    raw = Path(path).read_bytes()

    def make() -> Counter:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        enc = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(enc.encode_ordinary(text))

    return make


def deltas(changes: DataFrame, tokenizers: Mapping[str, Callable[[], Counter]]) -> DataFrame:
    """Totals of signed rows (sign, source, lang, text); each task adds up its own rows before the shuffle."""
    made = dict(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {k: make() for k, make in made.items()}
        for batch in batches:
            total: dict[tuple, list[int]] = {}
            for sign, source, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, count in counters.items():
                    row = total.setdefault((source, lang, k), [0, 0])
                    row[0] += sign
                    row[1] += sign * count(text or "")
            cols = list(zip(*((*k, *v) for k, v in total.items()), strict=True))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["source", "lang", "tokenizer", "docs", "tokens"])

    rows = changes.select(F.col("sign").cast("int").alias("sign"), "source", "lang", "text").mapInArrow(run, DELTA)
    return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Committed batches below ``root``, a folder of a store that renames atomically."""

    def __init__(self, spark: SparkSession, root: str, tokenizers: Mapping[str, Callable[[], Counter]]):
        self.spark, self.root, self.tokenizers = spark, root.rstrip("/"), tokenizers
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str, prefix: str) -> list[str]:
        top = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName().removeprefix(prefix) for s in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def _base(self) -> tuple[str | None, list[str]]:
        """The newest base and the batches that it holds."""
        names = self._names("bases", "base=")
        if not names:
            return None, []
        at = f"{self.root}/bases/base={names[-1]}"
        return at, sorted(r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{at}/batches").collect())

    def batches(self) -> list[str]:
        return sorted({*self._names("deltas", "batch="), *self._base()[1]})

    def _place(self, aside: str, home: str) -> bool:
        """Move a folder to a place that must be free; what came too late is deleted."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        there, late = self._path(home), self._path(aside)
        self._fs.mkdirs(there.getParent())
        try:
            never_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), conf).rename(late, there, never_overwrite)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
        # a store that moves a folder into one that is there has not put it in place either
        inside = self._path(f"{home}/{late.getName()}")
        lost = [p for p in (late, inside) if self._fs.exists(p)]
        for p in lost:
            self._fs.delete(p, True)
        return not lost

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False where it is in place, or was put there by another writer in the meantime."""
        if not batch or "/" in batch:
            raise ValueError("a batch needs a name without slashes")
        if batch in self.batches():
            return False
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        deltas(changes, self.tokenizers).write.parquet(aside)
        return self._place(aside, f"{self.root}/deltas/batch={batch}")

    def _rows(self) -> tuple[DataFrame, list[str]]:
        """Rows to add up, the base and the batches that it lacks, and the names of all of them."""
        base, held = self._base()
        new = [b for b in self._names("deltas", "batch=") if b not in held]
        paths = [f"{self.root}/deltas/batch={b}" for b in new] + ([f"{base}/totals"] if base else [])
        return (self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)), sorted([*held, *new])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        return _summed(self._rows()[0]).filter("docs <> 0 OR tokens <> 0")

    def compact(self) -> bool:
        """Put a new base in place, then drop the batches that the base before it held already; readers of that one have gone."""
        rows, names = self._rows()
        numbers, held = self._names("bases", "base="), self._base()[1]
        if not names:
            return False
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        _summed(rows).write.parquet(f"{aside}/totals")
        self.spark.createDataFrame([(b,) for b in names], "batch string").coalesce(1).write.parquet(f"{aside}/batches")
        done = self._place(aside, f"{self.root}/bases/base={int(numbers[-1]) + 1 if numbers else 0:08d}")
        for old in ([f"bases/base={n}" for n in numbers[:-1]] + [f"deltas/batch={b}" for b in held]) if done else []:
            self._fs.delete(self._path(f"{self.root}/{old}"), True)
        return done


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
