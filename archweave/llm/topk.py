"""Exact top-k inner products by the threshold algorithm.

Vectors become whole numbers, floor(scale * x). Candidates are dealt to blocks by a keyed hash; in a block every
dimension is a sorted list. A query walks all lists in step, from the end that its sign prefers, scores whatever comes
up for the first time, and stops when its k-th best score beats the bound or nothing is left unseen. The bound is the
score of an imaginary vector made of the values at the present depth: no unseen vector can do better. Blocks give their
k best, and a ranking over blocks, which Spark cuts to k before it shuffles, gives the result.

Queries meet candidates block by block: a block of queries is copied to each block of candidates, so a task holds
BLOCK_QUERIES by BLOCK_ROWS vectors at most in expectation, whatever the tables hold. Equal vectors in a block are
one entry of the lists with their ids in order, so copies cost a tie nothing.

Where whole numbers are too large for floating point to add them without loss, the walk goes on until the bound, with
the largest error there can be on top, is beaten, and all that come within that error of the k-th are scored again in
whole numbers without limit.

Defined results: vectors that are null, hold a null or a component that is not finite once scaled, or are empty, take
no part; vectors of different length never meet; ties go to the smaller id; rows that repeat an id are candidates of
their own, but for queries of that id; fewer than k candidates give fewer rows; a score beyond the range of a long
counts as the nearest long; an empty table gives an empty result; columns but the two named are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS, BLOCK_QUERIES = 4096, 16_384
FIRST_DEPTH = 64
#: Up to these magnitudes floating point adds whole numbers without loss.
EXACT = ((np.float32, 2.0**24), (np.float64, 2.0**53))
LEAST, MOST = -(2**63), 2**63 - 1


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as double and without loss, null unless all components are finite."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    fine = F.forall(scaled, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) != float("inf")), F.lit(False)))
    # beyond 2 ** 53 there are whole numbers only, and floor would have to fit a long
    floor = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(F.when(F.abs(y) < 2.0**53, y).otherwise(0.0)).cast("double")).otherwise(y)
    return F.when((F.size(vector) > 0) & fine, F.transform(scaled, floor))


def exact(a: np.ndarray, b: np.ndarray) -> int:
    return min(MOST, max(LEAST, sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))))


class Lists:
    """Sorted per-dimension lists over the distinct vectors of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.x, inverse = np.unique(vectors[order], axis=0, return_inverse=True)
        inverse = inverse.ravel()
        by = np.argsort(inverse, kind="stable")
        self.ids, self.at = ids[order][by], np.searchsorted(inverse[by], np.arange(len(self.x) + 1))
        columns = np.ascontiguousarray(self.x.T)
        self.up = np.argsort(columns, axis=1, kind="stable")  # one list per dimension, rising
        self.sorted = np.take_along_axis(columns, self.up, axis=1)
        self.first = self.ids[self.at[:-1]]

    def top(self, q: np.ndarray, k: int, but: int, error: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for a query, without the id ``but``; by score, then id. ``error`` bounds that of a score."""
        n, d = self.x.shape
        used = np.flatnonzero(q)
        seen = np.zeros(n, bool)
        score = np.zeros(n, self.x.dtype)
        depth, done, best = FIRST_DEPTH, 0, None
        down = q > 0
        while True:
            depth = min(depth, n) if len(used) else n
            if len(used):
                falling, rising = used[down[used]], used[~down[used]]
                fresh = np.zeros(n, bool)
                fresh[self.up[falling, n - depth : n - done]] = True
                fresh[self.up[rising, done:depth]] = True
                fresh &= ~seen
            else:
                fresh = ~seen
            some = np.flatnonzero(fresh)
            if 3 * len(some) > n:  # reading the block through is cheaper than picking most of it
                score[some] = (self.x @ q)[some]
            else:
                score[some] = self.x[some] @ q
            seen |= fresh
            got = np.flatnonzero(seen)
            if depth == n or len(got) == n:  # no vector is left unseen
                break
            edge = np.where(down, self.sorted[:, n - depth], self.sorted[:, depth - 1])
            bound = edge @ q
            # k + 1 distinct vectors hold k candidates besides the query itself
            if len(got) > k and np.partition(score[got], len(got) - k - 1)[len(got) - k - 1] > bound + 2 * error:
                break
            done, depth = depth, depth * 2
        self.walked = depth / n, len(got) / n
        s = score[got]
        if len(got) > k + 1:  # all vectors that reach the (k + 1)-th best score
            got = got[s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1] - 2 * error]
        whole = [exact(self.x[i], q) for i in got] if error else [int(z) for z in score[got]]
        ranked = sorted((-z, int(key)) for i, z in zip(got, whole, strict=True) for key in self.ids[self.at[i] : min(self.at[i + 1], self.at[i] + k + 1)] if key != but)[:k]
        return np.array([key for _, key in ranked], np.int64), np.array([-z for z, _ in ranked], np.int64)


def block_top(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            x, q = (np.array(df["v"].tolist(), np.float64) for df in (rows, queries))
            with np.errstate(over="ignore"):
                largest = np.abs(x).max() * np.abs(q).max() * x.shape[1]
            kind = next((t for t, bar in EXACT if largest < bar), None)
            lists = Lists(rows["vec_id"].to_numpy(), x.astype(kind or np.float64))
            for key, v in zip(queries["vec_id"], q.astype(kind or np.float64), strict=True):
                error = 0.0 if kind else float(np.abs(x).max() * np.abs(v).sum()) * x.shape[1] * 2.0**-52
                ids, s = lists.top(v, k, key, error)
                out["query_id"] += [key] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += s.tolist()
        return pd.DataFrame(out).astype("int64")

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, *, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other vectors of its length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("v"), is_query.alias("q")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    n, n_q = rows.agg(F.count("*"), F.count_if("q")).first()
    row_blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_q // BLOCK_QUERIES))
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    d = F.size("v").alias("d")
    queries = rows.filter("q").select("vec_id", "v", d, block(query_blocks, 1).alias("qb"), every(row_blocks).alias("rb"))
    candidates = rows.select("vec_id", "v", d, every(query_blocks).alias("qb"), block(row_blocks, 2).alias("rb"))
    keys = ["d", "qb", "rb"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(block_top(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
