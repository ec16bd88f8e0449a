"""Quality from weak labels: overlapping heuristics vote, expectation-maximisation weighs them, a linear scorer learns.

Each heuristic says good (1), junk (-1) or nothing (0). Under the model that heuristics err independently given the
truth, EM over the counts of all vote patterns finds how often each is right; no label is used. Votes of ``m``
heuristics make 3 ** m patterns at most, a fixed bound, so the counts of the whole corpus fit the driver. Posteriors
of a bounded sample (``TRAIN_ROWS`` documents by keyed hash; a stated bound) train a logistic regression over hashed
token shapes, which scores every document.

Defined results: null and empty texts get no votes and no features, so they are kept, with the prior as their score;
texts are read whole; equal texts get equal scores; repeated rows count as one in the sample and each by itself
elsewhere; an empty table gives an empty result; columns but id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.llm.common import by_batch

TRAIN_ROWS, DIM, KEEP = 6_000, 4096, 0.5
#: Tokens from which capitals, repeats and shouts tell junk from a title.
FEW = 5

#: Frequent function words of four languages, as signs of running text.
FUNCTION_WORDS = frozenset("the of and to in is that it for with as was der die und das ist nicht mit von den sich le la les de et un une des que pour el los las y en por con del se para".split())

HEURISTICS = ("symbols", "capitals", "cells", "stutter", "lines", "exclaims", "function_words", "variety", "length")


@lru_cache(50_000)
def token_traits(token: str) -> tuple[int, int, int]:
    """Whether a token carries signs, shouts, or is a cell border."""
    letters = [c for c in token if c.isalpha()]
    signs = sum(not c.isalnum() and c not in ".,;:!?'\"()-" for c in token)
    return int(bool(letters) and signs >= 2), int(len(letters) > 1 and token.upper() == token and token.lower() != token), int(not letters and signs == len(token))


class Traits:
    """What heuristics and scorer read of a text, counted once: each distinct token is looked at once."""

    __slots__ = ("n", "counts", "signs", "caps", "cells", "stutter", "lines", "repeated", "exclaims", "mean")

    def __init__(self, text: str | None):
        tokens = (text or "").split()
        self.n = n = len(tokens)
        self.counts = counts = Counter(tokens)
        signs = caps = cells = 0
        for t, c in counts.items():
            if not t.isalpha() or t.isupper():
                x = token_traits(t)
                signs, caps, cells = signs + x[0] * c, caps + x[1] * c, cells + x[2] * c
        self.signs, self.caps, self.cells = signs, caps, cells
        lines = [x for x in (text or "").split("\n") if x]
        self.lines, self.repeated = len(lines), 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0
        self.stutter = sum(map(eq, tokens, tokens[1:])) / n if n else 0.0
        self.exclaims = text.count("!!") / n if n else 0.0
        self.mean = sum(map(len, tokens)) / n if n else 0.0


def votes(t: Traits) -> list[int]:
    """One vote per heuristic; an empty text leaves all of them silent, and shares of few tokens say nothing of most."""
    n = t.n
    if not n:
        return [0] * len(HEURISTICS)
    known = sum(t.counts.get(w, 0) for w in FUNCTION_WORDS) / n
    # a heuristic that knows one kind of junk has nothing to say about other texts: it is silent, not in favour
    junk = lambda x, bar, least=FEW: -1 if n >= least and x > bar else 0
    return [
        junk(t.signs / n, 0.25, 1), junk(t.caps / n, 0.4), junk(t.cells / n, 0.15, 1), junk(t.stutter, 0.35), junk(t.repeated, 0.45), junk(t.exclaims, 0.25),
        0 if n < 20 else 1 if known > 0.06 else -1 if known < 0.005 else 0, 0 if n < 30 else -1 if len(t.counts) / n < 0.15 else 1 if t.signs + t.caps + t.cells < 0.02 * n and t.stutter < 0.05 else 0,
        -1 if t.mean > 25 or t.mean < 2 and n >= FEW else 0,
    ]


def pattern_of(v: list[int]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x + 1
    return out


def votes_in(pattern: np.ndarray) -> np.ndarray:
    places = 3 ** np.arange(len(HEURISTICS) - 1, -1, -1)
    return pattern[:, None] // places % 3 - 1


def patterns(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Documents by vote pattern, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            seen.update(pattern_of(votes(Traits(t))) for t in batch.column(0).to_pylist())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select(text_col).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return {r["pattern"]: r["n"] for r in rows}


class LabelModel:
    """How heuristics err, by expectation-maximisation over pattern counts."""

    def __init__(self, counts: dict[int, int], rounds: int = 100):
        keys = np.array(sorted(counts), np.int64)
        n = np.array([counts[k] for k in keys.tolist()], float)
        v = votes_in(keys)
        self.prior = 0.85
        #: p[y, j, v + 1]: heuristic j votes v where the truth is y; each starts out as somewhat right.
        self.p = np.array([[[0.4, 0.4, 0.2]] * v.shape[1], [[0.05, 0.4, 0.55]] * v.shape[1]])
        for _ in range(rounds if len(keys) else 0):
            good = self.posterior(v)
            for y, weight in enumerate((n * (1 - good), n * good)):
                for j in range(v.shape[1]):
                    self.p[y, j] = (np.bincount(v[:, j] + 1, weight, 3) + [1.0, 1.0, 1.0]) / (weight.sum() + 3)
            self.prior = float(np.clip((n @ good + 1) / (n.sum() + 2), 0.01, 0.99))
        # a good text has more good votes than a junk text has: should the two have changed places, they change back
        if (self.p[0, :, 2] - self.p[0, :, 0]).sum() > (self.p[1, :, 2] - self.p[1, :, 0]).sum():
            self.p, self.prior = self.p[::-1], 1 - self.prior

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good. One heuristic's silence counts; where all are silent, nothing is known but the prior."""
        j = np.arange(v.shape[1])
        log = [np.log(self.p[y, j, v + 1]).sum(1) for y in (0, 1)]
        odds = np.where((v != 0).any(1), log[0] - log[1], 0.0) + np.log((1 - self.prior) / self.prior)
        return 1 / (1 + np.exp(np.clip(odds, -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """Share of cast votes that are right, by heuristic."""
        right = self.prior * self.p[1, :, 2] + (1 - self.prior) * self.p[0, :, 0]
        cast = self.prior * (self.p[1, :, 2] + self.p[1, :, 0]) + (1 - self.prior) * (self.p[0, :, 2] + self.p[0, :, 0])
        return dict(zip(HEURISTICS, (right / cast).round(4).tolist(), strict=True))


_LETTERS, _DIGITS = re.compile(r"[^\W\d_]{2,}"), re.compile(r"\d+")
_SIGNS = re.compile(r"(([^\w\s])\2)\2+")
_PLAIN = {False: xxhash.xxh3_64_intdigest("w") % (DIM - 64), True: xxhash.xxh3_64_intdigest("W") % (DIM - 64)}


@lru_cache(50_000)
def outline(token: str) -> int:
    out = _DIGITS.sub("9", _LETTERS.sub(lambda m: "W" if m[0].isupper() else "w", token))
    return xxhash.xxh3_64_intdigest(_SIGNS.sub(r"\1", out)) % (DIM - 64)


def shape(token: str) -> int:
    """A token's outline, hashed: runs of letters, of digits, of one sign written twice or more, and other signs as they are."""
    return _PLAIN[token.isupper()] if len(token) > 1 and token.isalpha() else outline(token)


def features(t: Traits) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shapes with the square roots of their shares, and places for stutter, repeated lines and shouts."""
    n = t.n
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    shares: dict[int, int] = {}
    for token, c in t.counts.items():
        k = shape(token)
        shares[k] = shares.get(k, 0) + c
    more = {DIM - 1: t.stutter, DIM - 2: t.repeated, DIM - 3: t.exclaims}
    keys = [*shares, *more]
    return np.array(keys, np.int32), np.sqrt(np.array([*(c / n for c in shares.values()), *more.values()], np.float32))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], prior: float) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, full-batch AdaGrad."""
    w, b = np.zeros(DIM), float(np.log(prior / (1 - prior)))
    if not rows:
        return w, b
    y = np.array([r[2] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    memory, memory_b = np.full(DIM, 1e-8), 1e-8
    for _ in range(400):
        err = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * x, len(y)) + b, -50, 50))) - y
        grad, grad_b = np.bincount(col, err[row] * x, DIM) / len(y) + 1e-6 * w, err.mean()
        memory, memory_b = memory + grad**2, memory_b + grad_b**2
        w, b = w - 0.5 * grad / np.sqrt(memory), b - 0.5 * grad_b / np.sqrt(memory_b)
    return w, b


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, np.ndarray, float]:
    model = LabelModel(patterns(docs, text_col))
    chosen = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.lit("quality"), F.col(id_col), F.col(text_col)).alias("h"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [Traits(t) for t in batch.column(1).to_pylist()]
        keys, values = zip(*map(features, texts), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([pattern_of(votes(t)) for t in texts], pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())], ["h", "pattern", "keys", "shares"])

    # hashes first, so that a sort of the corpus moves no text; then the few texts, each once however often it comes
    few = chosen.select("h").distinct().orderBy("h").limit(TRAIN_ROWS)
    sample = chosen.join(F.broadcast(few), "h").select("h", "text").mapInArrow(by_batch(run), "h long, pattern long, keys binary, shares binary").dropDuplicates(["h"]).orderBy("h").collect()
    good = model.posterior(votes_in(np.array([r["pattern"] for r in sample], np.int64).reshape(-1)))
    rows = [(np.frombuffer(r["keys"], np.int32), np.frombuffer(r["shares"], np.float32), float(g)) for r, g in zip(sample, good, strict=True)]
    return model, *fit(rows, model.prior)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher is better), keep, and weak (the posterior of the votes alone)."""
    model, w, b = train(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, s, weak = map(Traits, batch.column(1).to_pylist()), [], []
        known: dict[int, float] = {}
        for t in texts:
            keys, shares = features(t)
            s.append(float(1 / (1 + np.exp(-np.clip(w[keys] @ shares + b if len(keys) else np.log(model.prior / (1 - model.prior)), -50, 50)))))
            p = pattern_of(votes(t))
            if p not in known:
                known[p] = float(model.posterior(votes_in(np.array([p])))[0])
            weak.append(known[p])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array(weak, pa.float64())], ["doc_id", "score", "weak"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(by_batch(run), "doc_id long, score double, weak double")
    return out.withColumn("keep", F.col("score") >= KEEP)


def keep_good(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all their columns, whatever these are named."""
    _, w, b = train(docs, id_col, text_col)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [len(k) == 0 or float(w[k] @ s + b) >= 0 for k, s in (features(Traits(t)) for t in batch.column(at).to_pylist())]
        return batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(by_batch(run), schema)
