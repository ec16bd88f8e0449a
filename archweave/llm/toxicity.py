"""Toxicity by a noisy channel: undo the disguise first, then score what was meant.

A character trigram model over all documents says what spelling is likely. A token that mixes letters with look-alike
signs or stretches a letter becomes a lattice of readings, each with a channel cost, and Viterbi finds the likeliest.
Blanks and separators are part of the lattice, each dropped or a boundary between words. A blank between two plain
words of two letters or more is decided by the letters around it alone, so a table of those decisions replaces the
lattice there; all other blanks, beside single signs, go through it. A linear model over words and word beginnings, learnt from labelled rows, scores the document by its
distinct tokens, both as written and as restored.

Labels: rows of ``labels`` with crc32(doc_id as text) mod 5 other than 0, at most ``TRAIN_ROWS`` of them by keyed hash
(a stated bound; the model is fitted on the driver). The trigram counts cover every document.

Defined results: null text counts as empty; the score of an empty text is the model's base rate; texts are read
whole; null labels are left out, a document labelled twice counts with its larger label, and rows that repeat count once
in the sample; without any labels every score is next to 0; an empty table gives an empty result; columns but the id,
the text and the label are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.llm.common import by_batch

TRAIN_ROWS, DIM = 20_000, 1 << 20
LEAST_TOXIC, LEAST_G = 4, 24.0
BEGINNINGS = (4, 5, 6)

#: Signs that stand for letters.
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
NOISE = ".*_-~^'`,"
KEEP_COST, SWAP_COST, DROP_COST, SQUEEZE_COST = 0.0, 1.0, 0.7, 0.7
#: A blank that is dropped: beside a single sign, where spacing is likely meant, and between longer fragments.
JOIN_COST, MEND_COST = 0.0, 1.7

LETTERS = 28  # space, a to z, any other letter
_CODE = np.zeros(128, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(points), LETTERS - 1)
    low = points < 128
    out[low] = _CODE[points[low]]
    return out


def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one partition: at most LETTERS ** 3 rows, whatever it holds."""
    total = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            c = np.concatenate([[0, 0], codes(text or ""), [0]])
            total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """-log p(third | first two), interpolated with the shorter contexts; a table of LETTERS ** 3 numbers."""
    rows = docs.select(text_col).mapInArrow(trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LETTERS**3)
    for r in rows:
        n[r["gram"]] = r["n"]
    n = n.reshape(LETTERS, LETTERS, LETTERS)
    uni = (n.sum((0, 1)) + 1) / (n.sum() + LETTERS)
    bi = (n.sum(0) + 10 * uni) / (n.sum(0).sum(-1, keepdims=True) + 10)
    return -np.log((n + 10 * bi[None]) / (n.sum(-1, keepdims=True) + 10))


_STRANGE = re.compile(r"[^\W\d_][\d@$!|+(€£.*_~^-]+[^\W\d_]|[\d@$!|(€£][^\W\d_]|([^\W\d_])\1\1|[^\W\d_][013457@$!]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
#: Tokens that a task remembers.
KNOWN = 300_000
_SIDES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LOOKALIKE)
#: Single signs with separators between them and no blank: a token that is spaced out within.
_SEPARATED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_](?![^\W_]))+")
_SEPARATORS = re.compile(r"[^\w@$!|(+*€£]+|_+")
_TRIM = re.compile(r"^[^\w@$!|(€£]+|[^\w@$]+$")


def restore(token: str, model: np.ndarray, squeeze: bool = True) -> str:
    """The likeliest reading of a text: Viterbi over (last two letters), one step per sign.

    Readings of a sign: itself if a letter, a letter it looks like, nothing if it is noise, nothing if it repeats the
    letter before; a blank is nothing or a boundary. A state keeps its best cost and, as a chain, its spelling. States
    and readings per sign are bounded, so time is linear.
    """
    cost_of = _costs(model)
    states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    for ch in token:
        if ch == " ":
            options = [("", JOIN_COST), (" ", KEEP_COST)]
        else:
            options = [(ch, KEEP_COST)] if ch.isalpha() else []
            options += [(x, SWAP_COST) for x in LOOKALIKE.get(ch, "")]
            if not options or ch in NOISE:
                options.append(("", DROP_COST + 1.0))
        alike = LOOKALIKE.get(ch, "")
        after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for (a, b, last), (cost, spelt) in states.items():
            for x, more in options + ([("", SQUEEZE_COST)] if squeeze and last and (ch == last or last in alike) else []):
                if x == " " and not b:
                    continue  # a boundary already
                if x:
                    c = 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else LETTERS - 1
                    key, total = (b, c, x if c else ""), cost + more + cost_of[(a * LETTERS + b) * LETTERS + c]
                    if key not in after or total < after[key][0]:
                        after[key] = (total, (x, spelt))
                elif (key := (a, b, last)) not in after or cost + more < after[key][0]:
                    after[key] = (cost + more, spelt)
        states = after
    chain = min(((cost + cost_of[(a * LETTERS + b) * LETTERS], spelt) for (a, b, _), (cost, spelt) in states.items()), key=lambda s: s[0])[1]
    out = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return "".join(reversed(out))


_last_costs: tuple[np.ndarray | None, list[float]] = (None, [])


def _costs(model: np.ndarray) -> list[float]:
    """The model as a flat list, which Python reads faster; that of the last model is kept."""
    global _last_costs
    if _last_costs[0] is not model:
        _last_costs = (model, model.ravel().tolist())
    return _last_costs[1]


def _single(token: str) -> bool:
    """One sign, perhaps with separators around it."""
    return len(token) == 1 or len(token.strip(_SIDES)) == 1


def hashed(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % DIM


def token_features(token: str) -> list[int]:
    return [hashed(token)] + [hashed(f"{token[:n]}-") for n in BEGINNINGS if len(token) > n]


class Reader:
    """Distinct tokens of a text as features, with a bounded memory for what was seen before."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}
        #: By the two letters before a blank and the two after it: whether it may be dropped.
        self.blanks: dict[tuple[str, str], bool] = {}
        #: Spaced runs, their ends cut to two letters: whether the lattice drops a blank.
        self.runs: dict[str, bool] = {}

    def readings(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            found = self._readings(token)
            if len(self.known) < KNOWN:
                self.known[token] = found
        return found

    def _readings(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and not _STRETCHED.search(token):
            return (token,)
        plain = _TRIM.sub("", token)
        out = [plain] if plain else []
        if _STRANGE.search(token):
            out += [r for r in {restore(plain, self.model), restore(token, self.model)} if len(r) > 2]
        for m in _SEPARATED.finditer(token):
            out += self._spelt(m[0])
        return tuple(dict.fromkeys(out))

    def _open(self, before: str, after: str) -> bool:
        """Whether the blank between two tokens, given by two signs each at most, may be dropped."""
        if not (before[-1:].isalnum() and after[:1].isalnum()):  # a separator: only single signs have it within a word
            return _single(before) and _single(after)
        if len(before) < 2 or len(after) < 2:
            return True
        if not (before + after).isalpha():
            return False
        (a, b), (c, d) = codes(before), codes(after)
        m = self.model
        return bool(m[a, b, c] + m[b, c, d] + MEND_COST < m[a, b, 0] + m[b, 0, c] + m[0, c, d])

    def written(self, text: str | None) -> set[str]:
        """Distinct tokens of a text, and the words that its spaced runs make."""
        words = (text or "").lower().split()
        out = set(words)
        if len(words) < 2:
            return out
        pairs = list(zip([w[-2:] for w in words], [w[:2] for w in words[1:]]))  # noqa: B905
        may = list(map(self.blanks.get, pairs))
        if None in may:
            for i, x in enumerate(may):
                if x is None:
                    may[i] = self._open(*pairs[i])
                    if len(self.blanks) < KNOWN:
                        self.blanks[pairs[i]] = may[i]
        i, n = 0, len(may)
        while True:
            try:
                i = may.index(True, i)
            except ValueError:
                return out
            start = i
            while i < n and may[i]:
                i += 1
            out.update(self._joined(words[start : i + 1]))

    def _joined(self, run: list[str]) -> list[str]:
        """Words that appear where blanks of a run are dropped."""
        single = list(map(_single, run))
        if True not in single:
            return ["".join(run)]
        out, start = [], 0
        for i, x in enumerate([*single, False]):
            if not x:
                out += self._spelt(" ".join(run[start:i])) if i - start > 2 else []
                start = i + 1
        cut = " ".join([run[0][-2:], *run[1:-1], run[-1][:2]])
        drops = self.runs.get(cut)
        if drops is None:
            drops = len(self._lattice(cut)) < len(cut.split())
            if len(self.runs) < KNOWN:
                self.runs[cut] = drops
        return out + [w for w in self._lattice(" ".join(run)) if len(w) > 2] if drops else out

    def _spelt(self, run: str) -> list[str]:
        """Words of a run of single signs, of all of it and of what is left if a one-letter word opens or ends it."""
        signs = _SEPARATORS.sub(" ", run).split()
        parts = [signs, signs[1:], signs[:-1], signs[1:-1]]
        return ["".join(signs), *(w for part in parts if len(part) > 2 for w in self._lattice(" ".join(part)) if len(w) > 2)]

    def _lattice(self, run: str) -> list[str]:
        """Likeliest words of a spaced text; letters written twice stay, those written more often are stretched."""
        plain = _SEPARATORS.sub(" ", run).strip()
        return restore(plain, self.model, _STRETCHED.search(plain.replace(" ", "")) is not None).split()

    def tokens(self, text: str | None) -> set[str]:
        return {r for t in self.written(text) for r in self.readings(t)}


def training_rows(docs: DataFrame, labels: DataFrame, model: np.ndarray, id_col: str, text_col: str) -> list:
    """(toxic, packed features) of the bounded sample; only its ids, at most TRAIN_ROWS, are broadcast."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    named = named.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = named.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(TRAIN_ROWS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        reader = Reader(model)
        packed = []
        for text in batch.column(2).to_pylist():
            found = [f for t in reader.tokens(text) for f in token_features(t)]
            packed.append(np.unique(np.array(found, np.int32)).tobytes())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], ["doc_id", "toxic", "packed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    # of an id that has several texts, all of one document's rows are one row of the sample: the one that says most
    packed = rows.select("doc_id", "toxic", "text").mapInArrow(by_batch(run), "doc_id long, toxic int, packed binary")
    return packed.groupBy("doc_id", "toxic").agg(F.max_by("packed", F.struct(F.length("packed"), "packed")).alias("packed")).orderBy("doc_id").collect()


def fit(rows: list) -> tuple[np.ndarray, float]:
    """Weights and base rate. Features that labels tie to toxicity by the G statistic enter a logistic regression."""
    weights = np.zeros(DIM, np.float32)
    toxic = np.array([r["toxic"] for r in rows], bool)
    if not toxic.any() or toxic.all():
        return weights, 30.0 if len(toxic) and toxic.all() else -30.0
    feats = [np.frombuffer(r["packed"], np.int32) for r in rows]
    t = np.bincount(np.concatenate([f for f, y in zip(feats, toxic, strict=True) if y]), minlength=DIM)
    n = t + np.bincount(np.concatenate([f for f, y in zip(feats, toxic, strict=True) if not y]), minlength=DIM)
    rate = toxic.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(t > 0, t * np.log(t / (n * rate)), 0) + np.where(n > t, (n - t) * np.log((n - t) / (n * (1 - rate))), 0))
    chosen = np.flatnonzero((t >= LEAST_TOXIC) & (t > 3 * rate * n) & (g >= LEAST_G))
    if not len(chosen):
        return weights, float(np.log(rate / (1 - rate)))
    column = np.full(DIM, -1)
    column[chosen] = np.arange(len(chosen))
    cols = [c[c >= 0] for c in (column[f] for f in feats)]
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.concatenate(cols)
    y, w, b = toxic.astype(float), np.zeros(len(chosen)), float(np.log(rate / (1 - rate)))
    memory, memory_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(300):  # full-batch AdaGrad
        z = np.bincount(row, w[col], len(y)) + b
        err = 1 / (1 + np.exp(-z)) - y
        grad, grad_b = np.bincount(col, err[row], len(chosen)) / len(y) + 1e-5 * w, err.mean()
        memory += grad**2
        memory_b += grad_b**2
        w -= 0.5 * grad / np.sqrt(memory)
        b -= 0.5 * grad_b / np.sqrt(memory_b)
    weights[chosen] = w
    return weights, b


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. What is sent along is one fixed-size table of weights."""
    model = character_model(docs, text_col)
    weights, base = fit(training_rows(docs, labels, model, id_col, text_col))
    used = np.flatnonzero(weights)
    sparse = dict(zip(used.tolist(), weights[used].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        get = sparse.get
        known: dict[str, tuple[int, ...]] = {}

        def found(token: str) -> tuple[int, ...]:
            hits = tuple({f for r in reader._readings(token) for f in token_features(r) if f in sparse})
            if len(known) < KNOWN:
                known[token] = hits
            return hits

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                hits = set()
                for t in reader.written(text):
                    if (f := known.get(t)) is None:
                        f = found(t)
                    if f:
                        hits.update(f)
                out.append(1 / (1 + np.exp(-np.clip(base + sum(map(get, sorted(hits))), -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return slim.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
