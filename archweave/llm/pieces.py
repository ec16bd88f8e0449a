"""SentencePiece encoding with seeded merge-dropout, and its inverse.

Characters of a text start as symbols; an agenda holds adjacent pairs whose union is a piece and takes the best score
first, the leftmost on ties. A candidate that comes up is skipped when a keyed hash of the seed, the variant, the
document's id and its place in the text falls below the rate, so a word's segmentations vary from place to place and
come out the same in every run. With rate 0 the result is the tokenizer's own. Whatever is skipped, pieces are substrings of the text or its bytes: joining
them gives the text back.

A piece never has a space inside, so a text is cut before each run of spaces, and, where no piece of the vocabulary
joins the two, between letters and other signs; no merge can cross a cut. A bounded memory holds, for a chunk and a set
of skipped candidates, the merges that follow. All places of a batch draw for their own candidates at once; those whose
chunk or skips the memory does not hold are merged together, one candidate of each a round.

Defined results: null text counts as empty; empty text has no pieces; U+2581, the sign for a space, is written as
bytes so that it survives; texts are read whole; repeated rows give repeated results; a null id is the name ``None``; an
empty table gives an empty result; columns but the id, the text and the place are not read, so names cannot clash.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.llm.common import keeps, turn

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
U = np.uint64
SEED, RATE, VARIANTS = 17, 0.1, 2
VARIANT_STEP, GOLDEN, MIX, MASK = 1_000_003, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 2**64 - 1
#: Chunks up to SHORT signs are scanned and remembered, KNOWN of them and of what follows their skips: some 200 bytes each.
SHORT, KNOWN, NEVER, LAST = 48, 120_000, float("inf"), 2**31 - 1
AT_ONCE = 1 << 19
SPACE = "▁"
_CHUNK = re.compile(r" *[^ ▁]+|▁| +")
#: Finer, for vocabularies without a piece that joins a letter and another sign.
_FINE_CHUNK = re.compile(r" *[^\W\d_]+| *(?:[^\w ▁]|[\d_])+|▁| +")
_JOINS = re.compile(r"[^\W\d_](?:[^\w ▁]|[\d_])|(?:[^\w ▁]|[\d_])[^\W\d_]")


class Codec:
    """Pieces of a byte-pair model with byte fallback; ``proto`` are the bytes of its file."""

    def __init__(self, proto: bytes, seed: int = SEED, rate: float = RATE):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(sp.get_piece_size())
        plain = {sp.id_to_piece(i): i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.id, self.rank = plain.get, {piece: -sp.get_score(i) for piece, i in plain.items()}.get
        #: A node is a chunk with some candidates skipped: its ids, the skipped, and the span in ``places`` of the
        #: candidates taken for it, each as start << 32 | end. ``more`` leads from a node by one more skipped to the next.
        self.known: dict[str, int] = {}
        self.more: dict[int, int] = {}
        self.ids: list[bytes] = []
        self.skips: list[tuple[int, ...]] = []
        self.starts, self.ends, self.places = array("q"), array("q"), array("Q")
        self.start_of, self.end_of, self.place_at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
        self.settled = {"start_of": 0, "end_of": 0, "place_at": 0}
        self.room = KNOWN
        self.chunks = (_CHUNK if any(map(_JOINS.search, plain)) else _FINE_CHUNK).findall
        self._pairs(plain)
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.raw = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.seed, self.bar = seed, int(rate * 2**64)

    def _pairs(self, plain: dict[str, int]) -> None:
        """Signs as symbols, and which two symbols make which piece, in a table that is looked up by hash."""
        signs = sorted({c for piece in plain for c in piece})
        extra = max(plain.values(), default=-1) + 1
        symbol = plain | {c: extra + i for i, c in enumerate(c for c in signs if c not in plain)}
        self.n_plain, self.n_symbols = extra, extra + len(signs) + 1
        self.sign = np.full(0x110000, self.n_symbols - 1, np.int32)  # the last stands for signs that no piece holds
        self.sign[[ord(c) for c in signs]] = [symbol[c] for c in signs]
        self.sign[ord(" ")] = self.sign[ord(SPACE)]
        made = {(symbol[a], symbol[b]): i for piece, i in plain.items() for k in range(1, len(piece)) if (a := piece[:k]) in symbol and (b := piece[k:]) in symbol}
        self.order = np.full(self.n_symbols, LAST, np.int32)
        own = np.fromiter(plain.values(), np.int64, len(plain))
        self.order[own] = np.unique([self.rank(piece) for piece in plain], return_inverse=True)[1]
        keys = np.array([a * self.n_symbols + b for a, b in made], np.int64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.slot_key, self.slot_piece = U(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        for key, at, piece in zip(keys.tolist(), (keys.astype(U) * U(GOLDEN) >> self.shift).tolist(), made.values(), strict=True):
            while self.slot_key[at] >= 0:
                at = at + 1 & (1 << bits) - 1
            self.slot_key[at], self.slot_piece[at] = key, piece

    def _union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols make, -1 for none."""
        key = a.astype(np.int64) * self.n_symbols + b
        at = (key.astype(U) * U(GOLDEN) >> self.shift).astype(np.int64)
        there, out = self.slot_key[at], self.slot_piece[at]
        wrong = np.flatnonzero((there != key) & (there >= 0))
        while len(wrong):
            at[wrong] = at[wrong] + 1 & len(self.slot_key) - 1
            there = self.slot_key[at[wrong]]
            out[wrong] = self.slot_piece[at[wrong]]
            wrong = wrong[(there != key[wrong]) & (there >= 0)]
        return out

    def _many(self, chunks: list[str], keys: np.ndarray) -> list[bytes]:
        """``_chunk`` for many places at once: a round merges the next candidate of each. Chunks have SHORT signs at most.

        Whether a span is skipped depends on its place alone, so it is left out when it comes into being.
        """
        out: list[bytes] = [b""] * len(chunks)
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        by_length = np.argsort(length, kind="stable")
        begin = 0
        while begin < len(chunks):
            widest = max(8, int(length[by_length[begin]]) * 5 // 4)
            some = by_length[begin : min(begin + 16_384, int(np.searchsorted(length[by_length], widest, "right")))]
            begin += len(some)
            for i, ids in zip(some.tolist(), self._merged([chunks[i] for i in some.tolist()], length[some], keys[some]), strict=True):
                out[i] = self._chunk(chunks[i], int(keys[i])) if ids is None else ids
        return out

    def _merged(self, chunks: list[str], length: np.ndarray, keys: np.ndarray) -> Iterator[bytes | None]:
        """Ids of each chunk; None where a sign is left that is no piece."""
        n, width, none = len(chunks), int(length.max()), self.n_symbols - 1
        inside = np.arange(width) < length[:, None]
        symbol = np.full((n, width + 1), none, np.int32)
        symbol[:, :width][inside] = self.sign[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        # flat: a place is row * step + start; the place after the last one holds a sign that joins nothing
        step = width + 1
        symbol = symbol.ravel()
        after = (np.arange(n * step) % step + 1).astype(np.int64)
        before = after - 2
        piece, order = np.full(n * step, -1, np.int32), np.full(n * step, LAST, np.int32)

        def propose(row: np.ndarray, at: np.ndarray, to: np.ndarray, end: np.ndarray) -> None:
            """What the symbols at ``at`` and ``to`` make, up to ``end``, unless it is skipped at this place."""
            here = row * step + at
            made = self._union(symbol[here], symbol[row * step + to])
            if self.bar:
                found = np.flatnonzero(made >= 0)
                span = at[found].astype(U) << U(32) | end[found].astype(U)
                made[found[(keys[row[found]] ^ span) * U(GOLDEN) < U(self.bar)]] = -1
            piece[here] = made
            order[here] = np.where(made >= 0, self.order[made], LAST)

        row, at = np.nonzero(inside[:, 1:])
        propose(row, at, at + 1, at + 2)
        table, live = order.reshape(n, step), np.arange(n)
        while len(live):
            at = table[live].argmin(1)
            open_ = table[live, at] != LAST
            live, at = live[open_], at[open_]
            here = live * step + at
            to = after[here]
            end = after[live * step + to]
            symbol[here], after[here] = piece[here], end
            order[live * step + to], symbol[live * step + to] = LAST, -1
            last = end >= length[live]
            before[(live * step + end)[~last]] = at[~last]
            order[here[last]] = LAST
            r, a, b = live[~last], at[~last], end[~last]
            propose(r, a, b, after[r * step + b])
            first = at > 0
            r, b, e = live[first], at[first], end[first]
            a = before[r * step + b]
            propose(r, a, b, e)
        left = symbol.reshape(n, step)[:, :width]
        kept = inside & (left >= 0)
        plain = ~(kept & (left >= self.n_plain)).any(1)
        flat, ends = left[kept].tobytes(), np.cumsum(kept.sum(1) * 4)
        for a, b, whole in zip([0, *ends[:-1].tolist()], ends.tolist(), plain.tolist(), strict=True):
            yield flat[a:b] if whole else None

    def _chunk(self, chunk: str, key: int | None, trace: list[int] | None = None, skips: frozenset[int] = frozenset()) -> bytes:
        """Ids of a chunk at the place that ``key`` stands for; without a key ``skips`` are skipped."""
        if chunk == SPACE:
            return array("i", [self.byte[b] for b in chunk.encode()]).tobytes()
        text = chunk.replace(" ", SPACE)
        symbols = self._short(text, key, trace, skips) if len(text) <= SHORT else list(self._long(text, key))
        ids = list(map(self.id, symbols))
        if None in ids:
            spelt = ([i] if i is not None else [self.byte[b] for b in s.replace(SPACE, " ").encode("utf-8", "surrogatepass")] for i, s in zip(ids, symbols, strict=True))
            ids = [i for part in spelt for i in part]
        return array("i", ids).tobytes()

    def _short(self, text: str, key: int | None, trace: list[int] | None = None, skips: frozenset[int] = frozenset()) -> list[str]:
        """The agenda as a list in text order: its least rank is the next candidate, the first of them on ties."""
        rank, bar = self.rank, self.bar if key is not None else 0
        symbols, starts = list(text), list(range(len(text) + 1))
        agenda = [rank(pair, NEVER) for pair in map(add, text, text[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            if bar and ((key ^ (starts[i] << 32 | starts[i + 2])) * GOLDEN & MASK) < bar:
                agenda[i] = NEVER
                continue
            if skips and starts[i] << 32 | starts[i + 2] in skips:
                agenda[i] = NEVER
                continue
            if trace is not None:
                trace.append(starts[i] << 32 | starts[i + 2])
            symbols[i] += symbols.pop(i + 1)
            del starts[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], NEVER)
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], NEVER)
        return symbols

    def _long(self, text: str, key: int | None) -> Iterator[str]:
        """The agenda as a heap, for chunks whose length would make scans slow; candidates and skips are the same."""
        n, rank, bar = len(text), self.rank, self.bar if key is not None else 0
        left, right = list(range(-1, n)), list(range(1, n + 1))  # by where a symbol starts: the start before, and its end
        agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(text[i : i + 2], NEVER)) != NEVER]
        heapify(agenda)
        while agenda:
            _, a, b, end = heappop(agenda)
            if right[a] != b or right[b] != end:  # one of the two has changed since; a merged symbol's end is set to 0
                continue
            if bar and ((key ^ (a << 32 | end)) * GOLDEN & MASK) < bar:
                continue
            right[a], right[b] = end, 0
            if end < n:
                left[end] = a
                c = right[end]
                if (r := rank(text[a:c], NEVER)) != NEVER:
                    heappush(agenda, (r, a, end, c))
            if a:
                c = left[a]
                if (r := rank(text[c:end], NEVER)) != NEVER:
                    heappush(agenda, (r, c, a, end))
        i = 0
        while i < n:
            yield text[i : right[i]]
            i = right[i]

    def encode(self, text: str | None, variant: int = 0, document: object = None) -> list[int]:
        return np.frombuffer(self.packed(text, variant, document), np.int32).tolist()

    def _node(self, chunk: str, skips: tuple[int, ...]) -> int:
        """The node of a chunk with these candidates skipped, or -1 where there is no room."""
        if len(self.ids) >= self.room:
            return -1
        trace: list[int] = []
        self.ids.append(self._chunk(chunk, None, trace, frozenset(skips)))
        self.skips.append(skips)
        self.starts.append(len(self.places))
        self.places.extend(trace)
        self.ends.append(len(self.places))
        return len(self.ids) - 1

    def _skipped(self, nodes: np.ndarray, begin: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places have a candidate of their node's merges, from ``begin`` on, that is skipped there, and the first of these."""
        n = self.end_of[nodes] - begin
        n_th = np.repeat(np.arange(len(nodes)), n)
        at = np.arange(len(n_th)) + np.repeat(begin - (np.cumsum(n) - n), n)
        hit = np.flatnonzero((keys[n_th] ^ self.place_at[at]) * U(GOLDEN) < U(self.bar))
        who = n_th[hit]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        return who[first], at[hit[first]]

    def packed_many(self, texts: Sequence[str | None], variants: Sequence[int], documents: Sequence[object]) -> list[bytes]:
        """Ids of many texts as 32-bit numbers, some AT_ONCE signs at a time."""
        out, begin, n = [], 0, 0
        for i, text in enumerate(texts):
            n += len(text or "")
            if n >= AT_ONCE or i == len(texts) - 1:
                out += self._packed(*(x[begin : i + 1] for x in (texts, variants, documents)))
                begin, n = i + 1, 0
        return out

    def _packed(self, texts: Sequence[str | None], variants: Sequence[int], documents: Sequence[object]) -> list[bytes]:
        """All places draw at once, then those that skip go on with what follows for them."""
        known, sizes, chunks = self.known, [], []
        for text in texts:
            own = self.chunks(" " + text) if text else []
            sizes.append(len(own))
            chunks += own
        if not chunks:
            return [b""] * len(texts)
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(length)
        first = np.cumsum(sizes) - sizes
        offset = ends - length - np.repeat((ends - length)[np.minimum(first, len(chunks) - 1)], sizes)
        seeds = [xxhash.xxh3_64_intdigest(str(d), seed=self.seed * VARIANT_STEP + v) if self.bar else 0 for d, v in zip(documents, variants, strict=True)]
        keys = np.repeat(np.array(seeds, U), sizes) + offset.astype(U) * U(GOLDEN)
        keys = (keys ^ keys >> U(30)) * U(MIX)
        keys ^= keys >> U(27)
        nodes = list(map(known.get, chunks))
        alone: dict[int, bytes] = {}  # places whose chunk is too long to be known, or for which there is no room
        waiting: list[int] = []  # of these, the places that are merged together
        if None in nodes:
            for i, node in enumerate(nodes):
                if node is None:
                    c = chunks[i]
                    node = known.get(c, -1)
                    if node < 0 and len(c) <= SHORT and (node := self._node(c, ())) >= 0:
                        known[c] = node
                    if node < 0:
                        alone[i] = b""
                        if len(c) <= SHORT and c != SPACE:
                            waiting.append(i)
                        else:
                            alone[i] = self._chunk(c, int(keys[i]))
                    nodes[i] = max(node, 0)
        if self.bar:
            where = np.arange(len(chunks))
            node = np.array(nodes, np.int64)
            if alone:
                where = np.delete(where, list(alone))
                node = node[where]
            begin = None
            while len(where):
                self._settle()
                begin = self.start_of[node] if begin is None else begin
                who, at = self._skipped(node, begin, keys[where])
                done = (at - self.start_of[node[who]]).tolist()
                where, before, place = where[who], node[who].tolist(), self.place_at[at].tolist()
                after = []
                for i, old, p in zip(where.tolist(), before, place, strict=True):
                    name = old << 12 | p >> 26 & 0xFC0 | p & 0x3F  # start and end are below 64 each
                    new = self.more.get(name)
                    if new is None:
                        new = self._node(chunks[i], (*self.skips[old], p))
                        if new >= 0:
                            self.more[name] = new
                        else:
                            waiting.append(i)
                    nodes[i] = max(new, 0)
                    after.append(new)
                node = np.array(after, np.int64)
                go_on = node >= 0
                where, node, done = where[go_on], node[go_on], np.array(done, np.int64)[go_on]
                self._settle()
                # the merges before a skipped candidate are the same with and without it
                begin = self.start_of[node] + done
        ids = list(map(self.ids.__getitem__, nodes)) if self.ids else [b""] * len(nodes)
        for i, own in alone.items():
            ids[i] = own
        for i, own in zip(waiting, self._many([chunks[i] for i in waiting], keys[waiting]), strict=True):
            ids[i] = own
        return [b"".join(ids[a : a + n]) for a, n in zip(first.tolist(), sizes, strict=True)]

    def _settle(self) -> None:
        """The nodes' numbers as arrays; they grow by doubling, so that few nodes more cost little."""
        for name, numbers, kind in (("place_at", self.places, U), ("start_of", self.starts, np.int64), ("end_of", self.ends, np.int64)):
            array_, n = getattr(self, name), self.settled[name]
            if n < len(numbers):
                if len(numbers) > len(array_):
                    array_ = np.concatenate([array_, np.zeros(len(numbers) + len(array_), kind)])
                    setattr(self, name, array_)
                array_[n : len(numbers)] = np.frombuffer(numbers[n:], kind)
                self.settled[name] = len(numbers)

    def packed(self, text: str | None, variant: int = 0, document: object = None) -> bytes:
        return self.packed_many([text], [variant], [document])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


@lru_cache(2)
def codec(proto: bytes, seed: int, rate: float) -> Codec:
    """One per process: a worker keeps what it knows of chunks from task to task."""
    return Codec(proto, seed, rate)


def forget() -> None:
    if codec.cache_info().currsize:
        codec.cache_clear()
        gc.collect()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # else glibc keeps what is free
            libc.malloc_trim(0)


keeps(__name__, forget)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str = MODEL, seed: int = SEED, rate: float = RATE, variants: int = VARIANTS, place_col: str | None = None) -> DataFrame:
    """Per document: doc_id, variant, n_chars, n_pieces, ids, text_sha256 of the decoded pieces, lossless; and ``place_col``, a number, if given.

    The model's file is read by the driver and travels with the task, as one value of fixed size.
    """
    proto = Path(model).read_bytes()
    place = [place_col] if place_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn(forget.__module__)
        own = codec(proto, seed, rate)
        for batch in batches:
            n_chars, sha, same = [], [], []
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            variant = [xxhash.xxh3_64_intdigest(str(key), seed=seed) % variants for key in keys]
            ids = own.packed_many(texts, variant, keys)
            for text, packed in zip(texts, ids, strict=True):
                back = own.decode(np.frombuffer(packed, np.int32).tolist())
                n_chars.append(len(back))
                sha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(back == (text or ""))
            n = np.array([len(x) // 4 for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), np.frombuffer(b"".join(ids), np.int32))
            cols = [batch.column(0), pa.array(variant, pa.int32()), pa.array(n_chars, pa.int64()), pa.array(n), lists, pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols + batch.columns[2:], ["doc_id", "variant", "n_chars", "n_pieces", "ids", "text_sha256", "lossless", *place])

    schema = "doc_id long, variant int, n_chars long, n_pieces long, ids array<int>, text_sha256 string, lossless boolean" + "".join(f", `{c}` long" for c in place)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).cast("long") for c in place)).mapInArrow(run, schema)
