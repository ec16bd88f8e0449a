"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

``decode`` follows the GIF89a rules for any file; ``encode`` writes a byte payload as 8-bit samples, one palette
index per byte, in frames of at most ``FRAME_ROWS`` rows, so memory per frame is bounded however long a text is.

Defined results: null media gives no frames and an error text; a stream that breaks off, lacks its header, has a code
size that samples of a byte cannot have, or asks for a canvas of more than ``MOST_PIXELS`` gives the frames before that
and an error text; null text counts as empty and becomes one frame of 64 zero bytes; repeated rows give repeated results; an
empty table gives an empty result; columns but those named are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.llm.common import by_batch

WIDTH, FRAME_ROWS, DELAY_CS, BINS = 64, 512, 4, 8
#: Pixels of a canvas; beyond, a frame's colours would not fit a row.
MOST_PIXELS = 1 << 28
CLEAR, STOP, FULL = 256, 257, 4096

#: Palette of the encoder: the red channel is the sample itself, so pixels lead back to the payload.
_INDEX = np.arange(256, dtype=np.uint8)
PALETTE = np.stack([_INDEX, _INDEX * np.uint8(37), ~_INDEX], axis=1)


def schedule(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Width and bit offset of the k-th code after a clear code: a table entry is added per code but the first."""
    clear = 1 << min_size
    entries = clear + 2 + np.maximum(0, np.arange(FULL + 256) - 1)
    width = np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, min_size + 1, 12)
    return width, np.concatenate([[0], np.cumsum(width)])


_SCHEDULES = {n: schedule(n) for n in range(2, 9)}


def lzw_encode(data: bytes) -> bytes:
    """Codes of 8-bit samples, cleared whenever the table is full, packed least significant bit first."""
    codes, since, k = [CLEAR], [0], 0
    table: dict[int, int] = {}
    get, free, w = table.get, STOP + 1, data[0]
    for c in data[1:]:
        key = w << 8 | c
        v = get(key)
        if v is not None:
            w = v
            continue
        codes.append(w)
        if free < FULL:
            table[key] = free
            free += 1
        else:
            codes.append(CLEAR)
            since.append(len(codes) - 1)
            table.clear()
            free = STOP + 1
        w = c
    codes += [w, STOP]
    values = np.array(codes, np.int64)
    starts = np.array(since)
    k = np.arange(len(values)) - starts[np.searchsorted(starts, np.arange(len(values)), "right") - 1] - 1
    k[starts[1:]] = starts[1:] - starts[:-1] - 1
    k[0] = 0
    width = _SCHEDULES[8][0][k]
    at = np.concatenate([[0], np.cumsum(width)])
    bits = np.zeros(at[-1], np.uint8)
    for b in range(12):
        has = width > b
        bits[at[:-1][has] + b] = (values[has] >> b) & 1
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_codes(data: bytes, min_size: int) -> Iterator[list[int]]:
    """The codes between one clear code and the next; ends at the stop code or where the bits run out."""
    clear = 1 << min_size
    width, offset = _SCHEDULES[min_size]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, bit = 8 * len(data), 0
    while bit + min_size + 1 <= total:
        run: list[int] = []
        first, base = 0, bit
        while True:  # a table may stay full for long: then widths stay 12
            n = len(width)
            w, at = (width, base + offset[:n]) if first == 0 else (np.full(n, 12), base + 12 * np.arange(n))
            fit = at + w <= total
            w, at = w[fit], at[fit]
            p = at >> 3
            codes = ((raw[p] | raw[p + 1] << 8 | raw[p + 2] << 16) >> (at & 7)) & ((1 << w) - 1)
            ends = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(ends):
                e = ends[0]
                run += codes[:e].tolist()
                bit = int(at[e] + w[e])
                done = codes[e] == clear + 1
                break
            run += codes.tolist()
            if len(codes) < n:
                bit, done = total, True
                break
            base = int(at[-1] + w[-1])
            first += 1
        if run:
            yield run
        if done:
            return


def lzw_decode(data: bytes, min_size: int = 8, most: int | None = None) -> bytes:
    """Samples of a code stream, at least ``most`` if it has them; raises ValueError on a code beyond the table."""
    if min_size not in _SCHEDULES:
        raise ValueError("no such code size")
    clear = 1 << min_size
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    for run in lzw_codes(data, min_size):
        table = roots.copy()
        add, put = table.append, out.append
        if run[0] >= clear:
            raise ValueError("first code is no sample")
        prev, free = table[run[0]], clear + 2
        put(prev)
        for c in run[1:]:
            if c < free:
                entry = table[c]
            elif c == free and free < FULL:
                entry = prev + prev[:1]
            else:
                raise ValueError("code beyond the table")
            put(entry)
            if free < FULL:
                add(prev + entry[:1])
                free += 1
            prev = entry
        if most is not None and sum(map(len, out)) >= most:
            break
    return b"".join(out)


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(c := data[i : i + 255])]) + c for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF89a of ``WIDTH`` columns whose samples are the payload, a positive multiple of ``WIDTH`` bytes."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), PALETTE.tobytes()]
    for at in range(0, rows, FRAME_ROWS):
        part = payload[at * WIDTH : (at + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04\x04" + struct.pack("<HBB", delay_cs, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """A composed canvas (height, width, RGBA) with the time it is shown and the rectangle that was drawn."""

    pixels: np.ndarray
    start_cs: int
    delay_cs: int
    box: tuple[int, int, int, int]


def interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(a, rows, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(media: bytes) -> Iterator[Frame]:
    """Frames one by one. Disposal: 0 and 1 leave the frame, 2 clears its box, 3 brings back what was there before."""
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("no GIF header")
    w, h, flags, *_ = struct.unpack("<HHBBB", media[6:13])
    at, colours = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        colours, at = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    if w * h > MOST_PIXELS:
        raise ValueError("canvas too large")
    canvas = None
    delay, disposal, clear_index, start = 0, 0, None, 0

    def chained(at: int) -> tuple[bytes, int]:
        got = []
        while n := media[at]:
            got.append(media[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(got), at + 1

    while True:
        kind = media[at] if at < len(media) else None
        if kind == 0x3B:
            return
        if kind == 0x21:
            body, end = chained(at + 2)
            if media[at + 1] == 0xF9:
                packed, delay, index = body[0], *struct.unpack("<HB", body[1:4])
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            at = end
        elif kind == 0x2C:
            x, y, fw, fh, packed = struct.unpack("<HHHHB", media[at + 1 : at + 10])
            at, own = at + 10, colours
            if packed & 0x80:
                n = 2 << (packed & 7)
                own, at = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
            if own is None:
                raise ValueError("no palette")
            body, end = chained(at + 1)
            samples = np.frombuffer(lzw_decode(body, media[at], fw * fh), np.uint8)[: fw * fh]
            if len(samples) < fw * fh:
                raise ValueError("too few samples")
            canvas = np.zeros((h, w, 4), np.uint8) if canvas is None else canvas
            samples = samples.reshape(fh, fw)
            if packed & 0x40:
                samples = samples[np.argsort(interlaced(fh))]
            before = canvas.copy() if disposal == 3 else None
            box = canvas[y : y + fh, x : x + fw]
            samples = samples[: box.shape[0], : box.shape[1]]
            shown = np.ones(samples.shape, bool) if clear_index is None else samples != clear_index
            box[shown, :3] = own[samples[shown]]
            box[shown, 3] = 255
            yield Frame(canvas.copy(), start, delay, (x, y, fw, fh))
            start += delay
            if disposal == 2:
                box[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear_index, at = 0, 0, None, end
        else:
            raise ValueError("broken block")


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Shown pixels by ``BINS`` equal ranges of each of red, green and blue, one after the other."""
    shown = pixels[pixels[..., 3] > 0]
    return np.concatenate([np.bincount(shown[:, c] >> 5, minlength=BINS) for c in range(3)])


FRAMES = "frame int, start_cs long, delay_cs int, left int, top int, width int, height int, rgba binary, hist_r array<long>, hist_g array<long>, hist_b array<long>, error string"


def gif_frames(df: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """One row per frame of each media value: its time, box, pixels and histograms; one row with ``error`` where it breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "frame", "start_cs", "delay_cs", "left", "top", "width", "height", "rgba", "hist_r", "hist_g", "hist_b", "error"]
        for batch in batches:
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                try:
                    if media is None:
                        raise ValueError("null")
                    for n, f in enumerate(decode(media), 1):
                        hist = histogram(f.pixels).reshape(3, BINS).tolist()
                        row = [key, n - 1, f.start_cs, f.delay_cs, *f.box, f.pixels.tobytes(), *hist, None]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)
                except (ValueError, IndexError, struct.error) as e:
                    row = [key, n, *[None] * 10, str(e)]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    ints, hist = pa.int32(), pa.list_(pa.int64())
    types = [pa.int64(), ints, pa.int64(), ints, ints, ints, ints, ints, pa.binary(), hist, hist, hist, pa.string()]
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col)).mapInArrow(run, f"id long, {FRAMES}")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def stored(text: str | None) -> tuple:
    """Store a text as GIF, read the stored bytes back, and describe both."""
    n, payload = payload_of(text)
    media = encode(payload)
    sha, tail, size, hist, frames, shown = hashlib.sha256(), b"", 0, np.zeros(3 * BINS, np.int64), 0, 0
    for f in decode(media):
        x, y, w, h = f.box
        part = f.pixels[y : y + h, x : x + w]
        back = part[..., 0].tobytes()
        sha.update(back)
        tail, size, frames, shown = back[-64:], size + len(back), frames + 1, shown + f.delay_cs
        hist += histogram(part)
    feature = f"frames={frames};cs={shown};" + ";".join(f"{c}={','.join(map(str, v))}" for c, v in zip("rgb", hist.reshape(3, BINS).tolist(), strict=True))
    return n, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, frames, media


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_media: bool = False) -> DataFrame:
    """Every whole text stored as GIF samples and read back; ``keep_media`` adds the stored bytes."""
    names = [f.split()[0] for f in STORED.split(", ")] + ["media"] * keep_media
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = zip(*(r if keep_media else r[:-1] for r in map(stored, batch.column(1).to_pylist())), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names)

    schema = STORED + ", media binary" * keep_media
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_batch(run), schema)
