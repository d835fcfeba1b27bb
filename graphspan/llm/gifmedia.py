"""GIF media columns: encode bytes as frames of 8-bit samples, decode code streams, compose timed frames, colour histograms.

The decoder reads GIF87a and GIF89a: global and local palettes, LZW with variable code sizes and deferred clears, interlace,
transparency, disposal (none, background, previous) and delays.  The encoder writes a grey palette of 256 entries, in which a
sample is its own palette index, rows of 64 samples and frames of at most ``frame_rows`` rows, each with a delay.

Code streams are read and written a table's life at a time: between two clear codes the width of the i-th code depends on i
alone, so bits are packed and unpacked by whole arrays; only the table itself is walked code by code.

Stored media are read back frame by frame as they are shown: palettes, transparency and disposal are applied to a canvas, whose
colours make a frame's histogram.

Defined cases: null or empty texts are one row of 64 zero bytes when stored as a payload; a very long text is many frames of
one medium; null, malformed, truncated or oversized media (over MOST_PIXELS) are one row with an ``error`` and nulls; a frame
that lies beyond the screen shows nothing; rows are handled each by itself, and equal texts of a batch once; an empty table
gives no rows; other columns are ignored.
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

from .common import column, map_batches, slices, stored, texts_of

WIDTH = 64
FRAME_ROWS = 1024
TABLE = 4096
#: Pixels that a screen or a frame may have.
MOST_PIXELS = 1 << 26
#: Bins of a colour histogram, for each of red, green and blue.
BINS = 8


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    indices: np.ndarray  # height x width
    interlaced: bool = False


def code_widths(codes: int, smallest: int) -> np.ndarray:
    """Bits of each code read after a clear: the table grows by one with every code but the first."""
    entries = np.minimum((1 << smallest) + 2 + np.maximum(np.arange(codes), 0), TABLE)
    # a reader has one entry less than a writer; its width grows when the next free entry is a power of two
    free = np.maximum(entries - 1, (1 << smallest) + 2)
    return np.minimum(np.maximum(smallest + 1, np.floor(np.log2(free)).astype(np.int64) + 1), 12)


_WIDTHS = {s: code_widths(TABLE + 2, s) for s in range(2, 9)}
_OFFSETS = {s: np.concatenate([[0], np.cumsum(w)]) for s, w in _WIDTHS.items()}


def lzw_encode(samples: bytes, smallest: int = 8) -> bytes:
    """A code stream: clear, codes, and a clear whenever the table is full."""
    clear, end = 1 << smallest, (1 << smallest) + 1
    widths, lives, out = _WIDTHS[smallest], [], []
    table: dict[int, int] = {}  # (code of a word, next sample) -> code of the longer word
    get, put, free = table.get, out.append, end + 1
    rest = iter(samples)
    word = next(rest, None)
    for sample in rest:
        if word is None:
            word = sample
            continue
        longer = word << 8 | sample
        known = get(longer)
        if known is not None:
            word = known
            continue
        put(word)
        table[longer] = free
        free += 1
        word = sample
        if free == TABLE:
            out += (word, clear)
            lives.append(out)
            word, table, out, free = None, {}, [], end + 1
            get, put = table.get, out.append
    if word is not None:
        put(word)
    put(end)
    lives.append(out)
    values = np.array([clear] + [c for life in lives for c in life], np.uint32)
    width = np.concatenate([[smallest + 1], *(widths[: len(life)] for life in lives)])
    return pack_bits(values, width)


def pack_bits(values: np.ndarray, width: np.ndarray) -> bytes:
    at = np.cumsum(width) - width
    total = int(width.sum())
    out = np.zeros((total + 7) // 8 + 4, np.uint8)
    shifted = values.astype(np.uint64) << (at & 7).astype(np.uint64)
    for k in range(3):  # a code of 12 bits meets three bytes at most; each bit is set once, so adding is or-ing
        np.add.at(out, (at >> 3) + k, ((shifted >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8))
    return out[: (total + 7) // 8].tobytes()


def lzw_decode(stream: bytes, smallest: int, expected: int) -> bytes:
    """Samples of a code stream, at most ``expected``."""
    clear, end = 1 << smallest, (1 << smallest) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    bits, at, out, total = 8 * len(stream), 0, [], 0
    offsets, widths = _OFFSETS[smallest], _WIDTHS[smallest]
    fresh: list[bytes] = [bytes((i,)) for i in range(clear)] + [b"", b""]
    full = len(widths)
    while at < bits and total < expected:
        # as many codes as one table's life can have; a table that stays full goes on with 12 bits
        n = min(full, int(np.searchsorted(offsets, bits - at, side="right")) - 1)
        where = at + offsets[:n]
        byte = where >> 3
        window = raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)
        codes = (window >> (where & 7).astype(np.uint32)) & ((np.uint32(1) << widths[:n].astype(np.uint32)) - np.uint32(1))
        stops = np.flatnonzero((codes == clear) | (codes == end))
        life = int(stops[0]) if len(stops) else n
        grows = TABLE - end  # codes until the table is full, the first of which adds nothing
        table = list(fresh)
        add, put = table.append, out.append
        some = codes[:life].tolist()
        if some:
            previous = table[some[0]]
            put(previous)
            for c in some[1:grows]:
                try:
                    word = table[c]
                except IndexError:
                    if c > len(table):
                        raise ValueError("a code before its entry") from None
                    word = previous + previous[:1]
                add(previous + word[:1])
                put(word)
                previous = word
            out += [table[c] for c in some[grows:]]
            total += sum(map(len, out[len(out) - len(some) :]))
        if not len(stops):
            if n < full:
                break
            at += int(offsets[n])
            while at + 12 <= bits and total < expected:  # a full table that isn't cleared
                b = at >> 3
                c = (int(raw[b]) | int(raw[b + 1]) << 8 | int(raw[b + 2]) << 16) >> (at & 7) & 0xFFF
                at += 12
                if c in (clear, end):
                    break
                out.append(table[c])
                total += len(table[c])
            else:
                break
            if c == end:
                break
            continue
        at += int(offsets[life] + widths[life])
        if codes[life] == end:
            break
    return b"".join(out)[:expected]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _unblocked(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while (n := data[at]) > 0:
        out.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(out), at + 1


GREY = bytes(x for i in range(256) for x in (i, i, i))


def encode(payload: bytes, delay: int = 10, frame_rows: int = FRAME_ROWS) -> bytes:
    """A GIF89a of the payload (a multiple of 64 bytes): rows of 64 grey samples, frames of at most frame_rows rows."""
    rows = len(payload) // WIDTH
    if not rows or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, frame_rows), 0xF7, 0, 0), GREY]
    for first in range(0, rows, frame_rows):
        n = min(frame_rows, rows - first)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, n, 0), b"\x08", _blocks(lzw_encode(payload[first * WIDTH : (first + n) * WIDTH]))]
    return b"".join(out) + b"\x3b"


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def parse(data: bytes) -> tuple[int, int, int, list[Frame]]:
    """(width, height, background index, frames) of a GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError(f"a screen of {width} x {height} pixels")
    shared, at = _palette(data, 13, flags)
    frames, delay, disposal, transparent = [], 0, 0, None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1]
            body, at = _unblocked(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = bits >> 2 & 7, index if bits & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, flags)
        smallest = data[at]
        if not 2 <= smallest <= 8 or w * h > MOST_PIXELS:
            raise ValueError(f"code size {smallest}, {w} x {h} pixels")
        stream, at = _unblocked(data, at + 1)
        pixels = lzw_decode(stream, smallest, w * h)
        if len(pixels) < w * h:
            raise ValueError(f"{len(pixels)} of {w * h} pixels")
        flat = np.frombuffer(pixels, np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(flat)
            straight[order] = flat
            flat = straight
        palette = own if own is not None else shared if shared is not None else np.zeros((256, 3), np.uint8)
        frames.append(Frame(left, top, w, h, delay, disposal, transparent, palette, flat, bool(flags & 0x40)))
        delay, disposal, transparent = 0, 0, None
    return width, height, background, frames


@dataclass
class Shown:
    """A frame as it is shown: the canvas (height x width x RGBA, valid until the next one) and the part that the frame covers."""

    start: int
    delay: int
    canvas: np.ndarray
    area: tuple[slice, slice]

    def histogram(self) -> list[int]:
        """Pixels that aren't transparent by red, green and blue, BINS each."""
        flat = self.canvas.reshape(-1, 4)
        if not self.canvas[..., 3].all():
            flat = flat[flat[:, 3] > 0]
        return [n for c in range(3) for n in np.bincount(flat[:, c] // (256 // BINS), minlength=BINS).tolist()]


def compose(data: bytes) -> Iterator[Shown]:
    """The frames of a GIF as they are shown, with their start in hundredths of a second."""
    width, height, _, frames = parse(data)
    canvas, at = np.zeros((height, width, 4), np.uint8), 0
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        area = (slice(min(f.top, height), min(height, f.top + f.height)), slice(min(f.left, width), min(width, f.left + f.width)))
        part = canvas[area]
        shown = f.indices[: part.shape[0], : part.shape[1]]
        palette = np.concatenate([f.palette, np.full((len(f.palette), 1), 255, np.uint8)], axis=1)
        colours = palette[shown if len(palette) == 256 else np.minimum(shown, len(palette) - 1)]
        if f.transparent is None:
            part[:] = colours
        else:
            mask = shown != f.transparent
            part[mask] = colours[mask]
        yield Shown(at, f.delay, canvas, area)
        at += f.delay
        if f.disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before


def _failure(data: bytes | None, wrong: Exception | None) -> str:
    return "no media" if data is None else f"{type(wrong).__name__}: {wrong}"


_BROKEN = (ValueError, IndexError, KeyError, struct.error)

MEDIA = "doc_id bigint, n_bytes bigint, media binary"
FRAMES = "doc_id bigint, frame int, start bigint, delay int, width int, height int, histogram array<bigint>, canvas binary, error string"
DIGESTS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string"


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def store(docs: DataFrame, path: str | None = None) -> DataFrame:
    """MEDIA rows: every whole text as a GIF, written to a folder (or a scratch one) and read from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            made = {t: encode(payload_of(t)) for t in dict.fromkeys(texts)}
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([made[t] for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.transform(map_batches, run, MEDIA), "media", "none", path)[0]


def frames(media: DataFrame) -> DataFrame:
    """FRAMES rows: the timed frames of each medium as they are shown, each by itself, with colour histogram and canvas (RGBA
    bytes); one row with an error for media that can't be read to the end, after the frames before it."""

    def rows_of(doc: int | None, data: bytes | None) -> Iterator[tuple]:
        try:
            if data is None:
                raise ValueError
            for k, f in enumerate(compose(data)):
                yield doc, k, f.start, f.delay, f.canvas.shape[1], f.canvas.shape[0], f.histogram(), f.canvas.tobytes(), None
        except _BROKEN as wrong:
            yield doc, None, None, None, None, None, None, None, _failure(data, wrong)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.string()]
        names = [x.split(" ")[0] for x in FRAMES.split(", ")]
        for batch in slices(batches, "media"):
            for doc, data in zip(column(batch, "doc_id").to_pylist(), column(batch, "media").to_pylist(), strict=True):
                for row in rows_of(doc, data):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    return media.select("doc_id", "media").transform(map_batches, run, FRAMES)


def digests(media: DataFrame) -> DataFrame:
    """DIGESTS rows of stored media.  The payload is what the frames show (red of the part that each covers); feature: frames,
    whole duration, and the colour histogram summed over frames as they are shown."""

    def read(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6 + (_failure(data, None),)
        whole, samples, count, end, total = (len(data), hashlib.sha256(data).hexdigest()), [], 0, 0, np.zeros(3 * BINS, np.int64)
        try:
            for f in compose(data):
                samples.append(f.canvas[(*f.area, 0)].tobytes())
                count, end = count + 1, f.start + f.delay
                total += f.histogram()
        except _BROKEN as wrong:
            return None, None, None, *whole, None, _failure(data, wrong)
        payload = b"".join(samples)
        feature = f"frames={count};duration={end};histogram={','.join(map(str, total.tolist()))}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), *whole, feature, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            data = column(batch, "media").to_pylist()
            made = {d: read(d) for d in dict.fromkeys(data)}
            cols = list(zip(*(made[d] for d in data), strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [x.split(" ")[0] for x in DIGESTS.split(", ")])

    return media.select("doc_id", "n_bytes", "media").transform(map_batches, run, DIGESTS)
