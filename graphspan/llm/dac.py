"""Token ids as directly addressable codes: chunk levels, continuation bitmaps and rank directories.

An id is split into chunks of ``width`` bits, lowest first.  Level 0 holds the lowest chunk of every id; a bitmap beside it
says which ids go on; level 1 holds the next chunk of those that do, and so on.  Token i is read by following
``i -> rank(bitmap, i)`` from level to level, so any token is decoded without its neighbours.

File format: a Parquet folder with a row for each segment of whole documents: ``part`` (range of doc_id, ascending),
``segment`` (within the part), ``doc_ids``, ``doc_tokens`` and ``codes``, without page compression.  ``codes`` is little-endian: magic ``DAC1``, then
uint32 width, tokens, levels; for each level uint32 entries, the chunks (uint8, or uint16 for widths over 8), the bitmap
(little bit order, padded to whole blocks of 512 bits) and for each block a uint32 rank of its first bit.

An empty table gives a folder without segments; a very long document is a segment by itself; rows with equal doc_id follow each
other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, lookup_join, map_batches, slices, stored
from .tokenids import ENCODE_BYTES, encoder, with_end

BLOCK = 512
SEGMENT_TOKENS = 1 << 18
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint32)

SEGMENTS = "part int, segment int, doc_ids array<bigint>, doc_tokens array<bigint>, codes binary"


def encode(ids: np.ndarray, width: int = 8) -> bytes:
    """The codes of one segment."""
    if not 1 <= width <= 16:
        raise ValueError("width must be 1 to 16")
    rest = np.asarray(ids, np.uint32)
    out, kind, levels = [], np.uint8 if width <= 8 else np.uint16, 0
    while levels == 0 or len(rest):
        more = rest >> np.uint32(width)
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = _BITS[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        ranks = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        chunks = (rest & np.uint32((1 << width) - 1)).astype(kind)
        out += [struct.pack("<I", len(rest)), chunks.astype(chunks.dtype.newbyteorder("<")).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = more[goes_on]
        levels += 1
    return b"DAC1" + struct.pack("<III", width, len(ids), levels) + b"".join(out)


class Codes:
    """Reads the codes of one segment."""

    def __init__(self, data: bytes | pa.Buffer):
        data = memoryview(data)
        if bytes(data[:4]) != b"DAC1":
            raise ValueError("not a DAC1 segment")
        self.width, self.tokens, levels = struct.unpack_from("<III", data, 4)
        at, self.levels = 16, []
        kind = np.dtype("<u1" if self.width <= 8 else "<u2")
        for _ in range(levels):
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            chunks = np.frombuffer(data, kind, n, at)
            at += n * kind.itemsize
            blocks = -(-n // BLOCK)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", blocks, at)
            at += 4 * blocks
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """Token i, from one chunk of each of its levels."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += self.width
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * (BLOCK // 8)
            before = bits[first : i >> 3]
            i = int(ranks[i // BLOCK]) + int(_BITS[before].sum()) + int(_BITS[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        """Every token, level by level."""
        out, at = np.zeros(self.tokens, np.uint32), np.arange(self.tokens)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(k * self.width)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


def write(docs: DataFrame, tokenizer: str, end_id: int, width: int = 8, segment_tokens: int = SEGMENT_TOKENS, path: str | None = None) -> tuple[DataFrame, str]:
    """Encode texts (null: empty), end_id after each, and write segments in ascending doc_id order (nulls first; rows with
    equal doc_id in the order of the input) to a folder, or to a scratch one.  Returns the files' rows and the folder.

    Texts are dealt out by ranges of doc_id and place, so no task holds more than its range, whatever ids repeat; a segment
    has whole documents and about segment_tokens ids, or one longer document.  Pages aren't compressed: a chunk lies at its
    own address in the file's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, total = [], 0  # (doc_ids, sizes, ids) of the segment begun

        def cut() -> pa.RecordBatch:
            doc_ids, sizes, ids = (pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), whole(doc_ids), whole(pa.array(sizes)), pa.array([encode(ids, width)], pa.binary())],
                ["part", "segment", "doc_ids", "doc_tokens", "codes"],
            )

        for batch in slices(batches, limit=ENCODE_BYTES):
            ids, bounds = with_end(*enc.encode(column(batch, "text")), end_id)
            doc_ids, at = column(batch, "doc_id"), 0
            while at < len(bounds) - 1:
                # as many documents as the segment has room for, or one if it is empty
                upto = max(int(np.searchsorted(bounds, bounds[at] + segment_tokens - total, side="right")) - 1, at + (not held))
                if upto > at:
                    held.append((doc_ids.slice(at, upto - at), np.diff(bounds[at : upto + 1]), ids[bounds[at] : bounds[upto]]))
                    total += int(bounds[upto] - bounds[at])
                at = upto
                if at < len(bounds) - 1:
                    yield cut()
                    number, held, total = number + 1, [], 0
        if held:
            yield cut()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    return stored(dealt.transform(map_batches, run, SEGMENTS, keep_tables=True), "dac", "none", path)


def part_starts(segments: DataFrame) -> dict[int, int]:
    """Ids before each part.  A row for each part is collected: as many as there were write tasks, whatever the input."""
    totals = segments.groupBy("part").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).collect()
    out, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        out[r["part"]] = at
        at += r["n"]
    return out


def places(segments: DataFrame) -> DataFrame:
    """part, segment, tokens and before (tokens of the same part before it), by the segments' own counts."""
    sizes = segments.select("part", "segment", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("tokens"))
    earlier = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # a part has few segments
    return sizes.select("part", "segment", "tokens", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))


def lookup(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """position, token: the token at each distinct position (of all ids in file order), read by its own chunks alone; null
    beyond the last one and for negative positions.  positions has a column ``position``; null ones are left out.

    A position finds its segment by equal blocks of SEGMENT_TOKENS positions.  A segment's codes are sent once for at most 16384
    of the positions that it holds, so a segment that many ask for is dealt out too.
    """
    starts = part_starts(segments)
    first = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("part")] if starts else F.lit(None).cast("long")
    held = places(segments).filter("tokens > 0").select("part", "segment", (first + F.col("before")).alias("first"), "tokens")
    block = lambda c: F.floor(c / SEGMENT_TOKENS)
    held = held.withColumn("block", F.explode(F.sequence(block(F.col("first")), block(F.col("first") + F.col("tokens") - 1))))
    asked = positions.select(F.col("position").cast("long").alias("position")).filter("position is not null").distinct()
    found = asked.withColumn("block", block(F.col("position"))).join(held, "block").filter("position between first and first + tokens - 1")
    wanted = found.groupBy("part", "segment", "first", F.floor(F.col("position") / 16384)).agg(F.collect_list("position").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, wanted_, data in zip(*(column(batch, c).to_pylist() for c in ("first", "positions", "codes")), strict=True):
                codes = Codes(data)
                yield pa.RecordBatch.from_arrays([pa.array(wanted_, pa.int64()), pa.array([codes.token(i - begin) for i in wanted_], pa.int64())], ["position", "token"])

    got = wanted.select("part", "segment", "first", "positions").join(segments.select("part", "segment", "codes"), ["part", "segment"])
    got = got.select("first", "positions", "codes").transform(map_batches, run, "position bigint, token bigint")
    return asked.join(got, "position", "left")


def read(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row for each document, from the files alone: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and,
    if asked for, ids.  Segments of a part are placed by their own counts."""
    starts, placed = part_starts(segments), places(segments).select("part", "segment", "before")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: column(batch, name)[row]  # noqa: B023, E731
                ids, size = Codes(get("codes").as_buffer()).all().astype("<u4"), get("doc_tokens").values.to_numpy()
                ends = np.cumsum(size)
                begins, raw = ends - size, memoryview(ids.tobytes())
                first = starts[get("part").as_py()] + get("before").as_py()
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)), np.int64, len(size))
                cols = [get("doc_ids").values, pa.array(begins + first), pa.array(size), pa.array(crc)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return lookup_join(segments, placed, ["part", "segment"], "inner").transform(map_batches, run, schema)
