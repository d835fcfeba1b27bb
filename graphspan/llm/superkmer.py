"""Substring dedup by super-k-mers: consecutive windows that share a minimiser travel as one packed string to its bucket.

1. Texts are stored once in batches (words parted by one blank, compressed), so that a batch is the same in every later job.
2. Windows of ``k`` words are cut into super-k-mers: runs with the same least m-word fingerprint.  A batch sends each distinct
   super-k-mer once, with the least and the greatest doc_id that has it, packed with all others for the same part.
3. A part sorts the windows of super-k-mers that share a minimiser and so finds, exactly, the least doc_id of each window.
   It answers only where that is less than the batch's greatest.
4. A batch takes its answers, marks the covered words of documents with a greater doc_id, and drops them.

A text that a third of all documents share is one row for each batch, so no key is hot.

Defined cases: null or empty texts have no words; documents of fewer than k words lose none; a null doc_id is greater than
all others and never makes another document lose words; rows with equal doc_id don't make each other lose words; a very long text
is a batch by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop, map_batches, release, slices, stored, texts_of
from .wordhash import Words, grams

#: Stands for a null doc_id: greater than all others (a doc_id of 2^63 - 1 ties with it, so neither makes the other lose words).
NULL_DOC = np.iinfo(np.int64).max
#: Bytes of text of a batch, and of all texts for each part.
BATCH_TEXT, PART_TEXT = 4 << 20, 256 << 20
BATCHES = "batch bigint, doc_ids binary, nulls binary, texts binary"
PACKED = "part int, batch bigint, packed binary"
ANSWERS = "batch bigint, part int, answer binary"


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays (8-byte integers) or bytes, each with its size before it, compressed."""
    out = []
    for a in arrays:
        data = a if isinstance(a, bytes) else np.ascontiguousarray(a, np.int64).tobytes()
        out += [len(data).to_bytes(8, "little"), data]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def unpack(data: bytes) -> list[bytes]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def batches_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=BATCH_TEXT):
            ids = column(batch, "doc_id").to_pylist()
            doc = np.array([NULL_DOC if x is None else x for x in ids], np.int64)
            lines = b"\n".join(b" ".join(t.encode("utf-8", "surrogatepass").split()) for t in texts_of(batch))
            yield pa.RecordBatch.from_arrays([pa.array([batch_id]), pa.array([doc.tobytes()]), pa.array([bytes(x is None for x in ids)]), pa.array([zstandard.ZstdCompressor(level=3).compress(lines)])], ["batch", "doc_ids", "nulls", "texts"])
            batch_id += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_batches, run, BATCHES)


class Segments:
    """The distinct super-k-mers of a batch, by part and then in order of appearance, and where each of them stands."""

    def __init__(self, doc_ids: np.ndarray, lines: bytes, k: int, m: int, parts: int):
        self.words = w = Words(lines.split(b"\n"))
        self.doc_ids = doc_ids
        doc = np.repeat(np.arange(len(w.n)), w.n)
        many = len(w.begin) - k + 1
        if many <= 0:
            self.strings, self.minimiser, self.part = [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.low = self.high = self.begin = self.count = self.which = np.zeros(0, np.int64)
            return
        least = grams(w.fingerprints(), m)
        span, have = k - m + 1, 1
        while have * 2 <= span:  # least of 2, 4, 8 ... places, then of span
            least[: len(least) - have] = np.minimum(least[: len(least) - have], least[have:])
            have *= 2
        rest = span - have
        if rest:
            least = np.minimum(least[: len(least) - rest], least[rest:])
        whole = np.flatnonzero(doc[:many] == doc[k - 1 :])
        if not len(whole):
            self.__init__(doc_ids, b"", k, m, parts)  # no window lies in one document
            self.words = w
            return
        value = least[whole]
        starts = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (whole[1:] != whole[:-1] + 1) | (doc[whole[1:]] != doc[whole[:-1]])]))
        self.begin = whole[starts]
        self.count = np.diff(starts, append=len(whole))
        minimiser = value[starts]
        a, z = w.begin[self.begin], w.end[self.begin + self.count + k - 2]
        seen: dict[bytes, int] = {}
        buffer = w.buffer
        which = np.fromiter((seen.setdefault(buffer[i:j], len(seen)) for i, j in zip(a.tolist(), z.tolist(), strict=True)), np.int64, len(a))
        first = np.unique(which, return_index=True)[1]
        part = ((minimiser[first] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        strings = list(seen)
        self.strings, self.minimiser, self.part = [strings[i] for i in order], minimiser[first][order], part[order]
        self.which = place[which]
        ids = doc_ids[doc[self.begin]]
        self.low, self.high = np.full(len(order), NULL_DOC), np.full(len(order), np.iinfo(np.int64).min)
        np.minimum.at(self.low, self.which, ids)
        np.maximum.at(self.high, self.which, ids)

    def bounds(self, parts: int) -> np.ndarray:
        return np.searchsorted(self.part, np.arange(parts + 1))


def window_starts(string: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each window of a super-k-mer, in bytes."""
    blank = np.flatnonzero(np.frombuffer(string, np.uint8) == 32)
    return np.concatenate([[0], blank[: len(blank) - k + 1] + 1]), np.concatenate([blank[k - 1 :], [len(string)]])


def least_documents(strings: list[bytes], low: np.ndarray, k: int) -> list[np.ndarray]:
    """For strings that share a minimiser: the least doc_id of each of their windows, by sorting all windows."""
    windows, lows, owner = [], [], []
    for i, s in enumerate(strings):
        a, z = window_starts(s, k)
        windows += [s[x:y] for x, y in zip(a.tolist(), z.tolist(), strict=True)]
        lows.append(np.full(len(a), low[i]))
        owner.append(len(a))
    least = np.concatenate(lows)
    order = sorted(range(len(windows)), key=windows.__getitem__)
    new = np.fromiter((i == 0 or windows[order[i]] != windows[order[i - 1]] for i in range(len(order))), bool, len(order))
    at = np.array(order)
    best = np.minimum.reduceat(least[at], np.flatnonzero(new))
    out = np.empty(len(at), np.int64)
    out[at] = best[np.cumsum(new) - 1]
    return np.split(out, np.cumsum(owner)[:-1])


def dedup(docs: DataFrame, k: int = 13, m: int = 3, parts: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words parted by one blank), kept_sha256 for every row."""
    if not 1 <= m <= k:
        raise ValueError("1 <= m <= k")
    spark = docs.sparkSession
    held, held_at = stored(batches_of(docs), "batches")
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), held.count() * BATCH_TEXT // PART_TEXT)  # a part doesn't grow with the input

    def segments(batch: pa.RecordBatch, row: int) -> Segments:
        return Segments(numbers(column(batch, "doc_ids")[row].as_py()), zstandard.ZstdDecompressor().decompress(column(batch, "texts")[row].as_py()), k, m, parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = segments(batch, row)
                bounds = s.bounds(parts)
                some = np.flatnonzero(bounds[1:] > bounds[:-1])
                size = np.fromiter(map(len, s.strings), np.int64, len(s.strings))
                blobs = [pack(s.minimiser[a:z].view(np.int64), s.low[a:z], s.high[a:z], size[a:z], b"".join(s.strings[a:z]), level=3) for a, z in ((bounds[p], bounds[p + 1]) for p in some)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([column(batch, "batch")[row].as_py()] * len(some), pa.int64()), pa.array(blobs, pa.binary())], ["part", "batch", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for p, b, data in zip(*(column(batch, c).to_pylist() for c in ("part", "batch", "packed")), strict=True):
                if p != part and rows:
                    yield from answers(part, rows)
                    rows = []
                part = p
                rows.append((b, data))
        if rows:
            yield from answers(part, rows)

    def answers(part: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        minimisers, lows, uses, highs = [], [], [], []
        for _, data in rows:
            mins, low, high, size, blob = unpack(data)
            size = numbers(size)
            ends = np.cumsum(size).tolist()
            uses.append(np.fromiter((index.setdefault(blob[a:z], len(index)) for a, z in zip([0, *ends[:-1]], ends, strict=True)), np.int64, len(size)))
            minimisers.append(numbers(mins))
            lows.append(numbers(low))
            highs.append(numbers(high))
        use = np.concatenate(uses)
        strings = list(index)
        low = np.full(len(strings), NULL_DOC)
        np.minimum.at(low, use, np.concatenate(lows))
        minimiser = np.zeros(len(strings), np.int64)
        minimiser[use] = np.concatenate(minimisers)
        order = np.argsort(minimiser, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], minimiser[order][1:] != minimiser[order][:-1], [True]]))
        shared: dict[int, np.ndarray] = {}  # only strings whose minimiser another string has need their windows sorted
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if z - a > 1:
                group = order[a:z].tolist()
                shared |= zip(group, least_documents([strings[i] for i in group], low[group], k), strict=True)
        best = low.copy()
        for i, x in shared.items():
            best[i] = x.min()
        for (batch, _), use_, high in zip(rows, uses, highs, strict=True):
            told = np.flatnonzero(best[use_] < high)
            if len(told):
                values = [shared[i] if i in shared else low[i : i + 1] for i in use_[told].tolist()]  # one number: all windows alike
                yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([part], pa.int32()), pa.array([pack(told, np.fromiter(map(len, values), np.int64, len(values)), np.concatenate(values))], pa.binary())], ["batch", "part", "answer"])

    packed = held.transform(map_batches, send, PACKED)
    answered, _ = stored(packed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "batch").transform(map_batches, count, ANSWERS), "answers")
    release(spark)
    mine = answered.groupBy("batch").agg(F.collect_list(F.struct("part", "answer")).alias("answers"))  # one batch's, at most one a part

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = segments(batch, row)
                w, bounds = s.words, s.bounds(parts)
                cover = np.zeros(len(w.begin) + 1, np.int64)
                size, values, begin = np.zeros(len(s.strings), np.int64), [], np.zeros(len(s.strings), np.int64)
                at = 0
                for a in column(batch, "answers")[row].as_py() or []:
                    told, many, least = map(numbers, unpack(a["answer"]))
                    told = told + bounds[a["part"]]
                    size[told] = many
                    begin[told] = at + np.cumsum(many) - many
                    values.append(least)
                    at += len(least)
                if values:
                    least = np.concatenate(values)
                    hit = np.flatnonzero(size[s.which] > 0)
                    count_ = s.count[hit]
                    offset = np.arange(int(count_.sum())) - np.repeat(np.cumsum(count_) - count_, count_)
                    string = np.repeat(s.which[hit], count_)
                    window = np.repeat(s.begin[hit], count_) + offset
                    doc = np.searchsorted(w.first, window, side="right") - 1
                    found = least[begin[string] + np.where(size[string] > 1, offset, 0)]
                    gone = window[found < s.doc_ids[doc]]
                    np.add.at(cover, gone, 1)
                    np.subtract.at(cover, gone + k, 1)
                removed = np.cumsum(cover[:-1]) > 0
                lost = np.add.reduceat(np.concatenate([removed, [False]]).astype(np.int64), np.minimum(w.first, len(removed))) * (w.n > 0) if len(w.n) else np.zeros(0, np.int64)
                kept = []
                for d in range(len(w.n)):
                    if lost[d]:
                        stay = ~removed[w.first[d] : w.first[d] + w.n[d]]
                        kept.append(b" ".join(np.array(w.lines[d].split(b" "), object)[stay].tolist()))
                    else:
                        kept.append(w.lines[d])
                nulls = np.frombuffer(column(batch, "nulls")[row].as_py(), np.bool_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, mask=nulls), pa.array(w.n), pa.array(lost), pa.array([x.decode("utf-8", "surrogatepass") for x in kept]), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                    ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
                )

    return held.join(mine, "batch", "left").transform(map_batches, finish, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
