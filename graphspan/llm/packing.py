"""Packing by power-of-two decomposition: binary-length pieces in buckets of equal length; no sequence crosses documents.

A document of n ids gives as many pieces of ``max_len`` as fit and then one piece for each binary digit of what is left,
longest first.  Each piece is a sequence by itself; its length is a power of two, so none is padded.  Sequences are numbered
bucket after bucket (longest first), without gaps: a batch of one bucket is a run of sequence_id.

A very long text is encoded whole, in a slice of its own; pieces of one length are numbered by task and place, so ties have one
order in a run; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, slices, stored
from .tokenids import ENCODE_BYTES, encoder, with_end


def piece_lengths(n: np.ndarray, max_len: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of all pieces, how many each document of n ids has): max_len as often as it fits, then the binary digits of the
    rest, longest first."""
    kinds = 1 << np.arange(max_len.bit_length())[::-1]
    many = np.concatenate([n[:, None] // max_len, (n[:, None] & kinds[1:]) > 0], axis=1)
    return np.repeat(np.tile(kinds, len(n)), many.ravel()), many.sum(axis=1)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, max_len: int = 1024, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0) and, if asked for, ids.

    A null or empty text is its end id alone.  Rows with equal doc_id are packed each by itself.  Other columns are ignored.
    max_len must be a power of two.  Texts aren't shuffled; numbers need the counts of each task and length, which are
    collected: as many rows as tasks times lengths.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, place bigint" + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), {1 << b: 0 for b in range(max_len.bit_length())}
        for batch in slices(batches, limit=ENCODE_BYTES // 2):
            ids, bounds = with_end(*enc.encode(column(batch, "text")), end_id)
            n = np.diff(bounds)
            length, many = piece_lengths(n, max_len)
            end = np.cumsum(length)
            begin, doc = end - length, np.repeat(np.arange(len(n)), many)
            raw = memoryview(ids).cast("B")
            crc = np.fromiter((zlib.crc32(raw[a:z]) for a, z in zip((4 * begin).tolist(), (4 * end).tolist(), strict=True)), np.int64, len(end))
            place = np.empty(len(end), np.int64)
            for kind, before in seen.items():
                at = np.flatnonzero(length == kind)
                place[at] = before + np.arange(len(at))
                seen[kind] += len(at)
            cols = [column(batch, "doc_id").take(pa.array(doc)), *(pa.array(x) for x in (begin - bounds[doc], length, crc, n[doc], np.full(len(end), part, np.int32), place))]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place", "ids"][: len(cols)])

    pieces, _ = stored(map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema, keep_tables=True), "pieces")
    counts = sorted(pieces.groupBy("part", "length").count().collect(), key=lambda r: (-r["length"], r["part"]))
    first, at = [], 0
    for r in counts:
        first.append((r["part"], r["length"], at))
        at += r["count"]
    firsts = docs.sparkSession.createDataFrame(first, "part int, length bigint, first bigint")
    return pieces.join(F.broadcast(firsts), ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else [])
    )
