"""Alignment of two tokenizers over the same bytes, as joins of token ends.

Where neither tokenizer lets a token reach across, a document is cut into segments (a run of blanks and what follows up to the
next blank), so that each distinct segment of the corpus is encoded and aligned once, with the number of times that it occurs.

1. ``cut``: documents become lists of segments, in blocks of about BLOCK_BYTES of text; a block keeps its distinct segments.
2. Distinct segments are counted over the corpus and encoded: a row each, with the ids and lengths of both sides' tokens.
3. ``aligned``: tokens are exploded with their positions, a window's running sum of lengths gives each token's end, and both
   sides are joined on (segment, end).  An end of both sides is a cut; the running count of cuts before an end is its group.
   Tokens of a group are grouped together; the two that end at a cut are a link.
4. Links are counted by pair of ids, weighted by how often their segment occurs, and compared with the best of their second id.
5. Each block gets its segments' answers back by a join on the segment and writes its documents' groups in order.

Tokenizers that aren't plain enough for the first step (see ``separable``) have whole documents as their segments, and so has a
document with U+2581, which the second tokenizer can't tell from a blank.

Defined cases: null and empty texts, and those that one side's tokens don't give back, have no tokens: zeros and ''.  Strings of
special tokens are text.  Very long texts are handled whole, and one longer than a block is a block.  Rows with equal or null
doc_ids are rows of their own; exact copies count each; ties between best pairs all count; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, drop, lookup_join, map_batches, release, slices, stored, worker_tables
from .tokenids import _WIDE

#: Text of the documents that share a list of distinct segments, about.
BLOCK_BYTES = 32 << 20
#: A token travels as its id times this, plus the bytes that it stands for, in 32 bits.
LENGTHS = 1 << 14
#: Answers that a task holds before it sends them to their blocks.
PACK_ROWS = 1 << 19
#: Above all ids.
ID = 1 << 17
BLANK, MARK = 32, "▁"


def byte_alphabet() -> dict[str, int]:
    """The character for each byte in a byte-level vocabulary: printable ones stand for themselves, the others are counted up
    from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of their tokens: A by a file of the tokenizers library, B by a sentencepiece model."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=second)
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode() for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(self.a_bytes) > 1 << 17 or len(pieces) > 1 << 17 or max(map(len, [*self.a_bytes.values(), *pieces])) >= LENGTHS // 4:
            raise ValueError("vocabularies of at most 2**17 tokens of at most 4096 bytes")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, segments: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of both sides, id * LENGTHS + bytes; none on either side where one doesn't give the segment back.  A segment
        begins with a blank, which B adds by itself."""
        texts = [s.decode() for s in segments]
        out: tuple[list[list[int]], list[list[int]]] = ([], [])
        for s, x, y in zip(segments, self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            p, q = [self.a_bytes[i] for i in x.ids], [self.b_bytes[i] for i in y]
            same = b"".join(p) == s == b"".join(q)
            out[0].append([i * LENGTHS + len(t) for i, t in zip(x.ids, p, strict=True)] if same else [])
            out[1].append([i * LENGTHS + len(t) for i, t in zip(y, q, strict=True)] if same else [])
        return out


def separable(first: str, second: str) -> bool:
    """Whether a text may be cut before a blank that follows no white space: A splits there by its pattern, and no piece of B
    has a blank after something else."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as spec

    with open(first, encoding="utf-8") as f:
        told = json.load(f)
    pre = told.get("pre_tokenizer") or {}
    a = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not told.get("normalizer")
    model = spec.ModelProto()
    model.ParseFromString(SentencePieceProcessor(model_file=second).serialized_model_proto())
    n, t = model.normalizer_spec, model.trainer_spec
    b = n.name == "identity" and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and t.model_type in (1, 2) and not t.treat_whitespace_as_suffix
    odd = any(p.type == 4 or re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)  # 4: user-defined
    return bool(a and b and not odd)


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where a blank follows what is surely no white space."""
    space = (raw <= BLANK) | (raw == 127)
    for lead, rest in _WIDE.items():
        at = np.flatnonzero(raw == lead)
        width = 1 + rest.shape[1]
        at = at[at + width <= len(raw)]
        for follow in rest if len(at) else ():
            space[at[np.all([raw[at + 1 + i] == x for i, x in enumerate(follow)], axis=0)] + width - 1] = True
    return 1 + np.flatnonzero((raw[1:] == BLANK) & ~space[:-1])


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def cut(docs: DataFrame, apart: bool) -> DataFrame:
    """block, at, segment, many: how often a block has its segment number ``at`` (the most frequent is 0); in a row with at = -1,
    docs (doc_ids and numbers of segments of each document) and path (the numbers of those, one document after another).  Both
    are binary: lists would be measured again and again on their way to Python."""

    def block(number: int, docs_: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
        first = np.cumsum([0, *map(len, texts)])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.zeros(len(raw) + 1, bool)
        if apart and len(raw):
            begins[cuts(raw)] = True
            begins[first[1:] - 1] = False  # a lone blank at the end stays with what is before it
            for k, t in enumerate(texts):
                if MARK.encode() in t:
                    begins[first[k] : first[k + 1]] = False
        begins[first] = True
        at = np.flatnonzero(begins)
        own = np.searchsorted(at, first)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        path = parts.indices.to_numpy()
        many = np.bincount(path, minlength=len(parts.dictionary))
        rank = np.empty(len(many), np.int32)
        rank[np.argsort(-many, kind="stable")] = np.arange(len(many))
        order = pc.sort_indices(parts.dictionary).to_numpy()  # like segments next to each other
        known = parts.dictionary.take(pa.array(order)).cast(pa.binary())
        n = len(known) + 1
        alone = lambda value: pa.array([value, *[None] * (n - 1)], pa.binary())
        docs_batch = pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(np.diff(own), pa.int64())], ["doc_id", "size"])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, number, np.int64)), pa.array(np.concatenate([[np.int32(-1)], rank[order]]).astype(np.int32)), pa.concat_arrays([pa.array([None], pa.binary()), known]), pa.array(np.concatenate([[0], many[order]]).astype(np.int64)),
             alone(_ipc(docs_batch)), alone(zstandard.compress(rank[path].view(np.uint8).reshape(-1, 4).T.tobytes(), 3))],
            ["block", "at", "segment", "many", "docs", "path"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId() << 32, 0
        docs_: list[int | None] = []
        texts: list[bytes] = []
        for batch in slices(batches):
            docs_ += column(batch, "doc_id").to_pylist()
            new = [b" " + t if t else b"" for t in pc.fill_null(column(batch, "text").cast(pa.binary()), b"").to_pylist()]
            texts += new
            total += sum(map(len, new))
            if total > BLOCK_BYTES:
                yield block(number, docs_, texts)
                number, total, docs_, texts = number + 1, 0, [], []
        if docs_:
            yield block(number, docs_, texts)

    schema = "block bigint, at int, segment binary, many bigint, docs binary, path binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_batches, run, schema)


def encoded(segments: DataFrame, first: str, second: str) -> DataFrame:
    """seg, many, a, b (tokens of both sides) of rows (seg, segment, many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (first, second) not in worker_tables:
            worker_tables[first, second] = Pair(first, second)
        pair = worker_tables[first, second]
        for batch in slices(batches, "segment", 1 << 20):
            tokens = pair.encode(column(batch, "segment").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "seg"), column(batch, "many"), *(pa.array(x, pa.list_(pa.int32())) for x in tokens)], ["seg", "many", "a", "b"])

    return segments.select("seg", "segment", "many").transform(map_batches, run, "seg bigint, many bigint, a array<int>, b array<int>", keep_tables=True)


@contextmanager
def _partitions_of_fewer_keys(spark: SparkSession):
    """Meanwhile a join on (segment, end) may use a partitioning by segment alone, which the windows before it need anyway."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def aligned(tokens: DataFrame, widths: dict[str, int]) -> DataFrame:
    """seg, many, links (ids that end together, times ID) and code_a and code_b: in ``widths`` bytes for each token of a side, its
    id and above it, in the topmost bit, whether its group's number is odd.

    Everything is partitioned by segment from the start, so what is sent are the lists of tokens and no more."""

    def ends(side: str) -> DataFrame:
        each = tokens.select("seg", side).repartition("seg").select("seg", F.posexplode(side).alias("pos", "token"))
        running = Window.partitionBy("seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return each.select("seg", "pos", F.expr(f"token div {LENGTHS}").cast("long").alias(side), F.sum(F.col("token") % LENGTHS).over(running).alias("end"))

    def coded(side: str, other: str) -> DataFrame:
        met = ends(side).join(ends(other).drop("pos"), ["seg", "end"], "left")
        before = Window.partitionBy("seg").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
        group = F.count(other).over(before)  # cuts before this token's end
        numbered = met.select("seg", (F.col("pos").cast("long") * (2 * ID) + group % 2 * ID + F.col(side)).alias("x"), (F.col(side) * ID + F.col(other)).alias("link"))
        lists = numbered.groupBy("seg").agg(F.array_sort(F.collect_list("x")).alias("x"), *([F.collect_list("link").alias("links")] if side == "a" else []))
        digits, high = 2 * widths[side], 1 << (8 * widths[side] - 1)
        told = F.transform("x", lambda x: F.lpad(F.hex(x % ID + F.when(x % (2 * ID) >= ID, high).otherwise(0)), digits, "0"))
        return lists.select("seg", F.unhex(F.array_join(told, "")).alias(f"code_{side}"), *(["links"] if side == "a" else []))

    many = tokens.select("seg", "many").repartition("seg")
    return coded("a", "b").join(coded("b", "a"), "seg").join(many, "seg").select("seg", "many", "links", "code_a", "code_b")


def link_counts(segments: DataFrame) -> DataFrame:
    """a, b, count (links that hold the pair, in the whole corpus), best (whether b has none of a higher count)."""
    pairs = segments.select("many", F.explode("links").alias("link")).groupBy("link").agg(F.sum("many").alias("count"))
    counts, _ = stored(pairs.select(F.expr(f"link div {ID}").cast("int").alias("a"), (F.col("link") % ID).cast("int").alias("b"), "count"), "pairs")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def packed(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """block, answers: rows (block, at, scores, codes) of a task, by block and compressed.  scores: n_best and count_sum; codes: both
    sides' tokens, A's first, after their number in four bytes; nulls have none."""

    none = bytes(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            every = pa.Table.from_batches(held).combine_chunks()
            block = every["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            every = every.take(pa.array(order)).combine_chunks().to_batches()[0]
            block = block[order]
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            blobs = []
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True):
                part = every.slice(a, z - a)
                cols = [column(part, "at").to_numpy().astype(np.int32), column(part, "n_best").to_numpy().astype(np.int32), column(part, "count_sum").to_numpy()]
                codes = [x or none for x in column(part, "code").to_pylist()]
                n_a = np.frombuffer(b"".join([x[:4] for x in codes]), ">u4").astype(np.int32)
                size = np.fromiter(map(len, codes), np.int32, len(codes)) - 4
                own = [x[4 : 4 + k] for x, k in zip(codes, (n_a * widths["a"]).tolist(), strict=True)]
                other = [x[4 + k :] for x, k in zip(codes, (n_a * widths["a"]).tolist(), strict=True)]
                lengths = [n_a * widths["a"], size - n_a * widths["a"]]
                blobs.append(zstandard.compress(b"".join([np.array([z - a], np.int32).tobytes(), *(c.tobytes() for c in (*cols, *lengths)), *own, *other]), 3))
            yield pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(blobs, pa.binary())], ["block", "answers"])

        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= PACK_ROWS:
                yield from flush()
                held, waiting = [], 0
        if waiting:
            yield from flush()

    return rows.select("block", "at", "n_best", "count_sum", "code").transform(map_batches, run, "block bigint, answers binary")


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(numbers of segments, [n_best, count_sum], [(lengths in bytes, bytes) of each side]) of some answers."""
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    scores = np.stack([np.frombuffer(raw, np.int32, n, 4 + 4 * n).astype(np.int64), np.frombuffer(raw, np.int64, n, 4 + 8 * n)])
    begin, sides = 4 + 24 * n, []
    for side in (0, 1):
        lengths = np.frombuffer(raw, np.int32, n, 4 + (16 + 4 * side) * n).astype(np.int64)
        sides.append((lengths, np.frombuffer(raw, np.uint8, int(lengths.sum()), begin)))
        begin += len(sides[-1][1])
    return np.frombuffer(raw, np.int32, n, 4), scores, sides


def _tokens(lengths: np.ndarray, raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, whether their groups are odd, tokens of each segment); segments without a code have none."""
    high = 1 << (8 * width - 1)
    value = np.zeros(len(raw) // width, np.int64)
    for k in range(width):
        value = value << 8 | raw[k::width]
    return value & (high - 1), value >= high, lengths // width


def _texts(codes: list[tuple[np.ndarray, np.ndarray]], widths: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """The groups of segments as text, and (tokens of A, tokens of B, groups) of each."""
    sides = [_tokens(*code, widths[s]) for code, s in zip(codes, "ab", strict=True)]
    keys, firsts = [], []
    for _, odd, many in sides:
        first = np.concatenate([[True], odd[1:] != odd[:-1]])[: len(odd)]
        first[(np.cumsum(many) - many)[many > 0]] = True
        firsts.append(first)
        keys.append(2 * np.cumsum(first) + len(keys))  # both sides have the same groups
    order = np.argsort(np.concatenate(keys), kind="stable")
    ids, first = np.concatenate([s[0] for s in sides])[order], np.concatenate(firsts)[order]
    mark = np.where(first, 2 + (order < len(keys[0])), 1)  # 1: goes on, 2: a group's first of B, 3: of A
    many = sides[0][2] + sides[1][2]
    ends = np.concatenate([[0], np.cumsum(many)])
    mark[ends[:-1][many > 0]] = 0
    table = worker_tables.setdefault("ids", {})
    value = ids * 4 + mark
    for v in np.unique(value).tolist():
        if v not in table:
            table[v] = ("", ",", "|", ";")[v & 3] + str(v >> 2)
    words = list(map(table.__getitem__, value.tolist()))
    out = ["".join(words[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    begun = np.concatenate([[0], np.cumsum(firsts[0])])[np.concatenate([[0], np.cumsum(sides[0][2])])]
    return out, np.stack([sides[0][2], sides[1][2], np.diff(begun)])


def answers(rows: DataFrame, widths: dict[str, int], with_groups: bool) -> DataFrame:
    """Documents of blocks whose rows (one with docs and path, others with answers) come one after another."""
    names = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]

    def block(docs: bytes, path: bytes, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        docs_ = pa.ipc.open_stream(docs).read_next_batch()
        planes = np.frombuffer(zstandard.decompress(path), np.uint8)
        way = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()
        n = 1 + int(way.max(initial=-1))
        numbers, groups = np.zeros((len(names), n), np.int64), np.empty(n, object)
        while blobs:
            at, scores, codes = _unpacked(blobs.pop())
            texts, counts = _texts(codes, widths)
            numbers[:, at] = np.concatenate([counts, scores])
            groups[at] = texts
        groups = groups.tolist()
        sizes = column(docs_, "size").to_numpy()
        end = np.cumsum(sizes)
        first = end - sizes
        some = np.flatnonzero(sizes)
        step = 512
        for k in range(0, max(len(sizes), 1), step):
            here = some[(some >= k) & (some < k + step)]
            sums = np.zeros((len(names), min(step, len(sizes) - k)), np.int64)
            if len(here):
                part = way[first[here[0]] : end[here[-1]]]
                sums[:, here - k] = np.add.reduceat(numbers[:, part], first[here] - first[here[0]], axis=1)
            texts = []
            for d in range(k, min(k + step, len(sizes))):
                texts.append(";".join([groups[i] for i in way[first[d] : end[d]].tolist()]) if sums[0, d - k] else "")
            cols = dict(zip(names, sums, strict=True))
            cols["n_links"] = cols["n_groups"]
            digests = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts])
            out = [column(docs_, "doc_id").slice(k, step), *(pa.array(cols[c]) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), digests]
            yield pa.RecordBatch.from_arrays([*out, pa.array(texts)] if with_groups else out, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"][: len(out) + with_groups])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, head, blobs = None, (), []
        for batch in batches:
            for key, docs, path, blob in zip(*(column(batch, c).to_pylist() for c in ("block", "docs", "path", "answers")), strict=True):
                if key != number:
                    if number is not None:
                        yield from block(*head, blobs)
                    number, head, blobs = key, (), []
                if blob is None:
                    head = (docs, path)
                else:
                    blobs.append(blob)
        if number is not None:
            yield from block(*head, blobs)

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return rows.transform(map_batches, run, schema + (", groups string" if with_groups else ""))


def align(docs: DataFrame, first: str, second: str, with_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups; and
    the pairs of ids that are linked anywhere (see link_counts)."""
    spark = docs.sparkSession
    pair = Pair(first, second)
    widths = {"a": 2 if max(pair.a_bytes) < 1 << 15 else 3, "b": 2 if len(pair.b_bytes) <= 1 << 15 else 3}
    blocks, blocks_at = stored(cut(docs, separable(first, second)), "blocks")
    counted = blocks.filter("at >= 0").groupBy("segment").agg(F.sum("many").alias("many")).withColumn("seg", F.monotonically_increasing_id())
    distinct, distinct_at = stored(counted, "segments")
    tokens, tokens_at = stored(encoded(distinct, first, second), "tokens")
    release(spark)
    with _partitions_of_fewer_keys(spark):
        segments, segments_at = stored(aligned(tokens, widths), "aligned")
    drop(tokens_at)
    release(spark)
    pairs, _ = stored(link_counts(segments), "counts")
    links = segments.select("seg", F.explode("links").alias("link")).select("seg", F.expr(f"link div {ID}").cast("int").alias("a"), (F.col("link") % ID).cast("int").alias("b"))
    each = lookup_join(links, pairs, ["a", "b"], "inner", rows=1 << 20)
    scored, scored_at = stored(each.groupBy("seg").agg(F.count(F.when(F.col("best"), 1)).alias("n_best"), F.sum("count").alias("count_sum")), "scored")
    numbers = ["n_best", "count_sum"]
    n_a = F.unhex(F.lpad(F.hex((F.octet_length("code_a") / widths["a"]).cast("long")), 8, "0"))
    known = segments.select("seg", F.concat(n_a, "code_a", "code_b").alias("code")).join(scored, "seg")
    known, known_at = stored(distinct.select("seg", "segment").join(known, "seg").drop("seg"), "known")
    for path in (distinct_at, segments_at, scored_at):
        drop(path)
    release(spark)
    # segments that no side gives back aren't known and have no tokens
    back = blocks.filter("at >= 0").select("block", "at", "segment").join(known.hint("merge"), "segment", "left")
    back, back_at = stored(back.select("block", "at", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], "code").transform(packed, widths), "answers")
    drop(known_at)
    release(spark)
    none = [F.lit(None).cast("binary").alias(c) for c in ("docs", "path")]
    heads = blocks.filter("at < 0").select("block", "docs", "path", F.lit(None).cast("binary").alias("answers"))
    rows = heads.unionByName(back.select("block", *none, "answers")).repartition("block").sortWithinPartitions("block")
    out, _ = stored(rows.transform(answers, widths, with_groups), "documents")
    for path in (blocks_at, back_at):
        drop(path)
    return out, pairs
