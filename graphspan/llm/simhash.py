"""SimHash near-duplicates by the generalised pigeonhole principle.

1. ``fingerprints``: a bit of a document's fingerprint is 1 if it is set in over half of the hashes of its shingles.
2. ``Statistics`` of all different fingerprints: how often each bit and each two bits are set.  ``correlated_parts`` puts bits
   that go together into one part of the 64 bits, so that parts tell fingerprints apart as independently as they can.
3. ``allocate``: two fingerprints that differ in at most ``distance`` bits differ, in some part i, in at most e[i] bits, whenever
   the (e[i] + 1) add up to distance + 1.  A dynamic programme over the parts picks the e (-1: a part isn't asked) that cost
   least: rows to probe with, and candidates, estimated from the collisions of whole parts counted over all fingerprints and
   from the odds that single bits differ.  Two to five parts are tried.
4. Each fingerprint is put under its own value of a part and under those that e[i] flipped bits give; ``links`` verifies what
   meets.  A value that very many share is dealt out in blocks of which each two meet; pairs never leave a task, which gives a
   forest that connects the same fingerprints.  ``components`` does the rest.

Equal fingerprints are one from the start.  Nothing is capped or sampled.

Defined cases: null and empty texts, and those of blanks alone, have the fingerprint zero, which is linked like any other; texts
of fewer words than a shingle are one shingle; very long texts are hashed whole; repeated rows and doc_ids are rows of their
own; null doc_ids take part, and a component of null doc_ids alone has none; ties don't matter; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, drop, lookup_join, map_batches, release, slices, stored, texts_of
from .setjoin import components, least_connected
from .wordhash import Words

BITS = 64
#: What a row that is sent costs, in compared pairs.
ROW_COST = 400
#: Rows under one value that a task compares at once, about.
TASK_ROWS = 1 << 16
#: Rows under one value that are compared by shifting all values' rows along at once; more are taken value by value.
FEW = 64


def fingerprints(texts: list[str], n: int = 4, seed: int = 42) -> np.ndarray:
    words = Words(texts, lower=True)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(words.n)
    if not len(some):
        return out
    many = np.maximum(words.n[some] - n + 1, 1)
    first = np.repeat(words.first[some] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    last = first + np.repeat(np.minimum(words.n[some], n), many) - 1
    buffer, digest = words.buffer, xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(buffer[a:z], seed) for a, z in zip(words.begin[first].tolist(), words.end[last].tolist(), strict=True)), ">u8", len(first))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, np.cumsum(many) - many, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * ones > many[:, None], axis=1).view(">u8").ravel()
    return out


def hashed(docs: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fingerprints(texts_of(batch), n, seed).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_batches, run, "doc_id bigint, fp bigint")


def bit_matrix(fp: np.ndarray) -> np.ndarray:
    """A row of 64 bits, the lowest first, for each fingerprint."""
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, how many have both of two bits set): 64 sums of each task, added up by bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fp = column(batch, "fp").to_numpy().view(np.uint64)
            for a in range(0, len(fp), 1 << 16):
                bits = bit_matrix(fp[a : a + (1 << 16)]).astype(np.float32)
                total, both = total + len(bits), both + (bits.T @ bits).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array([total] * BITS, pa.int64()), pa.array(both.tolist(), pa.list_(pa.int64()))], ["bit", "n", "together"])

    each = distinct.select("fp").transform(map_batches, run, "bit int, n bigint, together array<bigint>")
    rows = each.groupBy("bit").agg(F.sum("n").alias("n"), *[F.sum(F.col("together")[k]).alias(f"b{k}") for k in range(BITS)]).orderBy("bit").collect()
    return (rows[0]["n"], np.array([r[2:] for r in rows], np.float64)) if rows else (0, np.zeros((BITS, BITS)))


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits of each part: a part begins with the bit that goes most with those left and takes what goes most with it."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        alike = np.nan_to_num(np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)))
    np.fill_diagonal(alike, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        part: list[int] = []
        while len(part) < size:
            gain = alike[np.ix_(left, part or left)].sum(axis=1)
            part.append(left.pop(int(np.argmax(gain))))
        out.append(sorted(part))
    return out


def differing(both: np.ndarray, n: int, bits: list[int], most: int) -> np.ndarray:
    """Odds that two fingerprints differ in at most 0, 1, ... most of some bits, taken one by one."""
    p = both.diagonal()[bits] / max(n, 1)
    odds = np.zeros(most + 2)
    odds[0] = 1
    for q in 2 * p * (1 - p):
        odds = odds * (1 - q) + np.concatenate([[0], odds[:-1]]) * q
    return np.cumsum(odds)[: most + 1]


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """(cost, e of each part): the e in -1, 0, ... that cost least with sum of (e + 1) = distance + 1; costs[i][e + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for k in range(distance + 2 - used):
                now = (total + cost[k], [*chosen, k - 1])
                if used + k not in following or now < following[used + k]:
                    following[used + k] = now
        best = following
    return best[distance + 1]


def part_value(fp: Column, bits: list[int]) -> Column:
    """The bits of one part, as a number whose other bits are zero."""
    return fp.bitwiseAND(F.lit(sum(1 << b for b in bits) - (1 << 64 if 63 in bits else 0)).cast("long"))


def plan(distinct: DataFrame, distance: int) -> tuple[list[list[int]], list[int]]:
    """(bits of each part, e of each part) of the cheapest of two to five parts."""
    n, both = bit_statistics(distinct)
    if not n:
        return [], []
    tried = [correlated_parts(n, both, m) for m in range(2, distance + 2)] if distance else [[list(range(BITS))]]
    flat = [(k, i, bits) for k, parts in enumerate(tried) for i, bits in enumerate(parts)]
    values = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), part_value(F.col("fp"), bits).alias("value")) for j, (_, _, bits) in enumerate(flat)]))
    counts = distinct.select(values.alias("x")).groupBy("x.j", "x.value").count()
    met = {r["j"]: r["met"] / n for r in counts.groupBy("j").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("met")).collect()}
    best: tuple[float, list[list[int]], list[int]] | None = None
    for k, parts in enumerate(tried):
        costs = []
        for j, (kk, _, bits) in enumerate(flat):
            if kk != k:
                continue
            odds = differing(both, n, bits, distance)
            candidates = np.minimum(met[j] * odds / max(odds[0], 1e-300), n)
            sent = np.cumsum([comb(len(bits), f) for f in range(distance + 1)])
            costs.append([0.0, *(ROW_COST * sent + candidates).tolist()])
        cost, e = allocate(costs, distance)
        if best is None or cost < best[0]:
            best = (cost, parts, e)
    return best[1], best[2]


def flips(bits: list[int], most: int) -> list[int]:
    """Masks of 1 to most of some bits."""
    return [sum(1 << b for b in some) for k in range(1, most + 1) for some in combinations(bits, k)]


def probes(distinct: DataFrame, parts: list[list[int]], e: list[int]) -> DataFrame:
    """part, value, fp, own (whether the value is the fingerprint's own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(i, np.uint64(sum(1 << b for b in bits)), np.array([0, *flips(bits, e[i])], np.uint64)) for i, bits in enumerate(parts) if e[i] >= 0]
        step = max(1, (1 << 17) // max(len(x[2]) for x in asked))
        for batch in batches:
            every = column(batch, "fp").to_numpy().view(np.uint64)
            for a in range(0, len(every), step):
                fp = every[a : a + step]
                for i, mask, masks in asked:
                    value = ((fp & mask)[:, None] ^ masks).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(value), i, np.int32)), pa.array(value.view(np.int64)), pa.array(np.repeat(fp, len(masks)).view(np.int64)), pa.array(np.tile(masks == 0, len(fp)))], ["part", "value", "fp", "own"]
                    )

    return distinct.select("fp").transform(map_batches, run, "part int, value bigint, fp bigint, own boolean")


def _few_links(key: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among rows of equal keys that lie next to each other, few of each key."""
    out, at = [], np.arange(len(key) - 1)
    shift = 1
    while len(at):
        at = at[at + shift < len(key)]
        at = at[key[at] == key[at + shift]]
        x, y = fp[at], fp[at + shift]
        near = (own[at] | own[at + shift]) & (x != y) & (np.bitwise_count(x ^ y) <= distance)
        if near.any():
            out.append((x[near], y[near]))
        shift += 1
    return out


def _many_links(fp: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect the same fingerprints as all links of at most ``distance`` do.

    Leaders take those within half the distance as their ball: all of a ball are linked.  What else a ball may be linked with is
    within distance + half of its leader; it is compared only where it isn't connected with the ball yet."""
    fp = np.unique(fp)
    half = distance // 2
    ball, leaders, edges = np.full(len(fp), -1), [], []
    for k in range(len(fp)):
        if ball[k] >= 0:
            continue
        mine = np.flatnonzero((ball < 0) & (np.bitwise_count(fp ^ fp[k]) <= half))
        ball[mine] = len(leaders)
        leaders.append(k)
        if len(mine) > 1:
            edges.append((np.full(len(mine), fp[k]), fp[mine]))
    group = np.arange(len(leaders))
    order = np.argsort(ball, kind="stable")
    begin = np.searchsorted(ball[order], np.arange(len(leaders) + 1))
    for b, k in enumerate(leaders):
        other = np.flatnonzero((group[ball] != group[b]) & (np.bitwise_count(fp ^ fp[k]) <= distance + half))
        if not len(other):
            continue
        for x in order[begin[b] : begin[b + 1]]:
            near = other[np.bitwise_count(fp[other] ^ fp[x]) <= distance]
            if len(near):
                edges.append((np.full(len(near), fp[x]), fp[near]))
                joined = np.isin(group, group[ball[near]])
                group[joined] = group[b]
                other = other[group[ball[other]] != group[b]]
                if not len(other):
                    break
    return edges


def links(dealt: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that connect what rows (key, fp, own) of equal keys link; rows of a key come together, sorted by key."""

    def found(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([starts, [len(key)]]))
        small = np.repeat(size <= FEW, size)
        edges = _few_links(key[small], fp[small], own[small], distance)
        for a, many in zip(starts[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            edges += _many_links(fp[a : a + many], distance)
        if edges:
            nodes, least = least_connected(*(np.concatenate([e[i] for e in edges]).view(np.int64) for i in (0, 1)))
            some = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(least[some])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            cols = (column(batch, "key").to_numpy(), column(batch, "fp").to_numpy().view(np.uint64), column(batch, "own").to_numpy(zero_copy_only=False))
            if not len(cols[0]):
                continue
            held.append(cols)
            rows += len(cols[0])
            if rows < TASK_ROWS or held[0][0][0] == cols[0][-1]:
                continue  # one value that goes on: its rows were dealt out, so they are of a bounded number
            cols = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(cols[0] == cols[0][-1], True))
            yield from found(*(c[:cut] for c in cols))
            held, rows = [tuple(c[cut:] for c in cols)], len(cols[0]) - cut
        if held:
            yield from found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.transform(map_batches, run, "a bigint, b bigint")


def deal(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """key, fp, own: a value of a part is one key; one that more than ``task_rows`` rows share is cut into blocks by fingerprint,
    of which each two meet."""
    hot, _ = stored(rows.groupBy("part", "value").count().filter(F.col("count") > task_rows).select("part", "value", F.ceil(2 * F.col("count") / task_rows).cast("int").alias("blocks")), "hot")
    seen = lookup_join(rows, hot, ["part", "value"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("part", "value", F.least(own, j), F.greatest(own, j)))
    keys = F.explode(F.when(F.col("blocks").isNull(), F.array(F.xxhash64("part", "value"))).otherwise(pairs))
    return seen.select(keys.alias("key"), "fp", "own").repartition("key").sortWithinPartitions("key", "fp")


def near_duplicates(docs: DataFrame, distance: int = 4, n: int = 4, seed: int = 42, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the least doc_id that links lead to, itself included)."""
    rows, _ = stored(hashed(docs, n, seed), "hashed")
    distinct, _ = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    parts, e = plan(distinct, distance)
    if not parts:
        return rows.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    edges, edges_at = stored(links(deal(probes(distinct, parts, e), task_rows), distance), "links")
    release(docs.sparkSession)
    labels, _ = stored(components(edges).select(F.col("node").alias("fp"), "label"), "labels")
    drop(edges_at)
    each, _ = stored(lookup_join(labels, distinct, ["fp"], "inner"), "each")
    least, _ = stored(each.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    linked, _ = stored(lookup_join(each.select("fp", "label"), least, ["label"], "inner").select("fp", "component_id"), "components")
    verdict, _ = stored(lookup_join(distinct, linked, ["fp"]).select("fp", F.coalesce("component_id", "doc_id").alias("component_id")), "verdicts")
    return lookup_join(rows, verdict, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
