"""Exact n-gram Jaccard join with set relations: who is linked, how often, and which component each document belongs to.

Documents become sets of word n-gram fingerprints (64 bits); a set is known by 128 bits, and equal sets are one from the start.

1. ``_ranks``: counters of all n-grams, a table of fixed size, give one order of tokens for everyone: rare ones first.
2. ``_index``: two sets of Jaccard >= t share a token among the first n - ceil(t n) + 1 of each.  Index lists of those tokens,
   sorted by set size, are cut where sizes are too far apart; what is left connects sets into candidate clusters.  Lists that
   the counters tell to be long are dealt out over several tasks, as many as their length asks for.  Of a short list every two
   sets are a pair, which is dropped if their sketches differ too much for a link (see ``sketch``): where the counters are full,
   sets meet in tokens that aren't rare, and unlike ones would chain up into one very large cluster.
3. ``Cluster`` joins the sets of a cluster exactly: a probe skips blocks of index lists by position, and a set that is much like
   a probed one derives its answers from that one's and the tokens in which they differ.  Clusters of many tokens are cut by
   size into windows and these into blocks (see ``_tasks``): each two sets meet in one task.

A task gives the number of links of each set and a forest of links that connects the same sets; pairs never leave it.
Components come from iterated joins.  Nothing is capped.

Defined cases: null or empty texts have an empty set and are linked with nothing; texts of fewer words than n have the whole
sequence as one token; rows with equal doc_id are rows of their own; null doc_ids take part, and a component of null doc_ids
alone has none; ties don't matter; a very long text is one set, taken whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop, lookup_join, map_batches, numbered, release, slices, stored, texts_of
from .wordhash import Words, grams, mix

#: Counters of the table that a task adds up.
PART_COUNTERS = 1 << 19
#: Bounds of the table of counters: at most 2**26 of two bytes are sent to the executors.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 18, 1 << 25
#: Edges that a task connects by itself.
TASK_EDGES = 1 << 20
#: Index lists longer than this are dealt out.
LONG_LIST = 2000
#: In runs of at most so many sets every two are a pair; in longer ones each set and the next.
SHORT_RUN = 16
#: Words of 64 bits of a set's sketch.
SKETCH = 8


def token_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram fingerprints of each text."""
    w = Words(texts, lower=True)
    prints = w.fingerprints()
    tokens = grams(prints, n)
    out = []
    for first, many in zip(w.first.tolist(), w.n.tolist(), strict=True):
        if many >= n:
            out.append(np.unique(tokens[first : first + many - n + 1]))
        elif many:
            out.append(mix(np.array([int(grams(prints[first : first + many], many)[0]) ^ many], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set: its node, and a mark that tells different sets of one node apart."""
    if not len(tokens):
        return 0, 0
    mixed = mix(tokens)
    x = np.array([int(tokens.sum(dtype=np.uint64)) ^ int(np.bitwise_xor.reduce(mixed)) ^ len(tokens), int(mixed.sum(dtype=np.uint64))], np.uint64)
    node, mark = mix(x).view(np.int64).tolist()
    return node, mark


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A bit for each class of tokens: whether the set has an odd number of them.  Bits in which two sketches differ are classes of
    which one set has a token that the other lacks, so two sets differ by at least as many tokens."""
    at = np.bincount((mix(tokens) >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(at.astype(np.uint8)).view(np.int64)


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, t: Fraction):
    """Least |x & y| for sizes a and b: ceil(t (a + b) / (1 + t)), in whole numbers."""
    p, q = t.numerator, t.denominator
    return -((-p * (a + b)) // (p + q))


def prefix_size(n: int, t: Fraction) -> int:
    return n - -((-t.numerator * n) // t.denominator) + 1


def _ranks(docs: DataFrame, n: int, counters: int) -> np.ndarray:
    """How common n-grams are that fall on each counter, over all rows, in steps of a quarter of a power of two (see ``times``).
    One byte for each counter; a table of fixed size whatever the input."""
    parts = max(1, counters // PART_COUNTERS)
    width = counters // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(counters, np.uint16), [], 0  # of one task; sums over tasks are wider

        def flush() -> None:
            at, n = np.unique((np.concatenate(held) & np.uint64(counters - 1)).astype(np.uint32), return_counts=True)
            total[at] = np.minimum(total[at] + n, 65535)

        for batch in slices(batches):
            for s in token_sets(texts_of(batch), n):
                held.append(s)
                waiting += len(s)
                if waiting > 1 << 19:
                    flush()
                    held, waiting = [], 0
        if waiting:
            flush()
        for part, x in enumerate(total.reshape(parts, width)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(column(batch, "part").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
                if part not in sums:
                    sums[part] = np.zeros(width, np.int64)
                sums[part] += np.frombuffer(zstandard.decompress(data), np.uint16)
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zstandard.compress(np.minimum(4 * np.log2(1 + x), 255).astype(np.uint8).tobytes(), 1)], pa.binary())], ["part", "ranks"])

    rows = docs.transform(map_batches, count, "part int, counts binary").repartitionById(parts, F.col("part")).transform(map_batches, add, "part int, ranks binary").collect()
    out = np.zeros((parts, width), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(zstandard.decompress(r["ranks"]), np.uint8)
    return out.ravel()


def times(rank: np.ndarray) -> np.ndarray:
    """About how often an n-gram of this rank occurs."""
    return np.exp2(rank / 4) - 1


def _index(docs: DataFrame, n: int, t: Fraction, counts, bits: int = 64) -> DataFrame:
    """A row for each batch: its documents' nodes, and the postings (token, list, node, size) of the nodes that this task has
    not sent before."""
    kinds = "doc_ids array<bigint>, rows array<bigint>, sizes array<bigint>, nodes array<bigint>, marks array<bigint>, tokens array<bigint>, lists array<int>, post_nodes array<bigint>, post_sizes array<int>, set_nodes array<bigint>, set_sizes array<int>, sketches array<array<bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        last, sent = np.uint64(len(table) - 1), set()
        for batch in slices(batches):
            sets = token_sets(texts_of(batch), n)
            signed = [(node if bits == 64 else node & (1 << bits) - 1, mark) for node, mark in map(signature, sets)]
            tokens, lists, own, size, sketched = [], [], [], [], []
            for s, both in zip(sets, signed, strict=True):
                if not len(s) or both in sent:
                    continue
                sent.add(both)
                node = both[0]
                sketched.append((node, len(s), sketch(s)))
                rank = table[(s & last).astype(np.int64)]
                k = prefix_size(len(s), t)
                # rare first; equal counts in the order of the tokens, which is that of the set
                first = np.argsort(rank, kind="stable")[:k]
                long = (times(rank[first]) / LONG_LIST).astype(np.int64)
                tokens.append(s[first])
                lists.append(np.where(long > 0, 1 + (node % np.maximum(long, 1)), 0))
                own.append(np.full(len(first), node))
                size.append(np.full(len(first), len(s)))
            join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            arrays = [
                column(batch, "doc_id").to_pylist(), column(batch, "_row").to_numpy(),
                np.fromiter(map(len, sets), np.int64, len(sets)), *np.array(signed, np.int64).reshape(-1, 2).T, join(tokens, np.uint64).view(np.int64), join(lists, np.int32), join(own, np.int64), join(size, np.int32), *([x[i] for x in sketched] for i in (0, 1, 2)),
            ]
            types = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.list_(x)) for a, x in zip(arrays, types, strict=True)], ["doc_ids", "rows", "sizes", "nodes", "marks", "tokens", "lists", "post_nodes", "post_sizes", "set_nodes", "set_sizes", "sketches"])

    return docs.transform(map_batches, run, kinds)


def _list_links(postings: DataFrame, t: Fraction) -> DataFrame:
    """kind 0: (a, b): nodes next to each other in a run of one list: sizes that allow a link with the size before.
    kind 1: the runs of lists that were dealt out: token, node, least and greatest size.
    kind 2: (a, b): of a short run of a list that wasn't dealt out, every two nodes whose sizes allow a link."""
    p, q = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
            same = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])  # a set that several tasks have sent
            token, lst, size, node = (c[np.concatenate([[True], ~same])] for c in cols)
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (lst[1:] != lst[:-1]) | (size[:-1].astype(np.int64) * q < p * size[1:].astype(np.int64))])
            starts = np.flatnonzero(new)
            many = np.diff(np.concatenate([starts, [len(token)]]))
            short = np.repeat((many <= SHORT_RUN) & (lst[starts] == 0), many)
            link = np.flatnonzero(~new & ~short & (node != np.roll(node, 1)))
            pairs = np.unique(np.sort(np.stack([node[link], node[link - 1]]), axis=0), axis=1)
            run_of, first_of, second_of = np.repeat(np.arange(len(starts)), many), [], []
            for k in range(1, SHORT_RUN):
                i = np.flatnonzero(short[k:] & (run_of[k:] == run_of[:-k]) & (node[k:] != node[:-k]) & (size[:-k].astype(np.int64) * q >= p * size[k:].astype(np.int64)))
                if not len(i):
                    continue
                first_of.append(node[i])
                second_of.append(node[i + k])
            close = np.unique(np.sort(np.stack([np.concatenate(first_of), np.concatenate(second_of)]), axis=0), axis=1) if first_of else np.zeros((2, 0), np.int64)
            tail = np.flatnonzero(lst[starts] > 0)
            first = starts[tail]
            end = np.concatenate([starts[1:], [len(token)]])[tail] - 1
            n, none = pairs.shape[1], np.zeros(pairs.shape[1] + close.shape[1], np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([0, 2, 1], [n, close.shape[1], len(tail)]).astype(np.int32)), pa.array(np.concatenate([pairs[0], close[0], token[first]])), pa.array(np.concatenate([pairs[1], close[1], node[first]])),
                 pa.array(np.concatenate([none, size[first]])), pa.array(np.concatenate([none, size[end]]))],
                ["kind", "a", "b", "low", "high"],
            )

        for batch in batches:
            cols = [column(batch, c).to_numpy() for c in ("token", "list", "size", "node")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            token = cols[0]
            # the last list may go on; a list that alone outgrows the bound is cut between sizes, its runs meeting by kind 1
            cut = int(np.searchsorted(token == token[-1], True)) if len(token) else 0
            if cut:
                yield flush([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield flush(held)

    return postings.transform(map_batches, run, "kind int, a bigint, b bigint, low int, high int")


def _near_pairs(pairs: DataFrame, sketches: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) of nodes whose sketches (node, size, sketch) don't rule a link out; a node that several sets share has several
    sketches, of which any two may do."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = lookup_join(lookup_join(pairs, side("a"), ["a"], "inner"), side("b"), ["b"], "inner")
    differ = sum((F.bit_count(F.get("sketch_a", F.lit(k)).bitwiseXOR(F.get("sketch_b", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    # least_overlap in whole numbers: two linked sets differ by at most a + b - 2 * ceil(p (a + b) / (p + q)) tokens
    total, p, q = (F.col("size_a") + F.col("size_b")).cast("long"), t.numerator, t.denominator
    overlap = F.expr(f"-((-{p} * (cast(size_a as bigint) + size_b) - pmod(-{p} * (cast(size_a as bigint) + size_b), {p + q})) div {p + q})")
    return both.filter(differ <= total - 2 * overlap).select("a", "b").distinct()


def least_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each is connected with) of edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        before = root.copy()
        for side in (x, y):  # hang the roots on what their nodes' neighbours have
            np.minimum.at(root, before[side], least)
            np.minimum.at(root, side, least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """node, label: the least node that the edges (a, b) of a task connect it with; edges are dealt to so many tasks by a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(column(x, "a").to_numpy(), column(x, "b").to_numpy()) for x in batches]
        if held:
            nodes, labels = least_connected(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "label"])

    dealt = edges.repartition(1) if tasks == 1 else edges.repartition(tasks, "a")
    return dealt.select("a", "b").transform(map_batches, run, "node bigint, label bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node it is connected with) of every node of edges (a, b).

    Edges are dealt to tasks of about TASK_EDGES each, which leave at most one edge a node.  Where one task doesn't hold them
    all, alternating large and small stars follow.  Their joins are on nodes; the least neighbour of each node is stored first,
    so that a node with very many neighbours meets one row, which is broadcast or split for by the adaptive skew join."""
    current, path = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tasks = -(-current.count() // TASK_EDGES)
    labels, labels_path = stored(_contracted(current, max(1, tasks)), "labels")
    drop(path)
    if tasks <= 1:
        return labels
    current, path = stored(labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).distinct(), "edges")
    drop(labels_path)
    state = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_path = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = lookup_join(both, least, ["a"], "inner").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large, large_path = stored(large, "large")
        nearest, nearest_path = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = lookup_join(large, nearest, ["a"], "inner")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(nearest.select("a", F.col("m").alias("b"))).distinct()
        following, following_path = stored(small, "edges")
        for old in (large_path, path, least_path, nearest_path):
            drop(old)
        current, path = following, following_path
        now = tuple(current.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("b", "a", "a")), F.lit(0))).first())
        if now == state or not now[0]:
            break
        state = now
    release(edges.sparkSession)
    return current.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


class Cluster:
    """Exact join of the sets of one cluster, or of two blocks of it.

    Each token that two sets share has a list of postings (set, place of the token in it) by size of the set and place, in
    blocks of BLOCK postings with the least and the greatest size, the greatest place and the most tokens that follow it.  A
    probe reads the lists of its rarest tokens and skips every block whose bounds rule out enough overlap.  It keeps more than
    its own answers: all sets whose overlap with it is within reach of a set that differs from it by at most ``slack`` tokens.  Such a set needs no probe: its
    overlaps are those of the probed one, less the tokens that it lacks and more those that it adds.
    """

    BLOCK, BASES = 32, 8

    def __init__(self, t: Fraction):
        self.t = t
        self.probed = self.derived = self.skipped = self.read = 0

    def slack(self, size: int) -> int:
        return int((1 - self.t) * size) // 2 + 1

    def reach(self, size: int) -> int:
        """Least overlap with a probed set that matters to it or to any set within slack of it."""
        least = size - self.slack(size)
        return max(1, -((-self.t.numerator * least) // self.t.denominator) - self.slack(size))

    def _build(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets])
        unique, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        by_rarity = np.empty(len(unique), np.int64)
        by_rarity[np.lexsort((unique, count))] = np.arange(len(unique))
        self.sets = [np.sort(r) for r in np.split(by_rarity[rank], np.cumsum(self.size)[:-1])]
        self.tokens = np.concatenate(self.sets)
        self.first = np.cumsum(self.size) - self.size
        owner = np.repeat(np.arange(len(sets)), self.size)
        place = np.arange(len(self.tokens)) - np.repeat(self.first, self.size)
        self.alone = int((count == 1).sum())  # the rarest ones are in one set alone
        shared = np.flatnonzero(self.tokens >= self.alone)
        order = shared[np.lexsort((place[shared], self.size[owner[shared]], self.tokens[shared]))]
        self.owner, self.place = owner[order], place[order]
        self.begin = np.searchsorted(self.tokens[order], np.arange(len(unique) + 1))
        blocks = -(-np.diff(self.begin) // self.BLOCK)
        self.block_begin = np.concatenate([[0], np.cumsum(blocks)])
        at = np.repeat(self.begin[:-1], blocks) + (np.arange(self.block_begin[-1]) - np.repeat(self.block_begin[:-1], blocks)) * self.BLOCK
        self.block_at = np.concatenate([at, [len(self.owner)]])
        if len(at):
            self.block_place = np.maximum.reduceat(self.place, at)
            self.block_rest = np.maximum.reduceat(self.size[self.owner] - self.place, at)
            self.block_least, self.block_most = np.minimum.reduceat(self.size[self.owner], at), np.maximum.reduceat(self.size[self.owner], at)

    @staticmethod
    def _runs(begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which run, where) of each place of runs that begin somewhere and have many places."""
        which = np.repeat(np.arange(len(begin)), many)
        return which, np.arange(len(which)) + np.repeat(begin - (np.cumsum(many) - many), many)

    def _probe(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, overlaps): all sets that share at least reach tokens with x."""
        self.probed += 1
        mine, n, least = self.sets[x], len(self.sets[x]), self.reach(len(self.sets[x]))
        most = (n + self.slack(n)) * self.t.denominator // self.t.numerator  # tokens of a set that matters
        prefix = mine[: n - least + 1]
        i, block = self._runs(self.block_begin[prefix], self.block_begin[prefix + 1] - self.block_begin[prefix])
        if not len(block):
            return np.array([x]), np.array([n])
        ok = (np.minimum(n - i, self.block_rest[block]) + np.minimum(i, self.block_place[block]) >= least) & (self.block_most[block] >= least) & (self.block_least[block] <= most)
        many = self.block_at[block + 1] - self.block_at[block]  # a list's last block ends where the next list begins
        self.skipped += int(many[~ok].sum())
        self.read += int(many[ok].sum())
        which, at = self._runs(self.block_at[block[ok]], many[ok])
        i, owner, place = i[ok][which], self.owner[at], self.place[at]
        fits = (np.minimum(n - i, self.size[owner] - place) + np.minimum(i, place) >= least) & (self.size[owner] <= most)
        found = np.unique(owner[fits])
        mark = self.mark(x)
        set_, at = self._runs(self.first[found], self.size[found])
        overlap = np.bincount(set_, weights=mark[self.tokens[at]], minlength=len(found)).astype(np.int64)
        return found[overlap >= least], overlap[overlap >= least]

    def mark(self, x: int) -> np.ndarray:
        out = np.zeros(len(self.begin) - 1, bool)
        out[self.sets[x]] = True
        return out

    def _among(self, tokens: np.ndarray) -> np.ndarray:
        """How many of some tokens each set has."""
        _, at = self._runs(self.begin[tokens], self.begin[tokens + 1] - self.begin[tokens])
        return np.bincount(self.owner[at], minlength=len(self.sets))

    def answers(self, sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(x, the sets that x is linked with, itself left out), for every x."""
        self._build(sets)
        m = len(sets)
        bases: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []  # (mark, set, sets within reach, their overlaps)
        # sets that share their rarest shared token come one after another
        head = [int(s[k]) if (k := int(np.searchsorted(s, self.alone))) < len(s) else -1 for s in self.sets]
        for x in np.lexsort((np.arange(m), self.size, head)).tolist():
            mine, n = self.sets[x], int(self.size[x])
            best = None
            for base in bases:
                common = int(base[0][mine].sum())
                apart = max(n - common, int(self.size[base[1]]) - common)
                if apart <= self.slack(int(self.size[base[1]])) and (best is None or apart < best[0]):
                    best = (apart, base, common)
            if best is None:
                found, overlap = self._probe(x)
                bases = [(self.mark(x), x, found, overlap), *bases[: self.BASES - 1]]
            else:
                self.derived += 1
                mark, y, found, overlap = best[1]
                own = self.mark(x)
                overlap = overlap + self._among(mine[~mark[mine]])[found] - self._among(self.sets[y][~own[self.sets[y]]])[found]
                overlap[found == y] = best[2]  # lists leave out tokens of one set alone
            links = found[(overlap >= least_overlap(self.size[found], n, self.t)) & (found != x)]
            yield x, links


def _exact(members: DataFrame, t: Fraction) -> DataFrame:
    """From rows (task, side, low, node, weight, tokens) dealt by task: kind 0 (a, b): links that connect what is connected;
    kind 1 (node, n): documents that a task finds linked with the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            side, low, nodes, weight = (np.array([r[i] for r in rows]) for i in range(4))
            root = list(range(len(rows)))
            edges, n_links = [], np.zeros(len(rows), np.int64)
            for x, links in Cluster(t).answers([np.frombuffer(r[4], np.uint64) for r in rows]):
                if side.any():
                    links = links[side[links] != side[x]]
                links = links[low[links] | low[x]]  # two of the upper class meet in the next window
                n_links[x] = weight[links].sum()
                for y in links.tolist():
                    a, b = x, y
                    while root[a] != a:
                        root[a] = a = root[root[a]]
                    while root[b] != b:
                        root[b] = b = root[root[b]]
                    if a != b:
                        edges.append((nodes[a], nodes[b]))
                        root[a] = b
            some = np.flatnonzero(n_links)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * len(edges) + [1] * len(some), pa.int32()), pa.array([int(a) for a, _ in edges] + nodes[some].tolist(), pa.int64()), pa.array([int(b) for _, b in edges] + n_links[some].tolist(), pa.int64())], ["kind", "a", "b"]
                )

        for batch in batches:
            for key, *row in zip(*(column(batch, c).to_pylist() for c in ("task", "side", "low", "node", "weight", "tokens")), strict=True):
                if key != task:
                    yield from flush()
                    rows = []
                task = key
                rows.append(row)
        yield from flush()

    return members.transform(map_batches, run, "kind int, a bigint, b bigint")


def _tasks(member: DataFrame, t: Fraction, block: int) -> DataFrame:
    """(task, side, low, node, weight, tokens): which sets meet, each two of them once.

    A cluster of at most ``block`` tokens is one task.  In a larger one, sets are put into classes of sizes, each 1/t times
    wider than the one before, so that linked sets are in one class or in neighbouring ones; a window is a class (low) with
    the next one, and windows of more than ``block`` tokens are cut into blocks, of which every two meet.
    """
    cols = ["node", "weight", "tokens"]
    small = member.filter(F.col("total") <= block).select(F.xxhash64("label").alias("task"), F.lit(0).alias("side"), F.lit(True).alias("low"), *cols)
    width = F.lit(math.log(t.denominator / t.numerator) * (1 + 1e-9))
    large = member.filter(F.col("total") > block).withColumn("class", F.floor(F.log((F.octet_length("tokens") / 8).cast("double")) / width).cast("int"))
    counts = large.groupBy("label", "class").agg(F.sum(F.octet_length("tokens") / 8).alias("n"))
    above = counts.select("label", (F.col("class") - 1).alias("class"), F.col("n").alias("n_above"))
    windows, _ = stored(counts.join(above, ["label", "class"], "left").select("label", F.col("class").alias("window"), F.ceil((F.col("n") + F.coalesce("n_above", F.lit(0))) / block).cast("int").alias("blocks")), "windows")
    seen = large.withColumn("window", F.explode(F.array(F.col("class"), F.col("class") - 1))).withColumn("low", F.col("class") == F.col("window"))
    seen = lookup_join(seen, windows, ["label", "window"], "inner").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = seen.select("label", "window", "own", "low", *cols, F.explode(pairs).alias("ij"))
    side = F.when(F.col("ij.i") == F.col("ij.j"), 0).when(F.col("own") == F.col("ij.i"), 1).otherwise(2)
    return small.unionByName(dealt.select(F.xxhash64("label", "window", "ij.i", "ij.j").alias("task"), side.alias("side"), "low", *cols))


def join(docs: DataFrame, threshold: Fraction = Fraction(8, 10), n: int = 5, block: int = 1 << 17, row: str | None = None, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to, itself included) and n_links (other rows that are
    linked with it) for every row.

    row: a column that tells all rows apart, if there is one already; block: tokens that a task holds at once, about;
    bits: of a set's node (marks tell sets of one node apart, whatever its bits)."""
    spark = docs.sparkSession
    t = Fraction(threshold)
    texts = numbered(docs, ["doc_id", "text"]) if row is None else docs.select("doc_id", "text", F.col(row).alias("_row"))
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_row").cast("long").alias("_row"), F.col("text").cast("string").alias("text"))
    letters = docs.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    # a word takes about eight characters, and a counter should hold few n-grams
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << int(letters // 32).bit_length()))
    ranks = spark.sparkContext.broadcast(_ranks(texts, n, counters))
    index, index_at = stored(_index(texts, n, t, ranks, bits), "index")
    ranks.destroy()
    release(spark)
    parts = ["doc_ids", "rows", "sizes", "nodes", "marks"]
    rows, _ = stored(index.select(F.explode(F.arrays_zip(*parts)).alias("x")).select(*[F.col(f"x.{p}").alias(c) for p, c in zip(parts, ["doc_id", "_row", "n_shingles", "node", "mark"], strict=True)]), "nodes")
    postings = index.select(F.explode(F.arrays_zip("tokens", "lists", "post_nodes", "post_sizes")).alias("x")).select(F.col("x.tokens").alias("token"), F.col("x.lists").alias("list"), F.col("x.post_sizes").alias("size"), F.col("x.post_nodes").alias("node"))
    postings = postings.repartition("token", "list").sortWithinPartitions("token", "list", "size", "node")
    listed, _ = stored(_list_links(postings, t), "lists")
    alike = listed.filter("kind = 2").select("a", "b").distinct()
    met, met_at = stored(alike.select(F.col("a").alias("node")).unionByName(alike.select(F.col("b").alias("node"))).distinct(), "met")
    every = index.select(F.explode(F.arrays_zip("set_nodes", "set_sizes", "sketches")).alias("x")).select(F.col("x.set_nodes").alias("node"), F.col("x.set_sizes").alias("size"), F.col("x.sketches").alias("sketch"))
    sketches, sketches_at = stored(lookup_join(every, met, ["node"], "inner").distinct(), "sketches")
    close, _ = stored(_near_pairs(alike, sketches, t), "close")
    for old in (index_at, met_at, sketches_at):
        drop(old)
    release(spark)
    # lists that were dealt out: their runs of sizes, few as they are, meet by token
    runs = listed.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node")).distinct()
    hubs, _ = stored(runs.groupBy("token").agg(F.min("node").alias("hub")), "hubs")
    near = listed.filter("kind = 0").select("a", "b").unionByName(close).unionByName(lookup_join(runs, hubs, ["token"], "inner").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    clusters = components(near)

    # a row for each different set: two sets of one node are told apart by their marks
    each = rows.filter("n_shingles > 0").groupBy("node", "mark").agg(F.min("doc_id").alias("doc_id"), F.min("_row").alias("_row"), F.count("*").alias("weight"), F.min("n_shingles").alias("n"))
    twice, _ = stored(each.groupBy("node").agg(F.min("mark").alias("_least"), F.count("*").alias("_marks")).filter("_marks > 1").select("node", "_least"), "twice")
    named = F.when(F.col("_least").isNull() | (F.col("mark") == F.col("_least")), F.col("node")).otherwise(F.xxhash64("node", "mark"))
    each, _ = stored(lookup_join(each, twice, ["node"]).withColumn("set", named).drop("_least"), "each")
    members, _ = stored(lookup_join(each, clusters, ["node"], "inner"), "members")
    totals, _ = stored(members.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).filter("sets > 1").drop("sets"), "totals")
    wanted, _ = stored(lookup_join(members, totals, ["label"], "inner").select("_row", F.col("set").alias("node"), "label", "weight", "total"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = token_sets(texts_of(batch), n)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("node", "label", "weight", "total")), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "label", "weight", "total", "tokens"])

    some = lookup_join(texts.select("_row", "text"), wanted, ["_row"], "inner").select("node", "label", "weight", "total", "text")
    member, _ = stored(some.transform(map_batches, sets, "node bigint, label bigint, weight bigint, total bigint, tokens binary"), "sets")
    links, _ = stored(_exact(_tasks(member, t, block).repartition("task").sortWithinPartitions("task"), t), "links")
    release(spark)
    linked = components(links.filter("kind = 0").select("a", "b"))
    others, _ = stored(links.filter("kind = 1").groupBy(F.col("a").alias("set")).agg(F.sum("b").alias("others")), "others")
    verdict = lookup_join(lookup_join(each, linked.select(F.col("node").alias("set"), "label"), ["set"]), others, ["set"])
    verdict, _ = stored(verdict.select("node", "mark", "doc_id", F.coalesce("label", "set").alias("label"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "verdict")
    least, _ = stored(verdict.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n"), "least")
    verdict = lookup_join(verdict, least, ["label"]).select("node", "mark", F.coalesce("component_id", "doc_id").alias("component_id"), "n_links")
    verdict, _ = stored(verdict, "verdicts")
    joined = lookup_join(rows, verdict, ["node", "mark"])
    empty = F.col("n_shingles") == 0
    return joined.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))
