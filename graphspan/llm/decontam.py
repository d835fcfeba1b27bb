"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores, for each block of documents, the word positions of every term in it (a document-partitioned index: a
block has all postings of its documents, so lists are intersected where they lie).  It knows nothing of any benchmark: built
once, it is searched for each one.  ``search`` starts each window from its rarest term over the whole corpus, shifts that list
by the term's place in the window and intersects it with the lists of the other terms, next rarest first; beside exact matches
it finds items whose rarest terms come near to each other.

Benchmark words are collected by passes of about ``pass_words`` words; a larger benchmark takes more passes over the index.

Defined cases: null or empty texts have no words; null item_id is named ""; items of equal id are one item; rows with equal
doc_id are judged each by itself; an empty benchmark gives clean documents; a very long text is a block by itself; terms of
equal frequency are taken in the order of the terms; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, slices, stored, texts_of

#: A-Z become a-z; 0-9, a-z and all bytes of other characters stay; the rest separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Occurrences looked at together.
OCCURRENCES = 1 << 19
#: Places left free between the documents of a block, so that no match runs from one into the next.
GAP = 256

INDEX = "block bigint, doc_ids array<bigint>, n_words array<int>, terms binary, counts array<int>, positions binary"
HITS = "block bigint, place int, doc_id bigint, n_words bigint, spans array<struct<item:string,begin:int,end:int>>, near array<string>"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """The windows of some items over a vocabulary of their terms."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        rows, self.items = {}, []
        for item, ws in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                rows.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.terms = np.array([r + (-1,) * (width - len(r)) for r in rows], np.int64).reshape(-1, width)
        self.items = [sorted(x) for x in rows.values()]
        by_name = sorted(self.vocabulary)
        self.name_rank = np.empty(len(by_name), np.int64)  # breaks ties between terms that are as rare
        self.name_rank[[self.vocabulary[w] for w in by_name]] = np.arange(len(by_name))


def build_index(docs: DataFrame) -> DataFrame:
    """INDEX rows, one for each block of about 2 MB of texts.  terms: the block's distinct words in the order of their bytes,
    each after a blank; positions: 32-bit differences, term after term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            lines = [b" ".join(t.encode("utf-8", "surrogatepass").translate(_FOLD).split()) for t in texts_of(batch)]
            n = np.fromiter((x.count(b" ") + 1 if x else 0 for x in lines), np.int64, len(lines))
            buffer = b"".join(b" " + x for x in lines if x)
            at = np.append(np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32), len(buffer))
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(buffer)]).dictionary_encode()
            terms = coded.dictionary.to_pylist()
            order = sorted(range(len(terms)), key=terms.__getitem__)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            ids = rank[coded.indices.to_numpy()]
            counts = np.bincount(ids, minlength=len(order))
            places = (np.arange(len(ids)) + np.repeat(np.arange(len(n)) * GAP, n))[np.argsort(ids, kind="stable")]
            deltas, first = np.diff(places, prepend=0), np.cumsum(counts) - counts
            deltas[first] = places[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([column(batch, "doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([n.astype(np.int32)], pa.list_(pa.int32())), pa.array([b"".join(terms[i] for i in order)], pa.binary()),
                 pa.array([counts.astype(np.int32)], pa.list_(pa.int32())), pa.array([deltas.astype("<u4").tobytes()], pa.binary())],
                ["block", "doc_ids", "n_words", "terms", "counts", "positions"],
            )
            block += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_batches, run, INDEX)


def _asked(terms: bytes, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number in the vocabulary, place in the block) of a block's terms that are asked for, by number."""
    own = terms.split()
    ids = np.fromiter((vocabulary.get(t, -1) for t in own), np.int64, len(own))
    at = np.flatnonzero(ids >= 0)
    at = at[np.argsort(ids[at], kind="stable")]
    return ids[at], at


def term_frequencies(index: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """term (its number), n: occurrences of each term of the vocabulary in all blocks, without reading positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(column(batch, "terms"), column(batch, "counts"), strict=True):
                ids, at = _asked(terms.as_py(), vocabulary)
                total[ids] += counts.values.to_numpy()[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    counted = index.select("terms", "counts").transform(map_batches, run, "term bigint, n bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def search(index: DataFrame, windows: Windows, frequency: dict[int, int], near_words: int = 0, near_terms: int = 4) -> DataFrame:
    """HITS rows for every document of the index.

    spans: where windows of an item occur, as words, merged where they touch.  near (if near_words): items of which a
    window's near_terms rarest terms occur within near_words of its rarest one, without an exact match.  Terms that no document
    has are passed over there, as a word that was replaced may be one; a window with fewer distinct terms than near_terms needs
    all of them.
    """
    if not 0 <= near_words < GAP:
        raise ValueError(f"near_words must be at least 0 and below {GAP}")
    df = np.array([frequency.get(t, 0) for t in range(len(windows.vocabulary))] + [1 << 60], np.int64)  # the last is "no term"
    possible = np.flatnonzero((df[windows.terms] > 0).all(axis=1)) if len(windows.size) else np.zeros(0, np.int64)
    vocabulary = windows.vocabulary
    terms, size = windows.terms[possible], windows.size[possible]
    items = [windows.items[i] for i in possible]
    rarest = np.argsort(df[terms], axis=1, kind="stable") if len(possible) else np.zeros((0, 1), np.int64)
    width = terms.shape[1] if len(possible) else 0
    close = _rarest(windows, df, near_terms) if near_words else np.zeros((0, near_terms), np.int64)
    near_of, close = np.flatnonzero(close[:, 0] >= 0), close[close[:, 0] >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: column(batch, name)[row]  # noqa: B023, E731
                has, at = _asked(get("terms").as_py(), vocabulary)
                counts = get("counts").values.to_numpy().astype(np.int64)
                begin, many = (np.cumsum(counts) - counts)[at], counts[at]
                upto = np.cumsum(many)
                deltas = np.frombuffer(get("positions").as_buffer(), "<u4")[np.arange(int(many.sum())) + np.repeat(begin - (upto - many), many)]
                yield from hits(get("block").as_py(), get("doc_ids").as_py(), get("n_words").values.to_numpy().astype(np.int64), has, many, deltas.astype(np.int64))

    def hits(block: int, doc_ids: list, n: np.ndarray, has: np.ndarray, counts: np.ndarray, deltas: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.cumsum(n + GAP) - n - GAP  # of documents
        spans: list[dict[str, list]] = [{} for _ in doc_ids]
        near: list[set] = [set() for _ in doc_ids]
        if len(has):
            ends = np.cumsum(counts)
            lists = np.cumsum(deltas)
            lists -= np.repeat(np.concatenate([[0], lists[ends[:-1] - 1]]), counts)  # each list begins anew
            span = int(lists.max()) + GAP + 1
            keys = np.repeat(has, counts) * span + lists  # ascending: the whole index as one list
            member = lambda k: keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k

            def occurrences(lead: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                """(which of lead, where) for every occurrence in this block, some leads at a time."""
                at = np.minimum(np.searchsorted(has, lead), len(has) - 1)
                here = np.flatnonzero(has[at] == lead)
                many, first = counts[at[here]], (ends - counts)[at[here]]
                group = (np.cumsum(many) - many) // OCCURRENCES
                for g in np.unique(group):
                    k = slice(*np.searchsorted(group, (g, g + 1)))
                    upto = np.cumsum(many[k])
                    which = np.repeat(here[k], many[k])
                    yield which, lists[np.arange(len(which)) + np.repeat(first[k] - (upto - many[k]), many[k])]

            for w, anchor in occurrences(terms[np.arange(len(terms)), rarest[:, 0]]) if len(possible) else ():
                begin = anchor - rarest[w, 0]
                for k in range(1, width):
                    if not len(w):
                        break
                    place = rarest[w, k]
                    term = terms[w, place]
                    ok = (begin >= 0) & ((term < 0) | member(term * span + begin + place))
                    w, begin = w[ok], begin[ok]
                ok = begin >= 0
                w, begin = w[ok], begin[ok]
                doc = np.searchsorted(starts, begin, side="right") - 1
                for i, d, b in zip(w.tolist(), doc.tolist(), (begin - starts[doc]).tolist(), strict=True):
                    for item in items[i]:
                        spans[d].setdefault(item, []).append((b, b + int(size[i])))
            for w, a in occurrences(close[:, 0]) if len(close) else ():
                for k in range(1, near_terms):
                    term = close[w, k]
                    low = np.searchsorted(keys, np.maximum(term, 0) * span + np.maximum(a - near_words, 0))
                    got = keys[np.minimum(low, len(keys) - 1)]
                    ok = (term < 0) | ((got >= term * span) & (got <= term * span + np.minimum(a + near_words, span - 1)) & (low < len(keys)))
                    w, a = w[ok], a[ok]
                doc = np.searchsorted(starts, a, side="right") - 1
                pairs = np.unique(near_of[w] * len(doc_ids) + doc)
                for i, d in zip((pairs // len(doc_ids)).tolist(), (pairs % len(doc_ids)).tolist(), strict=True):
                    near[d].update(windows.items[i])
            for d, x in enumerate(near):
                x.difference_update(spans[d])
        merged = [[{"item": item, "begin": b, "end": e} for item, s in sorted(x.items()) for b, e in merge(s)] for x in spans]
        kinds = [pa.field("item", pa.string()), pa.field("begin", pa.int32()), pa.field("end", pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * len(n)), pa.array(range(len(n)), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(n), pa.array(merged, pa.list_(pa.struct(kinds))), pa.array([sorted(x) for x in near], pa.list_(pa.string()))],
            ["block", "place", "doc_id", "n_words", "spans", "near"],
        )

    return index.transform(map_batches, run, HITS)


def _rarest(windows: Windows, df: np.ndarray, most: int) -> np.ndarray:
    """The rarest distinct terms of each window that any document has, rare ones first and then by name: ``most``, or all of a
    window with fewer (then -1 follows).  A window of which too few are left is -1 throughout."""
    out = np.full((len(windows.terms), most), -1, np.int64)
    for i, row in enumerate(windows.terms.tolist()):
        distinct = {t for t in row if t >= 0}
        there = sorted((t for t in distinct if df[t] > 0), key=lambda t: (df[t], windows.name_rank[t]))[:most]
        if len(there) == min(most, len(distinct)):
            out[i, : len(there)] = there
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, near_words: int = 0, pass_words: int = 250_000) -> DataFrame:
    """HITS for every document against all benchmark items."""
    index, _ = stored(build_index(docs), "postings")
    return find_in(index, benchmark, width, near_words, pass_words)


def find_in(index: DataFrame, benchmark: DataFrame, width: int = 10, near_words: int = 0, pass_words: int = 250_000) -> DataFrame:
    """HITS for every document of a stored index against all benchmark items."""
    asked = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a word takes two characters with what parts it from the next
    total = asked.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0] // 2
    passes, found = -(-(total + 1) // pass_words), []
    for k in range(passes):
        # items of equal id go to the same pass; at most pass_words words on average
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).collect()
        windows = Windows([(r["item"], words(r["text"])) for r in rows], width)
        frequency = {r["term"]: r["n"] for r in term_frequencies(index, windows.vocabulary).collect()}  # at most the words of the pass
        found.append(search(index, windows, frequency, near_words))
        if passes > 1:
            found[-1], _ = stored(found[-1], "hits")
    if passes == 1:
        return found[0]
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    return both.groupBy("block", "place", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("near")).alias("near"))


def summary(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; n_near and near_items: the items that a document comes near to
    without an exact match, as strings in their order, comma-joined."""
    begun = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    places = F.array_sort(F.transform("spans", lambda s: F.struct(s["begin"].cast("long").alias("begin"), s["end"].cast("long").alias("end"))))

    def add(done: Column, s: Column) -> Column:
        return F.when(s["end"] > done["upto"], F.struct(s["end"].alias("upto"), (done["n"] + s["end"] - F.greatest(s["begin"], done["upto"])).alias("n"))).otherwise(done)

    names = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    found = hits.select("doc_id", "n_words", F.aggregate(places, begun, add)["n"].alias("n_hit"), names.alias("names"), F.array_sort("near").alias("near"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"), F.array_join("near", ",").alias("near_items"),
    )
