"""Secret scans by corpus-wide ownership frequency.

Every whole text is scanned for base secrets (three fixed patterns) and for generic candidates (long mixed tokens of high
entropy).  A candidate's value is known by its hash alone from then on; hashes are aggregated by distinct owners and
repositories.  A value that many owners have is a widely copied example; one that a single owner has and that looks random is
live.  Live generic candidates become spans of kind ``owned`` beside the base spans, which always stay.

Defined cases: null or empty texts have no candidates; null owners and repositories count as one owner or repository "";
rows with equal doc_id are scanned each by itself; a very long text is scanned whole, in a slice of its own; candidates of one
kind never overlap, and of equal starts the kinds have a stated order, so ties have one answer; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, lookup_join, map_batches, numbered, slices, stored, texts_of

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "owned")

_LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so these are the matches of HEX that are long enough
_GENERIC = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

FOUND = "rid bigint, doc_id bigint, owner string, repository string, spans array<struct<kind:int,begin:int,end:int,value:binary,random:boolean>>"

SPANS = "array<struct<kind:int,begin:int,end:int,random:boolean,n_uses:bigint,n_owners:bigint,n_repositories:bigint,status:string>>"


def digest(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) of the base patterns, ordered by start and kind."""
    out = []
    low = text.lower()  # finds more than ASCII letters do, never less
    if any(h in low for h in _HINTS):
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(2, m.start(), m.end(), m[0]) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def looks_random(value: str, bits: float = 3.5) -> bool:
    """Digits beside letters and at least so many bits a character; not what a placeholder looks like."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return entropy >= min(bits, 0.8 * math.log2(n)) and not re.search(r"example|sample|dummy|changeme|your|xxxx|0000|1234", value, re.IGNORECASE)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """Base spans and generic ones (kind 3) that don't meet them."""
    base = base_spans(text)
    taken, out = [(b, e) for _, b, e, _ in base], list(base)
    for m in _GENERIC.finditer(text):
        if looks_random(m[0]) and not any(b < m.end() and m.start() < e for b, e in taken):
            out.append((3, m.start(), m.end(), m[0]))
    return sorted(out, key=lambda s: (s[1], s[0]))


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """FOUND rows, one for each document; rid tells rows apart; values are hashed at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        kinds = pa.list_(pa.struct([("kind", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("random", pa.bool_())]))
        for batch in slices(batches):
            spans = [
                [{"kind": k, "begin": b, "end": e, "value": digest(v), "random": looks_random(v)} for k, b, e, v in candidates(t)]
                for t in texts_of(batch)
            ]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + n), pa.int64()), column(batch, "doc_id"), column(batch, "owner"), column(batch, "repository"), pa.array(spans, kinds)], ["rid", "doc_id", "owner", "repository", "spans"])
            rid += n

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.col("text").cast("string").alias("text"))
    return named.transform(map_batches, run, FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """value, n_uses, n_owners, n_repositories: how widely each candidate is spread.

    A value's rows are counted for each owner and repository before they meet, so a value that a third of all rows hold
    comes to its task as a few rows.
    """
    uses = found.select("owner", "repository", F.explode("spans").alias("s")).select("owner", "repository", F.col("s.value").alias("value"))
    by_place = uses.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_place.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("places"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_uses"), F.count("*").alias("n_owners"), F.sum("places").alias("n_repositories"))


def find(docs: DataFrame, owner: Column, repository: Column, common_owners: int = 3) -> DataFrame:
    """doc_id and spans: array<struct<kind, begin, end, random, n_uses, n_owners, n_repositories, status>> by start and kind.

    status: ``example`` (at least common_owners owners), ``live`` (one owner, looks random), else ``shared``.
    Generic candidates that aren't live are left out.
    """
    found, _ = stored(scan(docs, owner, repository), "candidates")
    spread, _ = stored(ownership(found), "ownership")
    each = found.select("rid", F.posexplode("spans").alias("i", "s")).select("rid", "i", "s.*")
    status = F.when(F.col("n_owners") >= common_owners, "example").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("shared")
    judged = lookup_join(each, spread, ["value"], "inner").withColumn("status", status).filter((F.col("kind") < 3) | (F.col("status") == "live"))
    names = ["kind", "begin", "end", "random", "n_uses", "n_owners", "n_repositories", "status"]
    by_row = judged.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("i", *names))).alias("spans"))
    whole = found.select("rid", "doc_id").join(by_row, "rid", "left")
    return whole.select("doc_id", F.coalesce(F.transform("spans", lambda s: F.struct(*[s[k].alias(k) for k in names])), F.array().cast(SPANS)).alias("spans"))


def summary(result: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text), n_live, n_example."""
    def named(s: Column) -> Column:
        names = F.when(s["kind"] == 0, KINDS[0]).when(s["kind"] == 1, KINDS[1]).when(s["kind"] == 2, KINDS[2]).otherwise(KINDS[3])
        return F.concat_ws(":", names, s["begin"].cast("string"), s["end"].cast("string"))

    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return result.select(
        "doc_id", count(lambda s: s["kind"] == 0).alias("n_assign"), count(lambda s: s["kind"] == 1).alias("n_access"), count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] < 3), named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", named), ",").alias("spans"),
        count(lambda s: s["status"] == "live").alias("n_live"), count(lambda s: s["status"] == "example").alias("n_example"),
    )


def mask(docs: DataFrame, owner: Column, repository: Column, common_owners: int = 3) -> DataFrame:
    """docs with secrets replaced by ``[kind]`` in text: base spans but those of widely copied examples, and live ones.

    Only values are judged across the corpus; texts stay where they are and are rewritten in a second scan, which looks up
    what was found by the value's hash.  Null texts stay null; all columns stay; rows without a doc_id, or with one that others
    have too, are masked each by itself.
    """
    columns = docs.columns
    row, held = free_name(columns, "_row"), free_name(columns, "_values")
    docs = numbered(docs, name=row)
    by_row = docs.select(F.col(row).alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), "text")
    found, _ = stored(scan(by_row, F.col("owner"), F.col("repository")), "candidates")
    spread, _ = stored(ownership(found), "ownership")
    each = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    example = F.col("n_owners") >= common_owners
    live = (F.col("n_owners") == 1) & F.col("random")
    judged = lookup_join(each, spread, ["value"], "inner").filter(F.when(F.col("kind") < 3, ~example).otherwise(live))
    hidden, _ = stored(judged.groupBy(F.col("doc_id").alias(row)).agg(F.collect_set("value").alias(held)), "hidden")

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, values, strict=True):
            if text is None or some is None or not len(some):
                out.append(text)
                continue
            hide, parts, at = {bytes(v) for v in some}, [], 0
            for k, b, e, v in candidates(text):
                if b >= at and digest(v) in hide:
                    parts += [text[at:b], f"[{KINDS[k]}]"]
                    at = e
            out.append("".join(parts) + text[at:])
        return pd.Series(out)

    joined = lookup_join(docs, hidden, [row])
    return joined.select(*[F.when(F.col(held).isNotNull(), rewrite("text", held)).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in columns])
