"""Language ID by Bayesian evidence fusion.

Per row: log likelihoods of the whole text under byte-trigram models, the declared markup language and the address suffix.
Per host: expected language counts from those rows alone, summed by grouped aggregation and smoothed hierarchically: a host
leans on its domain, a domain on all rows, the less the more rows it has.  The posterior fuses all of them.

Trigram models are fitted on a bounded sample of labelled rows (``train_rows``); everything else covers all rows.

Defined cases: null or empty texts give no text evidence; a row without any letter is rejected as ``und`` whatever its host
says; null hosts and addresses give the host ""; an unknown declared language is no evidence; of languages with equal
posteriors the first by name is taken; rows are judged each by itself, repeated ones alike; a very long text is counted whole;
an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, lookup_join, map_batches, slices, stored, texts_of

BUCKETS = 1 << 16
# Languages of address suffixes.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}

# Letters of ASCII in lower case and all bytes of other characters; the rest parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLANKS = re.compile(rb" {2,}")
_HIDDEN = re.compile(r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def page_text(page: str) -> str:
    """What a page shows, without markup, scripts, styles and navigation."""
    return html.unescape(_HIDDEN.sub(" ", page))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts, and how many of them belong to each."""
    parts = [_BLANKS.sub(b" ", b" " + t.encode("utf-8", "surrogatepass").translate(_FOLD) + b" ") for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    b = np.frombuffer(b"".join(parts) + b"  ", np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    h = (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)
    n = np.maximum(size - 2, 0)
    ends = np.cumsum(size)
    keep = np.ones(len(h), bool)  # not those that run into the next text
    keep[np.concatenate([ends - 1, np.maximum(ends - 2, 0)])] = False
    return h[: int(size.sum())][keep[: int(size.sum())]], n


class Model:
    """Naive Bayes over hashed byte trigrams; scores: languages x buckets."""

    def __init__(self, languages: list[str], scores: np.ndarray):
        self.languages, self.scores = languages, scores

    @classmethod
    def fit(cls, texts: list[str], languages: list[str]) -> Model:
        names = sorted(set(languages))
        counts = np.full((BUCKETS, max(1, len(names))), 0.05, np.float64)
        for k, name in enumerate(names):
            grams, _ = trigrams([t for t, x in zip(texts, languages, strict=True) if x == name])
            counts[:, k] += np.bincount(grams, minlength=BUCKETS)
        return cls(names, np.ascontiguousarray((np.log(counts) - np.log(counts.sum(axis=0))).T, np.float32))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihoods a text and language, trigrams with a letter in them)."""
        grams, n = trigrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(n > 0)
        if len(some):
            begin = (np.cumsum(n) - n)[some]
            for k in range(len(self.languages)):
                out[some, k] = np.add.reduceat(self.scores[k][grams], begin, dtype=np.float64)
        return out, n


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; rows of fold 0 are held out of training."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def sample(labelled: DataFrame, key: str, rows: int) -> DataFrame:
    """About so many rows, by a hash of the key; all of them where there are no more."""
    n = labelled.count()
    return labelled if n <= rows else labelled.filter(F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def train(documents: DataFrame, train_rows: int = 4000, train_bytes: int = 32 << 20) -> Model:
    """Trigram models of every label from whole texts of labelled documents outside fold 0.

    The sample is stratified: labels share train_rows and train_bytes equally (a label has one row at least), so a rare language
    is there with all its documents.  Rows are chosen by a hash of doc_id and text."""
    usable = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min(F.xxhash64("doc_id", "text")).alias("first")).collect()  # a row for each label
    share = lambda r: min(1.0, train_rows / len(sizes) / r["n"], train_bytes / len(sizes) / max(1, r["size"]))
    shares = documents.sparkSession.createDataFrame([(r["lang"], int(share(r) * (1 << 30)), r["first"]) for r in sizes], "lang string, _share long, _first long")
    chosen = usable.withColumn("_hash", F.xxhash64("doc_id", "text")).join(F.broadcast(shares), "lang").filter("pmod(_hash, 1 << 30) < _share OR _hash = _first")
    seen = {}  # equal rows have one hash and come together: one of them is enough
    for r in chosen.select("_hash", "doc_id", "lang", "text").dropDuplicates(["_hash", "lang"]).collect():
        seen[r["lang"], r["_hash"]] = r["text"]
    rows = sorted((lang, h, text) for (lang, h), text in seen.items())
    return Model.fit([text for _, _, text in rows], [lang for lang, _, _ in rows])


def evidence(rows: DataFrame, model: Model, weight: float = 0.25, declared_trust: float = 0.9, suffix_trust: float = 0.7) -> DataFrame:
    """Adds to key columns of rows (id, host, domain, declared, suffix, text, is_page): n_grams and evidence, an array of log
    likelihoods.  Text counts with ``weight``, as neighbouring trigrams aren't independent."""
    names, known = model.languages, {x: k for k, x in enumerate(model.languages)}

    def bonus(values: list, trust: float) -> np.ndarray:
        out = np.zeros((len(values), len(names)))
        for i, v in enumerate(values):
            if v in known:
                out[i] = np.log((1 - trust) / max(1, len(names) - 1) + 1e-9)
                out[i, known[v]] = np.log(trust)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            pages = column(batch, "is_page").to_pylist()
            texts = [page_text(t) if p else t for t, p in zip(texts_of(batch), pages, strict=True)]
            score, n = model.score(texts)
            score = score * weight + bonus(column(batch, "declared").to_pylist(), declared_trust) + bonus([SUFFIX_LANGUAGE.get(x) for x in column(batch, "suffix").to_pylist()], suffix_trust)
            score -= score.max(axis=1, keepdims=True) if score.shape[1] else 0
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(score) + 1) * score.shape[1], pa.int32()), pa.array(score.ravel()))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "is_page"), column(batch, "id"), column(batch, "host"), column(batch, "domain"), pa.array(n), each],
                ["is_page", "id", "host", "domain", "n_grams", "evidence"],
            )

    wanted = rows.select("is_page", "id", "host", "domain", "declared", "suffix", "text")
    return wanted.transform(map_batches, run, "is_page boolean, id bigint, host string, domain string, n_grams bigint, evidence array<double>")


def _softmax(logs: Column) -> Column:
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def host_priors(seen: DataFrame, languages: int, host_weight: float = 20.0, domain_weight: float = 50.0) -> DataFrame:
    """host, domain and prior (an array): expected counts of a host's rows, smoothed by its domain's, and these by all rows'.
    Rows are added up before they are shuffled, so a host with a third of all rows is a few rows to its task."""
    names = [f"c{k}" for k in range(languages)]
    soft = seen.filter("n_grams > 0").select("host", "domain", _softmax(F.col("evidence")).alias("p")).select("host", "domain", *[F.col("p")[k].alias(n) for k, n in enumerate(names)])
    sums = lambda prefix="": [F.sum(n).alias(prefix + n) for n in names]
    hosts, _ = stored(soft.groupBy("host", "domain").agg(*sums()), "hosts")
    overall = hosts.agg(*sums()).first()
    every = np.array([(overall[n] or 0.0) + 1.0 for n in names])
    every = every / every.sum()
    total = lambda cols: sum((F.col(c) for c in cols), F.lit(0.0))
    domains = hosts.groupBy("domain").agg(*sums("d_"))
    d_names = ["d_" + n for n in names]
    domains = domains.select("domain", *[((F.col(c) + domain_weight * float(every[k])) / (total(d_names) + domain_weight)).alias(c) for k, c in enumerate(d_names)])
    joined = lookup_join(hosts, domains, ["domain"], "inner")
    return joined.select("host", "domain", F.array(*[(F.col(c) + host_weight * F.col(d)) / (total(names) + host_weight) for c, d in zip(names, d_names, strict=True)]).alias("prior"))


def identify(rows: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """is_page, id, lang, confidence, text_lang, n_grams, rejected.

    rows: is_page, id, host, domain, declared, suffix, text.  Rejected (lang ``und``) are rows without letters and those whose
    best posterior is below ``least``.
    """
    seen, _ = stored(evidence(rows, model), "evidence")
    k = len(model.languages)
    names = F.array(*[F.lit(x) for x in model.languages]) if k else F.array().cast("array<string>")
    if k:
        priors, _ = stored(host_priors(seen, k), "priors")
        fused = lookup_join(seen, priors, ["host", "domain"])
    else:  # nothing was learned: no languages to choose from
        fused = seen.withColumn("prior", F.lit(None).cast("array<double>"))
    logs = F.when(F.col("prior").isNull(), F.col("evidence")).otherwise(F.zip_with("evidence", F.coalesce("prior", F.transform("evidence", lambda x: F.lit(1.0))), lambda e, p: e + F.log(p)))
    fused = fused.withColumn("posterior", _softmax(logs))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    confidence = F.coalesce(F.array_max("posterior"), F.lit(0.0))
    out = (F.col("n_grams") == 0) | (confidence < least) | F.lit(k == 0)
    return fused.select(
        "is_page", "id", F.when(out, "und").otherwise(best(F.col("posterior"))).alias("lang"), confidence.alias("confidence"),
        F.when((F.col("n_grams") > 0) & F.lit(k > 0), best(F.col("evidence"))).alias("text_lang"), "n_grams", out.alias("rejected"),
    )


def document_rows(documents: DataFrame) -> DataFrame:
    """Documents know a source, which serves as host; they declare nothing."""
    none = F.lit(None).cast("string")
    return documents.select(F.lit(False).alias("is_page"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.lit("documents").alias("domain"), none.alias("declared"), none.alias("suffix"), F.col("text").cast("string").alias("text"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages declare a language in their markup; host, domain and suffix come from the address."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    declared = F.lower(F.substring(F.regexp_extract("html", r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2})", 1), 1, 2))
    return pages.select(F.lit(True).alias("is_page"), F.col("page_id").cast("long").alias("id"), host.alias("host"), F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1).alias("domain"), declared.alias("declared"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"), F.col("html").cast("string").alias("text"))
