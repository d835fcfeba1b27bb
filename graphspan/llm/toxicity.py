"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

Every whole text is cut into overlapping windows of words; the network scores each window and the highest decides about the
document.  A word enters as a learned vector (of words known from training) beside the mean of learned vectors of its character
trigrams; both go through a forward and a backward GRU; attention weighs the states into one.

Training is weakly supervised: a label holds for a whole document, so each epoch learns from the windows that score highest
in it.  Labels are read only outside fold 0, from at most about ``train_rows`` documents of each class; probabilities are fitted
with each class weighing what all its labelled rows outside fold 0 do, so that they don't move with that bound; scoring covers
all rows.

Defined cases: null or empty texts have no window and get the share of toxic labels outside fold 0, 0.49 at most; a table
without usable labels scores everything 0; an empty table gives no rows; rows with equal doc_id are scored each by itself;
several labels of one doc_id count as their greatest; equal texts get equal scores in a batch, and scores that agree to about
1e-6 in different ones (sums of 32-bit floats); windows of equal scores are one answer; a very long text is all its windows;
other columns, labels among them, are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, slices, texts_of
from .langid import fold, sample
from .wordhash import Words

WINDOW, STRIDE = 32, 16
WORD_DIM = CHAR_DIM = 8
HIDDEN = 8
KNOWN_WORDS = 4096
CHAR_BUCKETS = 4096
#: The highest score of a text without words: it says nothing, whatever most labels are.
HIGHEST_EMPTY = 0.49

#: Letters and digits of ASCII in lower case and all bytes of other characters make words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Texts:
    """Distinct words of some texts, each text as their numbers, and the character trigrams of each distinct word."""

    def __init__(self, texts: list[str]):
        w = Words([t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts])
        self.n, self.first = w.n, w.first
        self.prints, at, self.word = np.unique(w.fingerprints(), return_index=True, return_inverse=True)
        begin, end = w.begin[at], w.end[at]
        self.grams = end - begin  # a trigram for each byte, with its neighbours or the blanks around the word
        place = np.arange(int(self.grams.sum())) - np.repeat(np.cumsum(self.grams) - self.grams, self.grams) + np.repeat(begin, self.grams)
        b = np.concatenate([[np.uint8(32)], w.bytes, [np.uint8(32)]]).astype(np.uint32)
        b[b == 10] = 32
        h = b[place] * np.uint32(0x9E3779B1) ^ b[place + 1] * np.uint32(0x85EBCA6B) ^ b[place + 2] * np.uint32(0xC2B2AE35)
        self.buckets = ((h ^ h >> np.uint32(15)) % np.uint32(CHAR_BUCKETS)).astype(np.int64)
        self.bucket_word = np.repeat(np.arange(len(at)), self.grams)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, first word) of windows that overlap by half and cover every word; the last ends with the text."""
        many = np.where(self.n > 0, 1 + np.maximum(0, -(-(self.n - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(self.n)), many)
        k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        return text, self.first[text] + np.minimum(k * STRIDE, np.maximum(self.n[text] - WINDOW, 0))

    def words_of(self, text: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Numbers of distinct words of windows, -1 beyond a text's end."""
        at = start[:, None] + np.arange(WINDOW)
        inside = at < (self.first + self.n)[text][:, None]
        return np.where(inside, self.word[np.minimum(at, len(self.word) - 1)], -1)


class Network:
    """Parameters p and what they give."""

    def __init__(self, seed: int = 7):
        r, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM
        self.known = np.zeros(0, np.uint64)
        self.empty, self.scale, self.shift = 0.0, 1.0, 0.0
        self.p = {"word": r.normal(0, 0.1, (KNOWN_WORDS + 1, WORD_DIM)), "char": r.normal(0, 0.1, (CHAR_BUCKETS, CHAR_DIM))}
        for way in ("f", "b"):
            self.p |= {f"W{way}": r.normal(0, d**-0.5, (d, 3 * HIDDEN)), f"U{way}": r.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"c{way}": np.zeros(3 * HIDDEN)}
        self.p |= {"A": r.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "a": r.normal(0, 0.3, HIDDEN), "w": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def rows_of(self, prints: np.ndarray) -> np.ndarray:
        """Rows of the word table; the last is for words not known."""
        if not len(self.known):
            return np.full(len(prints), KNOWN_WORDS)
        at = np.minimum(np.searchsorted(self.known, prints), len(self.known) - 1)
        return np.where(self.known[at] == prints, at, KNOWN_WORDS)

    def inputs(self, t: Texts) -> np.ndarray:
        """A vector for each distinct word."""
        if not len(t.prints):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        begin = np.cumsum(t.grams) - t.grams
        chars = np.add.reduceat(self.p["char"][t.buckets], begin, axis=0) / t.grams[:, None]
        return np.concatenate([self.p["word"][self.rows_of(t.prints)], chars], axis=1).astype(np.float32)

    def _way(self, way: str, projected: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of a direction, steps first.  projected: steps x windows x 3 HIDDEN."""
        steps, n, _ = projected.shape
        h, out, u, k = np.zeros((n, HIDDEN), np.float32), np.zeros((steps, n, HIDDEN), np.float32), self.p[f"U{way}"], HIDDEN
        for s in range(steps) if way == "f" else reversed(range(steps)):
            x, g = projected[s], h @ u
            zr = 1 / (1 + np.exp(-(x[:, : 2 * k] + g[:, : 2 * k])))
            z, r = zr[:, :k], zr[:, k:]
            cand = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
            m = mask[s][:, None]
            new = h + m * (1 - z) * (cand - h)
            if keep is not None:
                keep.append((s, h, z, r, cand, g[:, 2 * k :], m))
            out[s] = h = new
        return out

    def forward(self, projected: dict[str, np.ndarray], words: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows.  projected: for each direction, distinct words x 3 HIDDEN, with a last row for padding."""
        mask = (words.T >= 0).astype(np.float32)
        held = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        h = np.concatenate([self._way(way, projected[way][words.T], mask, held[way]) for way in ("f", "b")], axis=2)
        t = np.tanh(h @ self.p["A"])
        e = t @ self.p["a"] + (mask - 1) * 1e4
        e = np.exp(e - e.max(axis=0))
        attention = e / e.sum(axis=0)
        pooled = (attention[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"mask": mask, "h": h, "t": t, "attention": attention, "pooled": pooled, "held": held}
        return pooled @ self.p["w"] + self.p["bias"]

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: np.concatenate([x @ self.p[f"W{way}"] + self.p[f"c{way}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for way in ("f", "b")}

    def gradients(self, t: Texts, x: np.ndarray, words: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss over windows."""
        keep: dict = {}
        logit = self.forward(self.project(x), words, keep)
        d = ((_sigmoid(logit) - label) * weight / max(1e-9, weight.sum())).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        h, att, tt = keep["h"], keep["attention"], keep["t"]
        g["w"], g["bias"] = keep["pooled"].T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * self.p["w"]
        dh = att[:, :, None] * dpool
        datt = (h * dpool).sum(axis=2)
        de = att * (datt - (att * datt).sum(axis=0))
        g["a"] = np.einsum("sn,snk->k", de, tt)
        dt = de[:, :, None] * self.p["a"] * (1 - tt * tt)
        g["A"] = np.einsum("snj,snk->jk", h, dt)
        dh = dh + dt @ self.p["A"].T
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        k = HIDDEN
        for way, part in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            u, later = self.p[f"U{way}"], np.zeros((words.shape[0], k), np.float32)
            padded = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
            for s, before, z, r, cand, gn, m in reversed(keep["held"][way]):
                new = dh[s][:, part] + later
                dz = new * m * (before - cand) * z * (1 - z)
                dc = new * m * (1 - z) * (1 - cand * cand)
                dr = dc * gn * r * (1 - r)
                dxs = np.concatenate([dz, dr, dc], axis=1)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                later = new * (1 - m * (1 - z)) + dg @ u.T
                g[f"U{way}"] += before.T @ dg
                here = words[:, s]
                g[f"W{way}"] += padded[here].T @ dxs
                g[f"c{way}"] += dxs.sum(axis=0)
                np.add.at(dx, here, dxs @ self.p[f"W{way}"].T)
        dx = dx[:-1]
        np.add.at(g["word"], self.rows_of(t.prints), dx[:, :WORD_DIM])
        np.add.at(g["char"], t.buckets, (dx[:, WORD_DIM:] / t.grams[:, None])[t.bucket_word])
        return g

    def window_logits(self, t: Texts, text: np.ndarray, start: np.ndarray, chunk: int = 4096) -> np.ndarray:
        projected = self.project(self.inputs(t))
        out = [self.forward(projected, t.words_of(text[i : i + chunk], start[i : i + chunk])) for i in range(0, len(text), chunk)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def document_logits(self, texts: list[str]) -> np.ndarray:
        """The highest of each text's windows; -inf for texts without words."""
        t = Texts(texts)
        out = np.full(len(texts), -np.inf)
        text, start = t.windows()
        if len(text):
            np.maximum.at(out, text, self.window_logits(t, text, start).astype(np.float64))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        logit = self.document_logits(texts)
        return np.where(np.isfinite(logit), _sigmoid(self.scale * np.where(np.isfinite(logit), logit, 0) + self.shift), self.empty)


def fit(texts: list[str], labels: list[int], epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 7, informed: bool = True, counts: tuple[int, int] | None = None) -> Network:
    """Train on whole texts with one label each.  informed: a word's first dimension begins with its log odds, and the first
    epoch's windows are those of the most telling words; else all begins at random.  counts: how many rows labelled 0 and 1 there
    are in all, where these are but some of them: probabilities are those of the whole, whatever share of a class is given here."""
    net, y = Network(seed), np.array(labels, np.float32)
    clean_rows, toxic_rows = counts or (int((y == 0).sum()), int((y == 1).sum()))
    net.empty = min(toxic_rows / max(1, clean_rows + toxic_rows), HIGHEST_EMPTY)
    if len(y) == 0 or y.min() == y.max():
        net.scale, net.shift = 0.0, 30.0 if len(y) and y[0] else -30.0
        return net
    t, random = Texts(texts), np.random.default_rng(seed)
    # words known to the table: those in at least two documents, most telling first
    doc = np.repeat(np.arange(len(texts)), t.n)
    pairs = np.unique(np.stack([t.word, doc]), axis=1)
    with_word = np.bincount(pairs[0], minlength=len(t.prints))
    toxic = np.bincount(pairs[0], weights=y[pairs[1]], minlength=len(t.prints))
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((with_word - toxic + 0.5) / (len(y) - y.sum() + 1))
    worth = np.abs(odds) * np.sqrt(with_word) * (with_word >= 2)
    best = np.sort(np.argsort(-worth, kind="stable")[:KNOWN_WORDS])
    net.known = t.prints[best]
    if informed:
        net.p["word"][: len(best), 0] = odds[best] / 3
    text, start = t.windows()
    window_words = t.words_of(text, start)
    guess = np.where(window_words >= 0, np.maximum(odds[window_words], 0) * (with_word[window_words] >= 2), 0).max(axis=1) if informed else random.random(len(text))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps = 0
    for _ in range(epochs):
        order = np.lexsort((-guess, text))
        chosen = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]  # the highest window of each text
        clean = np.flatnonzero(y[text] == 0)
        chosen = np.concatenate([chosen, random.choice(clean, min(len(clean), len(chosen)), replace=False)])
        random.shuffle(chosen)
        share = y[text[chosen]].mean()
        for i in range(0, len(chosen), batch):
            some = chosen[i : i + batch]
            words = window_words[some]
            used, local = np.unique(np.where(words >= 0, words, 0), return_inverse=True)
            part = _part(t, used)
            label = y[text[some]]
            weight = np.where(label > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
            grads = net.gradients(part, net.inputs(part), np.where(words >= 0, local.reshape(words.shape), -1), label, weight)
            steps += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
        guess = net.window_logits(t, text, start)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, text, guess.astype(np.float64))
    some = np.isfinite(top)
    of_each = np.where(y > 0, toxic_rows / y.sum(), clean_rows / (len(y) - y.sum()))
    net.scale, net.shift = _calibrate(top[some], y[some], of_each[some])
    return net


def _part(t: Texts, used: np.ndarray) -> Texts:
    """The same with the distinct words ``used`` alone."""
    part = object.__new__(Texts)
    part.prints, part.grams = t.prints[used], t.grams[used]
    ends = np.cumsum(part.grams)
    at = np.repeat((np.cumsum(t.grams) - t.grams)[used] - (ends - part.grams), part.grams) + np.arange(ends[-1] if len(ends) else 0)
    part.buckets, part.bucket_word = t.buckets[at], np.repeat(np.arange(len(used)), part.grams)
    return part


def _calibrate(logit: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic regression of the label on the document's logit, by Newton's steps with soft targets; a row stands for weight
    rows."""
    ones, zeros = (weight * y).sum(), (weight * (1 - y)).sum()
    soft = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(x @ b)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, x.T @ (weight * (p - soft)) + ridge * (b - np.array([1.0, 0.0]))), -2, 2)
    return float(max(b[0], 0.0)), float(b[1])


def train(documents: DataFrame, labels: DataFrame, train_rows: int = 1500, train_bytes: int = 64 << 20) -> Network:
    """From at most about train_rows labelled documents of each class outside fold 0, and about train_bytes; whole texts."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    chosen = sample(usable.filter("toxic = 1"), "doc_id", train_rows).unionByName(sample(usable.filter("toxic <> 1"), "doc_id", train_rows))
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("hash", F.xxhash64("doc_id", "text")).dropDuplicates(["hash"])  # chosen has about 2 train_rows rows at most
    size = found.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    share = min(1.0, 4 * train_rows / max(1, size["n"]), train_bytes / max(1, size["size"] or 0))  # a doc_id may have any number of rows
    rows = found.filter(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30))).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [int(r["toxic"] == 1) for r in rows], counts=(counts.get(False, 0), counts.get(True, 0)))


def score(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            texts = texts_of(batch)
            distinct = list(dict.fromkeys(texts))
            got = dict(zip(distinct, net.scores(distinct).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array([got[t] for t in texts], pa.float64())], ["doc_id", "held_out", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.transform(map_batches, run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
