"""The prefix trie against a brute-force trie."""

import hashlib
import math
import random
import re
import zlib

import pytest

from graphspan.llm import trie
from tests.llm.test_operators import rows_of

rng = random.Random(4)
SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, every=20, most=4):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        made[c] = convs.get(c - int(math.fmod(c, every)), [])[:h] + own[h:]
    if not made:
        return []
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = lambda p, q: q[: len(p)] == p
    saved = {p: (len(m) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0 for p, m in members.items()}
    kids = {p: sum(len(q) == len(p) + 1 and below(p, q) for q in members) for p in members}
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(made[c]) == len(p)))
        sub = [q for q in members if below(p, q)]
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in sub), sum(saved[q] for q in sub), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **how):
    table = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA)
    return rows_of(trie.prefix_trie(table, **how), *COLUMNS)


def test_awkward_rows(spark):
    rows = [
        (0, 0, "user", "a b"), (0, 1, "assistant", "c"), (0, 1, "assistant", "c"), (0, 1, None, "c"), (1, None, "user", "a b"), (1, 0, "assistant", None), (2, 3, "user", ""), (3, 0, "user", "a b"), (3, 1, "assistant", "c"), (4, 0, None, None),
        (None, 0, "user", "lost"), (5, 0, "user", "x" * 200_000), (5, 0, "user", "x" * 200_000), (25, 0, "only", "one"), (44, 0, "u", "a b"), (45, 0, "u", "a\x00b"), (46, None, "u\x00", "b"), (46, None, "u", "\x00b"), (20, 0, "user", "a b"), (-3, 0, "user", "a b"),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(7, 0, "user", "one two")]) == brute([(7, 0, "user", "one two")])


def test_many_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, t, rng.choice(("user", "assistant")), rng.choice(("hi", "hi there", "go on", ""))) for c in range(0, 150, rng.choice((1, 2))) for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(7)]  # a hot conversation
    rows += [(400, t, "user", "long") for t in range(300)] + [(401, t, "user", "long") for t in range(12)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, every=1, most=1) == brute(rows, 1, 1)


@pytest.mark.parametrize("piece", [1, 4])
def test_ends_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(trie, "PIECE", piece)
    ends = [(d, n, c) for d in (1, 2) for n in (0, 5) for c in rng.sample(range(1000), 40)]
    got = rows_of(trie.ends_digests(spark.createDataFrame(ends, "depth long, node long, conv_id long")), "depth", "node", "ends_sha256")
    assert got == sorted(((d, n, hashlib.sha256(",".join(str(c) for c in sorted(c for a, b, c in ends if (a, b) == (d, n))).encode()).hexdigest()) for d in (1, 2) for n in (0, 5)), key=repr)
