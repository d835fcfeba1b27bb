"""SimHash against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from graphspan.llm import simhash
from tests.llm.test_operators import ROWS, docs, empty, rows_of  # noqa: F401

rng = random.Random(8)


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, distance):
    """rows: (doc_id, fingerprint)"""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((doc, f"{fp:016x}", least[find(i)]) for i, (doc, fp) in enumerate(rows)), key=repr)


def test_awkward_rows(docs, empty):  # noqa: F811
    expected = brute_components([(d, brute_fingerprint(t)) for d, t in ROWS], 4)
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("task_rows", [simhash.TASK_ROWS, 40])
def test_near_fingerprints(spark, monkeypatch, task_rows):
    """Chains and balls of near fingerprints, with values that are dealt out."""
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = set(centres)
    for c in centres:
        at = c
        for _ in range(120):
            at ^= sum({1 << rng.randrange(64) for _ in range(rng.choice((1, 2, 4, 5)))})
            fps.add(at)
            fps.add(c ^ sum({1 << rng.randrange(8) for _ in range(4)}))
    rows = [(k, fp) for k, fp in enumerate(sorted(fps))] + [(9000, min(fps)), (None, max(fps))]
    table = spark.createDataFrame([(d, fp - (1 << 64) if fp >> 63 else fp) for d, fp in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "hashed", lambda docs, n, seed: docs)
    got = rows_of(simhash.near_duplicates(table, task_rows=task_rows), "doc_id", "fingerprint", "component_id")
    assert got == brute_components(rows, 4)


def test_allocation_is_complete_and_cheapest():
    for _ in range(200):
        parts, distance = rng.randrange(1, 5), rng.randrange(0, 5)
        costs = [[0.0, *(rng.random() * 9 for _ in range(distance + 1))] for _ in range(parts)]
        cost, e = simhash.allocate(costs, distance)
        assert sum(k + 1 for k in e) == distance + 1 and len(e) == parts
        from itertools import product

        least = min(sum(c[k] for c, k in zip(costs, ks, strict=True)) for ks in product(range(distance + 2), repeat=parts) if sum(ks) == distance + 1)
        assert abs(cost - least) < 1e-9


def test_parts_hold_what_goes_together():
    gen = np.random.default_rng(3)
    bits = gen.integers(0, 2, (4000, 64))
    bits[:, 1::2] = bits[:, 0::2]  # each odd bit follows the one before
    fp = (bits.astype(object) * np.array([1 << k for k in range(64)], object)).sum(axis=1).astype(np.uint64)
    ones = simhash.bit_matrix(fp).astype(float)
    assert (ones == bits).all()
    parts = simhash.correlated_parts(len(fp), ones.T @ ones, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert all({b ^ 1 for b in p} == set(p) for p in parts)


def test_many_links_connect_as_all_pairs_do():
    for size in (3, 70, 300):
        base = rng.getrandbits(64)
        fps = np.array([base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(7))}) for _ in range(size)], np.uint64)
        edges = simhash._many_links(fps, 4)
        assert all(np.bitwise_count(a ^ b).max() <= 4 for a, b in edges)
        rows = [(k, int(x)) for k, x in enumerate(np.unique(fps))]
        want = {fp: c for _, fp, c in brute_components(rows, 4)}
        nodes, least = simhash.least_connected(*(np.concatenate([e[i] for e in edges]) for i in (0, 1))) if edges else ([], [])
        label = {int(x): int(x) for _, x in rows} | {int(x): int(y) for x, y in zip(nodes, least, strict=True)}
        for _, x in rows:
            for _, y in rows:
                assert (label[x] == label[y]) == (want[f"{x:016x}"] == want[f"{y:016x}"])
