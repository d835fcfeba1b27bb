"""Search by bounds against scoring everything; likeness joins against all pairs; shapes that stop early."""

import random
from collections import Counter
from math import sqrt

import pytest

from graphspan.functions.stem import STOPWORDS, stem
from graphspan.operators import features, kernel, labels, prune, verify
from graphspan.schema import AFFINITY, ROLES, TWIN, TWIN_CHOSEN, TYPES
from pyspark.sql import functions as F

rng = random.Random(21)


def test_pruned_answers_are_those_of_scoring_everything(spark, monkeypatch):
    """Two channels of weighted terms; exact scores lie below their bounds.  Ties at the k-th place stay."""
    monkeypatch.setattr(prune, "FIRST_POSTINGS", 30)
    postings = {(g, c, f"t{int(rng.paretovariate(0.7)) % 60}"): float(rng.choice((1, 1, 2, 3))) for g in range(300) for c in ("x", "y") for _ in range(12)}
    asked = {(q, c, f"t{k}"): (rng.choice((3.0, 1.0, 0.2)) / (1 + k % 7), float(rng.choice((1, 2, 9)))) for q in (5, 9, 400) for c in ("x", "y") for k in rng.sample(range(60), 20)}
    factor = {(q, g): rng.choice((1.0, 1.0, 0.5)) for q in (5, 9, 400) for g in range(300)}
    exact = Counter()
    for (g, c, t), v in postings.items():
        for q in (5, 9, 400):
            if g != q and (q, c, t) in asked:
                unit, cap = asked[q, c, t]
                exact[q, g] += unit * min(cap, v) * factor[q, g]
    scores = spark.createDataFrame([(q, g, s) for (q, g), s in exact.items()], "query_id long, graph_id long, score double")
    told = []

    def score(pairs):
        told.append(pairs.count())
        return pairs.join(scores, ["query_id", "graph_id"])

    df = prune.blocked(spark.createDataFrame([(*k, v) for k, v in postings.items()], "graph_id long, channel string, term string, value double"))
    found, read = prune.top(spark.createDataFrame([(*k, *v) for k, v in asked.items()], "query_id long, channel string, term string, unit double, cap double"), df, score, 5)
    got = {(r["query_id"], r["graph_id"]): r["score"] for r in found.collect()}
    for q in (5, 9, 400):
        mine = sorted((round(s, 9) for (p, _), s in exact.items() if p == q), reverse=True)
        best = {g: s for (p, g), s in exact.items() if p == q and round(s, 9) >= mine[4]}
        assert {g: got.get((q, g)) for g in best} == best
    rows = {r["query_id"]: r for r in read.collect()}
    assert all(r["read"] <= r["postings"] and r["pool"] < 300 for r in rows.values())
    assert sum(r["read"] for r in rows.values()) < 0.95 * sum(r["postings"] for r in rows.values())  # postings were skipped
    assert told[-1] == sum(r["pool"] for r in rows.values()) < 0.7 * len(exact)


def brute_surface(a, b):
    words = lambda x: x.lower().split()
    sa, sb = ({stem(w) for w in words(x) if w not in STOPWORDS} for x in (a, b))
    grams = lambda x: Counter(f" {' '.join(words(x))} "[i : i + 3] for i in range(len(" ".join(words(x)))))
    ga, gb = grams(a), grams(b)
    cos = sum(n * gb[g] for g, n in ga.items()) / sqrt(sum(n * n for n in ga.values()) * sum(n * n for n in gb.values()))
    return max(len(sa & sb) / len(sa | sb) if sa | sb else 0.0, 0.85 * cos if cos > 0.5 else 0.6 * cos)


@pytest.mark.parametrize("least", [0.8, 0.5, 0.9])
def test_twins_are_those_of_all_pairs(spark, least):
    words = ["pump", "pumps", "pumping", "valve", "valves", "heat", "heating", "load", "loads", "test", "tested", "the", "of", "queue", "queues", "ёлка", "насос", "насосы"]
    names = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(160)})
    known = labels.features(spark.createDataFrame([(n,) for n in names] + [(None,)], "label string"))
    got = {(r["label_a"], r["label_b"]): round(r["surface"], 9) for r in labels.twins(known.cache(), least).collect()}
    want = {(a, b): round(s, 9) for a in names for b in names if a != b and (s := brute_surface(a, b)) >= least - 1e-9}
    assert got == want and len(want) > 20
    best = {r["label"]: (r["twin"], round(r["surface"], 9)) for r in labels.best_twin(labels.twins(known, least)).collect()}
    assert best == {a: min(((b, s) for (x, b), s in want.items() if x == a), key=lambda t: (-t[1], t[0])) for a in {a for a, _ in want}}


def test_plural_finds_singular(spark):
    from graphspan.operators import index

    nodes = spark.createDataFrame([(1, 0, "clean pumps"), (2, 0, "the pump"), (3, 0, "valves")], "graph_id long, node int, label string")
    terms = index.content_terms(nodes)
    found = index.content_scores(terms, index.content_stats(terms, 3), spark.createDataFrame([(2,)], "query_id long"))
    assert {r["graph_id"] for r in found.collect()} == {1}


def small_graphs(n=6, size=4):
    nodes = [(g, k, rng.choice(("heat load", "loads of heat", "cold valve", "review process", "heat")), rng.choice(ROLES), rng.choice((0.5, 0.9, 1.0)), True) for g in range(n) for k in range(size)]
    relations = [(g, k, *rng.sample(range(size), 2), rng.choice(TYPES), "asserted", "actual", 0.9) for g in range(n) for k in range(3)]
    refs = [(g, k, "about", rng.choice("abc")) for g in range(n) for k in range(size) if k % 2]
    return nodes, relations, refs


def test_affinity_is_the_kernels(spark):
    nodes, relations, refs = small_graphs()
    df = spark.createDataFrame(nodes, "graph_id long, node int, label string, role string, conf double, atomic boolean")
    known = spark.createDataFrame(refs, "graph_id long, node int, bucket string, ref string")
    names = sorted({n[2] for n in nodes})
    concepts = {"heat load": ["HEAT", "LOAD"], "loads of heat": ["HEAT"], "cold valve": ["COOLING"], "review process": [], "heat": ["HEAT"]}
    feats = labels.features(df, spark.createDataFrame(list(concepts.items()), "label string, concepts array<string>"))
    compared = labels.compare(spark.createDataFrame([(a, b) for a in names for b in names], "label_a string, label_b string"), feats)
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "query_id long, graph_id long")
    got = {(r["query_id"], r["graph_id"], r["q"], r["c"]): r["affinity"] for r in labels.node_affinity(pairs, df, known, compared, verify.role_fit(F.col("role"), F.col("role_c")), AFFINITY).collect()}

    def graph(g):
        mine = [n for n in nodes if n[0] == g]
        return kernel.Graph([n[2:] for n in mine], [], set(), set(), [frozenset(concepts[n[2]]) for n in mine], [frozenset(r[3] for r in refs if r[:2] == n[:2]) for n in mine])

    for a, b in ((0, 1), (2, 3)):
        want = kernel.affinity(graph(a), graph(b))
        assert all(abs(got[a, b, i, j] - want[i, j]) < 1e-9 for i in range(4) for j in range(4))


def test_label_conflicts_against_loops(spark):
    nodes, _, _ = small_graphs(8, 5)
    df = spark.createDataFrame(nodes, "graph_id long, node int, label string, role string, conf double, atomic boolean")
    names = sorted({n[2] for n in nodes})
    compared = labels.compare(spark.createDataFrame([(a, b) for a in names for b in names], "label_a string, label_b string"), labels.features(df))
    mapping = [(q, q + 1, i, (i + 1) % 5) for q in range(7) for i in range(4)]
    got = {tuple(r)[:4]: r["weight"] for r in labels.label_conflicts(spark.createDataFrame(mapping, "query_id long, graph_id long, q int, c int"), df, compared, TWIN, TWIN_CHOSEN).collect()}
    at = {(n[0], n[1]): n for n in nodes}
    fused = lambda a, b: max(brute_surface(a, b), 0.5 * brute_surface(a, b))
    want = {}
    for q, g, i, c in mapping:
        if fused(at[q, i][2], at[g, c][2]) >= TWIN_CHOSEN:
            continue
        for mine, others in ((at[q, i], [at[g, j] for j in range(5) if j != c]), (at[g, c], [at[q, j] for j in range(5) if j != i])):
            sims = [(-brute_surface(mine[2], o[2]), o[1], o) for o in others]
            low = min(sims, key=lambda s: s[:2])
            if -low[0] >= TWIN:
                key = (q, g, i, low[1]) if mine is at[q, i] else (q, g, low[1], c)
                want[key] = min(mine[4], low[2][4]) * -low[0]
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()} and want


def test_shapes_tell_what_all_rounds_tell(spark):
    """Early stop: graphs have equal signatures exactly if colours after as many rounds as nodes agree."""
    graphs = {}
    for g in range(60):
        n = rng.randrange(1, 7)
        graphs[g] = ([rng.choice(ROLES[:2]) for _ in range(n)], [(rng.randrange(n), rng.randrange(n), rng.choice(TYPES[:2])) for _ in range(rng.randrange(0, 7))])
    for g in range(60, 90):  # the same with their nodes renamed
        roles, edges = graphs[g - 60]
        p = rng.sample(range(len(roles)), len(roles))
        graphs[g] = ([r for _, r in sorted(zip(p, roles, strict=True))], [(p[a], p[b], t) for a, b, t in edges])
    nodes = [(g, k, r) for g, (roles, _) in graphs.items() for k, r in enumerate(roles)]
    edges = [(g, k, a, b, t, "asserted", "actual") for g, (_, es) in graphs.items() for k, (a, b, t) in enumerate(es)]
    got = {r["graph_id"]: r["signature"] for r in features.shape_signatures(spark.createDataFrame(nodes, "graph_id long, node int, role string"), spark.createDataFrame(edges, "graph_id long, rel int, src int, dst int, type string, assertion string, modality string")).collect()}

    def brute(g):
        colour = list(graphs[g][0])
        for _ in range(8):
            colour = [str(hash((c, tuple(sorted([("+", t, colour[b]) for a, b, t in graphs[g][1] if a == i] + [("-", t, colour[a]) for a, b, t in graphs[g][1] if b == i]))))) for i, c in enumerate(colour)]
        return tuple(sorted(colour)), tuple(sorted((colour[a], t, colour[b]) for a, b, t in graphs[g][1]))

    want = {g: brute(g) for g in graphs}
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in graphs for b in graphs)


def test_twins_write_no_pairs_of_unlike_labels(spark, monkeypatch):
    """Labels of few words share their rarest stems and trigrams with very many others; what is fetched for them is the like ones."""
    some, pairs, real = random.Random(3), [], labels._sides
    words = ["".join(some.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    rows = sorted({" ".join(some.sample(words, 6)) for _ in range(300)} | {" ".join(words[:6]), " ".join(words[:5]) + f" {words[5]}x"})
    monkeypatch.setattr(labels, "_sides", lambda met, *a: pairs.append(met.count()) or real(met, *a))
    found = labels.twins(labels.features(spark.createDataFrame([(x,) for x in rows], "label string"))).collect()
    assert {" ".join(words[:6]), " ".join(words[:5]) + f" {words[5]}x"} <= {r["label_a"] for r in found}
    assert pairs[0] < 300
