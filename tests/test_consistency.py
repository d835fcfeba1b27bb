"""Whole-mapping evidence against loops; planted worlds; near misses; scripts."""

import random

from graphspan.functions import text
from graphspan.operators import consistency, sessions
from graphspan.schema import TYPES
from graphspan.sources import planted
from pyspark.sql import functions as F

rng = random.Random(31)
RELATION = "graph_id long, rel int, src int, dst int, type string, assertion string, modality string, conf double"


def worlds(n=12, size=5, edges=7, mapped=4, kinds=2, turned=True):
    relations = []
    for g in range(n):
        ends = rng.sample([(a, b) for a in range(size) for b in range(size) if a != b], edges)
        relations += [(g, k, a, b, rng.choice(TYPES[:kinds]), rng.choice(("asserted", "asserted", "negated")) if turned else "asserted", "actual", rng.choice((0.5, 0.8, 1.0))) for k, (a, b) in enumerate(ends)]
    mapping = []
    for g in range(n - 1):
        c = rng.sample(range(size), size) if turned else list(range(size))
        mapping += [(g, g + 1, q, c[q]) for q in rng.sample(range(size), mapped)]
    return relations, mapping


def test_global_conflicts_against_loops(spark):
    relations, mapping = worlds()
    want = {}
    for g in range(11):
        m = {q: c for a, _, q, c in mapping if a == g}
        mine, theirs = ([r for r in relations if r[0] == k] for k in (g, g + 1))
        seen = set()
        for i, ci in m.items():
            for kind in TYPES:
                for here, there in ((2, 3), (3, 2)):
                    q = [(r[there], r) for r in mine if r[4] == kind and r[here] == i and r[there] in m]
                    c = [(r[there], r) for r in theirs if r[4] == kind and r[here] == ci and r[there] in m.values()]
                    to_q, to_c = {m[j] for j, _ in q}, {j for j, _ in c}
                    if not to_q or not to_c:
                        continue
                    for j, r in q:
                        for k, s in sorted(c, key=lambda x: x[1][1]):
                            if m[j] not in to_c and k not in to_q and (r[1], s[1]) not in seen:
                                seen.add((r[1], s[1]))
                                want[g, g + 1, r[1], s[1]] = min(r[7], s[7])
                                break
    got = consistency.global_conflicts(spark.createDataFrame(mapping, "query_id long, graph_id long, q int, c int"), spark.createDataFrame(relations, RELATION))
    assert {tuple(r)[:4]: r["weight"] for r in got.collect()} == want and want


def test_systematicity_against_components(spark):
    relations, mapping = worlds(40, 7, 14, 7, 1, False)
    kept = consistency.preserved(spark.createDataFrame(mapping, "query_id long, graph_id long, q int, c int"), spark.createDataFrame(relations, RELATION)).cache()
    rows = {}
    for r in kept.collect():
        rows.setdefault((r["query_id"], r["graph_id"]), []).append((r["src"], r["dst"], r["weight"]))
    by = {(a, b): {q: c for x, y, q, c in mapping if (x, y) == (a, b)} for a, b in {m[:2] for m in mapping}}
    for (a, b), m in by.items():
        theirs = [r[2:7] for r in relations if r[0] == b]
        assert len(rows.get((a, b), [])) == sum(r[2] in m and r[3] in m and (m[r[2]], m[r[3]], *r[4:7]) in theirs for r in relations if r[0] == a)
    want = {}
    for pair, rels in rows.items():
        group = list(range(len(rels)))
        for _ in rels:
            for i, x in enumerate(rels):
                for j, y in enumerate(rels):
                    if {x[0], x[1]} & {y[0], y[1]}:
                        group[i] = group[j] = min(group[i], group[j])
        linked = [group.count(k) > 1 for k in group]
        want[pair] = (len(rels), sum(linked), round(sum(w if k else w / 2 for (_, _, w), k in zip(rels, linked, strict=True)) / sum(w for _, _, w in rels), 9))
    got = {(r["query_id"], r["graph_id"]): (r["n"], r["connected"], round(r["systematicity"], 9)) for r in consistency.systematicity(kept).collect()}
    assert {k: (got.get(k), want.get(k)) for k in got | want if got.get(k) != want.get(k)} == {} and any(0 < c < n for n, c, _ in want.values())


def test_planted_worlds_do_not_depend_on_partitions(spark):
    names = spark.createDataFrame([(k, f"name{k}") for k in range(40)], "n long, name string")
    few, many = spark.range(0, 6, 1, 1).withColumnRenamed("id", "world"), spark.range(0, 6, 1, 5).withColumnRenamed("id", "world")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(planted.nodes(few, names)) == rows(planted.nodes(many, names)) and rows(planted.relations(few)) == rows(planted.relations(many))
    at = {(r["graph_id"], r["node"]) for r in planted.nodes(few, names).collect()}
    ends = planted.relations(few).collect()
    assert all((r["graph_id"], r[e]) in at for r in ends for e in ("src", "dst")) and all(r["src"] != r["dst"] for r in ends)
    flipped = {r["graph_id"] % planted.WORLD for r in ends} == {m[0] for m in planted.FAMILIES}
    assert flipped and planted.cases(few).filter("relevant").count() == 6 * sum(f[3] for f in planted.FAMILIES[1:])


def test_near_misses_need_that_nobody_matched(spark):
    rows = [(1, 10, 0.9, False, "negative"), (1, 11, 0.5, False, ""), (1, 12, 0.3, False, None), (1, 13, 0.9, True, "direct"), (2, 20, 0.9, False, "negative"), (2, 21, 0.1, False, "Direct"), (3, 30, 0.39, False, "negative")]
    got = sessions.near_misses(spark.createDataFrame(rows, "query_id long, graph_id long, semantic double, hard boolean, classification string"))
    assert sorted((r["query_id"], r["graph_id"], r["n"]) for r in got.collect()) == [(1, 10, 1), (1, 11, 2)]


def test_scripts_are_told_apart(spark):
    df = spark.createDataFrame([("heat тепло θερμό",), ("テスト かな 漢字",), ("한국 שלום سلام हिन्दी",), ("12 !",)], "t string")
    got = [(r[0], r[1]) for r in df.select(text.scripts(F.col("t")), text.uncovered_scripts(F.col("t"))).collect()]
    assert got == [(["latin", "cyrillic", "greek"], ["greek"]), (["cjk", "kana"], ["cjk", "kana"]), (["hebrew", "arabic", "devanagari", "hangul"],) * 2, ([], [])]
