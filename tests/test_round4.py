"""Findings of round 4: the same answers with less, and on rows that made a query fail."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphspan.operators import consistency, features, index, retrieve, totals, verify
from graphspan.plans import graph_queries, stream_queries, text_queries, verify_queries
from graphspan.schema import ROLES, TYPES
from graphspan.sources import derived, scratch
from graphspan.sources.scratch import kept


def test_documents_without_words_have_no_first_word(spark, tmp_path):
    rows = [(1, "One two"), (2, " -- ?! "), (3, ""), (4, None), (5, "Ещё одно 7")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in text_queries.d1_split_words(spark, str(tmp_path)).collect())
    assert got == [(1, 2, "one", "two"), (2, 0, None, None), (3, 0, None, None), (4, None, None, None), (5, 3, "ещё", "7")]


def test_sessions_are_written_packed(spark, tmp_path):
    """Lines repeat the same names; unpacked, they took more disk than anything else of the query."""
    before = {p.name for p in Path(scratch.shared_dir(spark).removeprefix("file:")).glob("sessions-*")}
    got = stream_queries.a2_session_scan(spark, "/root/testdata/sf0.001")
    assert got.count() and got.filter("n_nodes < 1").count() == 0
    new = [p for p in Path(scratch.shared_dir(spark).removeprefix("file:")).glob("sessions-*") if p.name not in before]
    parts = [f for p in new for f in p.glob("part-*")]
    assert parts and all(f.name.endswith(".json.gz") for f in parts)


def test_nested_graphs_meet_sessions_without_a_shuffle_of_their_own(spark):
    lines = derived.order_lines(spark, "/root/testdata/sf0.001")
    dna = derived.thoughts(lines, "graph_id")
    met = derived.sessions(spark, "/root/testdata/sf0.001").hint("merge").join(dna.withColumnRenamed("graph_id", "session_id").hint("merge"), "session_id")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(thought_id" in x or "cast(thought_id" in x]
    assert plan.count("Exchange hashpartitioning(graph_id") + plan.count("Exchange hashpartitioning(l_orderkey") == 1


def _worlds(spark):
    """Pairs of small graphs with odd relations, and mappings of some of their nodes: (nodes, relations, mapping, pairs as rows)."""
    some, nodes, rels, mapping = random.Random(5), [], [], []
    for g in range(60):
        size = some.randint(1, 5)
        nodes += [(g, k, some.choice(ROLES[:4]), round(some.uniform(0.5, 1), 2)) for k in range(size)]
        rels += [(g, r, some.randrange(size), some.randrange(size), some.choice(TYPES[:3]), some.choice(["asserted", "negated"]), some.choice(["actual", "possible"]), round(some.uniform(0.5, 1), 2)) for r in range(some.randint(0, 7))]
    sizes = {g: sum(n[0] == g for n in nodes) for g in range(60)}
    for g in range(59):
        n = some.randint(1, min(sizes[g], sizes[g + 1]))
        mapping += [(g, g + 1, q, c) for q, c in zip(some.sample(range(sizes[g]), n), some.sample(range(sizes[g + 1]), n), strict=True)]
    frame = spark.createDataFrame
    nodes, relations = frame(nodes, "graph_id long, node int, role string, conf double"), frame(rels, "graph_id long, rel int, src int, dst int, type string, assertion string, modality string, conf double")
    mapping = frame(mapping, "query_id long, graph_id long, q int, c int")
    ms = mapping.groupBy("query_id", "graph_id").agg(F.sort_array(F.collect_list(F.struct("q", "c"))).alias("ms"))
    return nodes, relations, mapping, derived.beside(features.pack(nodes, relations)).join(ms, ["query_id", "graph_id"])


def test_pairs_as_rows_are_adjudicated_as_by_joins(spark):
    nodes, relations, mapping, rows = _worlds(spark)
    pairs = mapping.select("query_id", "graph_id").distinct()
    told = lambda df: sorted(tuple(round(float(x), 9) for x in r) for r in df.collect())
    old, new = told(verify.adjudicate(pairs, mapping, nodes, relations)), told(verify.adjudicate_of(rows))
    assert old == new and len(old) == 59
    assert sum(r[3] > 0 for r in old) > 2 and sum(r[4] for r in old) > 0 and sum(r[7] > 0 for r in old) > 10


def test_conflicts_of_pairs_as_rows_are_those_by_joins(spark):
    _, relations, mapping, rows = _worlds(spark)
    new = consistency.global_conflicts_of(rows).select("query_id", "graph_id", F.explode("found").alias("x")).select("query_id", "graph_id", "x.*")
    told = lambda df: sorted(tuple(r) for r in df.select("query_id", "graph_id", "q_rel", "c_rel", "weight").collect())
    assert told(consistency.global_conflicts(mapping, relations)) == told(new) and new.count() > 5


@pytest.mark.parametrize("query", [verify_queries.k_adjudicate, verify_queries.h14_global_conflicts])
def test_neighbours_meet_in_two_shuffles(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 4  # lines of both sides by order, one side by its neighbour, parts at most


def test_best_of_queries_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(totals, "BEST_MET", 7)
    monkeypatch.setattr(totals, "BEST_ASKED", 3)
    words, some = ["red bolt", "blue gear", "hot rod", "cold ring", "old bolt", "red gear", "of the"], random.Random(3)
    said = [(g, n, some.choice(words), "a", "b") for g in range(60) for n in range(1 + g % 4)]
    said += [(g + 100, *rest) for g, *rest in said if g < 25]  # copies, a query's among them
    lines = spark.createDataFrame(said, "graph_id long, node int, label string, about string, requires string")
    ids = spark.createDataFrame([(g,) for g in (0, 3, 7, 20, 59, 103)], "query_id long")
    terms = kept(index.content_terms(lines))
    scored = index.content_scores(terms, index.content_stats(terms, lines.select("graph_id").distinct().count()), ids).withColumn("content", F.round("content", 6))
    for k in (1, 4, 200):
        want = scored.withColumn("rank", retrieve.rank("content")).filter(f"rank <= {k}")
        told = lambda df: sorted((r["query_id"], r["graph_id"], r["content"], r["rank"]) for r in df.collect())
        assert told(totals.best(lines, ids, k)) == told(want) and want.count() > 5


def test_ranks_need_no_row_for_each_pair(spark):
    plan = graph_queries.i1_ranks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "idf" not in plan  # content is worked out in blocks, so no join of terms is left


def test_keysets_of_rows_are_those_of_fingerprints(spark):
    nodes, relations, _, _ = _worlds(spark)
    graphs = features.pack(nodes, relations)
    told = lambda df: sorted((r["graph_id"], r["key"]) for r in df.collect())
    want = told(features.keysets(features.fingerprints_of(graphs)))
    assert told(features.keysets_of(graphs).withColumn("key", F.lower(F.hex("key")))) == want and len(want) > 200
    assert told(features.keysets_of(graphs, 16).withColumn("key", F.lower(F.hex("key")))) == [(g, k[:32]) for g, k in want]
    plan = features.keysets_of(graphs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == graphs._jdf.queryExecution().executedPlan().toString().count("Exchange")
