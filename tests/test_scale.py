"""What must hold on tables larger than those of the other tests."""

import pickle
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from graphspan.llm import setjoin
from graphspan.functions import lexicon
from graphspan.operators import consistency, extract, features, index, kernel, labels, product, quality, totals
from graphspan.plans import graph_queries, product_queries, stream_queries, verify_queries
from graphspan.sources import derived, storage
from graphspan.sources.scratch import kept


def test_small_files_of_many_rows_are_not_broadcast(spark):
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(static), spark.conf.get(measured, None)
    try:
        spark.conf.unset(measured)
        spark.conf.set(static, "10m")
        many = kept(spark.range(400_000).select("id", F.lit("the same in every row, which files hold once").alias("text")))
        plan = many.join(many.select("id", F.col("text").alias("other")), "id")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert spark.conf.get(measured) == "10m"
        spark.conf.set(static, "-1")
        kept(spark.range(1))
        assert spark.conf.get(static) == "-1"
    finally:
        spark.conf.set(static, before[0])
        spark.conf.unset(measured) if before[1] is None else spark.conf.set(measured, before[1])


def test_a_label_of_several_nodes_names_the_first_by_number(spark):
    nodes = spark.createDataFrame([(1, f"N{k}", "red bolt" if k in (2, 10) else f"part {k}") for k in range(12)], "thought_id long, id string, label string")
    relations = spark.createDataFrame([(1, "r", "N0", "RED BOLT", "causes")], "thought_id long, id string, source string, target string, type string")
    assert product.manual_relations(relations, nodes).first()["target_id"] == "N2"


def test_cues_are_looked_for_once_in_a_sentence_and_only_where_their_words_are():
    cues = extract.compiled()
    text = "Red bolts causes the gear. " * 40 + "Blue rods because of wear. "
    got = extract.extract(text, cues)
    assert [(r["type"], r["start"]) for r in got["relations"]] == [("causes", 10), ("causes", 27 * 40 + 10)]
    assert cues.found.cache_info().hits >= 38 and cues.found.cache_info().misses <= 3
    assert [x[2:4] for x in cues.found("Some \u017fupports that; ВЫЗЫВАЕТ it, leads nowhere")] == [("supports", "fwd"), ("causes", "fwd")]
    assert extract.extract(text, pickle.loads(pickle.dumps(cues))) == got
    assert extract.extract("  [redacted]  causes wear")["relations"] == []


def test_unlike_sets_of_a_token_make_no_cluster(spark):
    t, some = Fraction(8, 10), np.random.default_rng(5)
    base = np.unique(some.integers(1, 1 << 62, 200).astype(np.uint64))
    sets = [base, np.unique(np.append(base[:-6], np.uint64(7)))] + [np.unique(np.append(some.integers(1, 1 << 62, 199), int(base[0])).astype(np.uint64)) for _ in range(10)]
    assert all(sum(bin(x).count("1") for x in (setjoin.sketch(a) ^ setjoin.sketch(b)).view(np.uint64).tolist()) <= len(np.setxor1d(a, b)) for a in sets for b in sets)
    postings = spark.createDataFrame([(9, 0, len(s), k) for k, s in enumerate(sets)], "token long, list int, size int, node long").repartition(1).sortWithinPartitions("token", "list", "size", "node")
    listed = setjoin._list_links(postings, t)
    assert listed.filter("kind = 2").count() == 66 and not listed.filter("kind = 0").count()
    sketches = spark.createDataFrame([(k, len(s), setjoin.sketch(s).tolist()) for k, s in enumerate(sets)], "node long, size int, sketch array<long>")
    assert [tuple(r) for r in setjoin._near_pairs(listed.filter("kind = 2").select("a", "b"), sketches, t).collect()] == [(0, 1)]


def test_what_concerns_one_graph_is_worked_out_in_its_row(spark, tmp_path):
    some = np.random.default_rng(3)
    roles, kinds = ["state", "method", None], ["causes", "prevents", "requires"]
    sizes = [int(n) for n in some.integers(1, 9, 40)]
    nodes = spark.createDataFrame([(g, n, roles[(g + n) % 3], f"part {n % 3}") for g, size in enumerate(sizes) for n in range(size)], "graph_id long, node int, role string, label string")
    ends = [(g, r, int(some.integers(0, size + 1)), int(some.integers(0, size + 1)), kinds[int(some.integers(0, 3))], "asserted", "actual") for g, size in enumerate(sizes) for r in range(2 * size)]
    relations = spark.createDataFrame(ends, "graph_id long, rel int, src int, dst int, type string, assertion string, modality string")
    graphs = features.pack(nodes, relations)
    adj = features.adjacency(nodes, relations)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    found = features.paths(adj)
    assert rows(features.paths_of(graphs)) == rows(found)
    reached = {(g, a, b): 1 for g, _, s, t, *_ in ends for a, b in ((s, t), (t, s)) if b < sizes[g]}
    for hops in (2, 3):
        reached |= {k: hops for k in {(g, a, c) for (g, a, b), h in reached.items() if h == hops - 1 for (g2, b2, c), h2 in reached.items() if h2 == 1 and (g2, b2) == (g, b) and c != a} if k not in reached}
    assert {(r["graph_id"], r["a"], r["b"]): r["hops"] for r in found.collect()} == reached
    colours = features.d1(nodes, adj)
    assert rows(features.d1_of(graphs)) == rows(colours)
    both = features.fingerprints(found, features.d0(nodes), "D0").unionByName(features.fingerprints(found, colours, "D1"))
    assert rows(features.multi_fingerprints(nodes, relations)) == rows(both)


def test_graphs_of_orders_are_shuffled_once(spark, tmp_path):
    lines = [(o, n % 3, 1, n, 40.0, 9.0, 0.01 * n, 0.02, "N", "F", 1) for o in range(3) for n in range(5)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"red bolt {k}", "Brand 1", "STEEL", k) for k in range(3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    known = graph_queries.QUERIES | verify_queries.QUERIES | {"thoughts": lambda spark, d: derived.thoughts(derived.order_lines(spark, d))}
    for name in ("f3_d1", "f4_paths", "f5_fingerprints", "f8_keysets", "f16_thought_fingerprint", "h13_effective_relations", "thoughts"):
        whole = known[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert whole.count("Exchange hashpartitioning") == 1, name


def test_graphs_as_lines_are_packed(spark, tmp_path):
    graphs = spark.range(3).select(F.col("id").cast("string").alias("thought_id"), F.lit("0.1").alias("schema_version"))
    storage.write_graphs(graphs, f"{tmp_path}/graphs")
    assert {p.suffix for p in (tmp_path / "graphs").glob("part-*")} == {".gz"}
    assert sorted(r["thought_id"] for r in storage.read_graphs(spark, f"{tmp_path}/graphs").collect()) == ["0", "1", "2"]


def test_totals_of_queries_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(totals, "MET", 7)
    monkeypatch.setattr(totals, "ASKED", 3)
    words, refs = ["red bolt", "blue gear", "hot rod", "cold ring", "of the"], ["a", "b", "c", "d"]
    some = np.random.default_rng(11)
    said = [(g % 25, n, words[int(some.integers(0, 5))], refs[int(some.integers(0, 4))], refs[int(some.integers(0, 4))]) for g in range(25) for n in range(1 + g % 4)]
    said += [(g + 100, *rest) for g, *rest in said if g < 15]  # copies, a query's among them
    lines = spark.createDataFrame(said, "graph_id long, node int, label string, about string, requires string")
    ids = spark.createDataFrame([(g,) for g in (0, 3, 7, 20, 24, 103)], "query_id long")
    terms = kept(index.content_terms(lines))
    n = lines.select("graph_id").distinct().count()
    content = index.content_scores(terms, index.content_stats(terms, n), ids)
    knowledge = derived.knowledge(lines)
    known = index.knowledge_scores(knowledge, index.about_stats(knowledge, n), ids)
    pairs = content.join(known, ["query_id", "graph_id"], "full")
    full = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).alias(c)
    want = pairs.groupBy("query_id").agg(F.count("content").alias("n_content"), F.count(F.coalesce("about", "complement")).alias("n_known"), F.count("*").alias("n_any"), *[full(c) for c in ("content", "about", "complement")], F.coalesce(F.max("complement"), F.lit(0.0)).alias("most"))
    rows = lambda df: {r["query_id"]: tuple(round(r[c], 9) for c in want.columns[1:]) for r in df.collect()}
    got = totals.per_query(lines, ids)
    assert rows(got.filter("n_any > 0")) == rows(want) and any(r[-1] > 0 for r in rows(want).values())
    assert "MapInArrow" in got._jdf.queryExecution().sparkPlan().toString()


def _orders(spark, path, orders=12, parts=7):
    """Tables of some orders, one of them after a gap, parts' names among those of the terms."""
    some = np.random.default_rng(23)
    lines = [(o + 2 * (o > 8), int(some.integers(0, parts - 1)), int(some.integers(0, 14)), n, float(some.integers(1, 50)), 9.0, 0.01 * int(some.integers(0, 9)), 0.01 * int(some.integers(0, 9)), "RN"[int(some.integers(0, 2))], "FO"[int(some.integers(0, 2))], 1) for o in range(orders) for n in range(int(some.integers(1, 7)))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate int").write.parquet(f"{path}/lineitem.parquet")
    names = ["hot bolt", "cold gear", "hot gear", "red valve", "large ring", "blue bolt", "old rod"]
    spark.createDataFrame([(k, names[k], f"Brand {k % 3}", "STEEL", k) for k in range(parts)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    return str(path)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_neighbours_are_joined_as_rows(spark, tmp_path):
    d = _orders(spark, tmp_path)
    nodes = derived.nodes(derived.order_lines(spark, d)).collect()
    role = {(r["graph_id"], r["node"]): r["role"] for r in nodes}
    met = Counter((a, role[g + 1, n]) for (g, n), a in role.items() if (g + 1, n) in role)
    got = verify_queries.QUERIES["k2_roles"](spark, d)
    assert _shuffles(got) <= 4
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == met


def test_repeats_are_judged_in_a_row_of_each_case(spark, tmp_path):
    rows = lambda *said: spark.createDataFrame(list(said), "case long, signature string")
    first, second = rows((1, "a"), (1, "a"), (1, "b"), (2, None), (3, "x"), (5, None), (5, "a")), rows((1, "b"), (1, "c"), (2, None), (4, "x"), (5, "a"))
    got = {r["case"]: round(r["f1"], 6) for r in quality.repeat_f1(first, second).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: round(2 / 3, 6)}
    assert _shuffles(product_queries.QUERIES["f17_repeat_f1"](spark, _orders(spark, tmp_path))) <= 4


def test_role_hints_need_no_orders(spark, tmp_path):
    d = _orders(spark, tmp_path)
    labels = derived.line_labels(spark, d)
    assert sorted(r["label"] for r in labels.collect()) == sorted({r["label"] for r in derived.order_lines(spark, d).select("label").collect()})
    assert "old rod" not in {r["label"] for r in labels.collect()}  # a part that no line has
    told = []
    real = derived.order_lines
    try:
        derived.order_lines = lambda *a: told.append(a) or real(*a)
        assert {r["label"] for r in stream_queries.QUERIES["d8_role_hints"](spark, d).collect()} and not told
    finally:
        derived.order_lines = real


def test_evidence_of_pairs_is_worked_out_in_their_rows(spark, tmp_path):
    some = np.random.default_rng(17)
    relations = [(g, k, int(some.integers(0, 5)), int(some.integers(0, 5)), ["causes", "prevents", None][min(2, int(some.integers(0, 9)) % 5)], "asserted", "actual", float(some.choice([0.5, 0.8, 1.0]))) for g in range(20) for k in range(9)]
    mapping = [(g, g + 1, int(q), int(c)) for g in range(19) for q, c in zip(some.permutation(5)[:4], some.permutation(5)[:4], strict=True)]
    stated = spark.createDataFrame(relations, "graph_id long, rel int, src int, dst int, type string, assertion string, modality string, conf double")
    mapped = spark.createDataFrame(mapping, "query_id long, graph_id long, q int, c int")
    es = stated.groupBy("graph_id").agg(F.collect_list(F.struct(*stated.columns[1:])).alias("es"))
    pairs = mapped.groupBy("query_id", "graph_id").agg(F.collect_list(F.struct("q", "c")).alias("ms"))
    pairs = pairs.join(es.select(F.col("graph_id").alias("query_id"), F.col("es").alias("q_es")), "query_id").join(es.withColumnRenamed("es", "c_es"), "graph_id")
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    want, got = consistency.preserved(mapped, stated), consistency.preserved_of(pairs)
    assert rows(got.select("query_id", "graph_id", F.explode("rels").alias("r")).select("query_id", "graph_id", "r.*")) == rows(want) and want.count()
    assert rows(consistency.systematicity_of(got)) == rows(consistency.systematicity(want))
    assert _shuffles(verify_queries.QUERIES["k19_systematicity"](spark, _orders(spark, tmp_path))) <= 3


def test_likeness_of_neighbours_is_worked_out_in_their_rows(spark, tmp_path):
    d = _orders(spark, tmp_path)
    nodes, _, refs = verify_queries._tables(spark, d)
    pairs, mapping = verify_queries._neighbours(nodes)
    compared = verify_queries._compared(spark, d)
    fits = verify_queries.verify.role_fit(F.col("role"), F.col("role_c"))
    want = labels.node_affinity(pairs, nodes, refs, compared, fits, verify_queries.AFFINITY).groupBy("query_id", "graph_id").agg(F.count("*"), F.round(F.sum("affinity") + 1e-9, 4), F.round(F.max("affinity") + 1e-9, 6))
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = verify_queries.QUERIES["g5_affinity"](spark, d)
    assert _shuffles(got) <= 3
    assert rows(got) == rows(want) and want.count()
    packed = derived.beside(derived.graphs(derived.order_lines(spark, d), "label", "conf")).select("query_id", "graph_id", verify_queries._placed().alias("ms"), "q_ns", "c_ns")
    for twin, chosen in ((0.8, 0.4), (0.3, 0.9)):
        conflicts = labels.label_conflicts(kept(mapping), nodes, compared, twin, chosen)
        assert rows(labels.label_conflicts_of(packed, compared, twin, chosen)) == rows(conflicts) and conflicts.count()
    assert _shuffles(verify_queries.QUERIES["k16_label_identity"](spark, d)) <= 4


def test_concept_keys_are_made_in_a_graph_s_row(spark, tmp_path):
    d = _orders(spark, tmp_path)
    nodes, relations, classes, concepts = stream_queries._concepts(spark, d)
    related = lexicon.relatedness(spark)
    want = features.concept_fingerprints(features.paths(features.adjacency(nodes, relations), 2), nodes, classes, related)
    wide = kept(lexicon.widened(concepts, related))
    got = features.concept_keys_of(derived.graphs(derived.order_lines(spark, d).join(wide, "label"), "classes"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got.select("graph_id", F.explode("keys").alias("k")).select("graph_id", "k.*")) == rows(want) and want.count()
    assert _shuffles(stream_queries.QUERIES["f7_concept_fingerprints"](spark, d)) == 1


def test_starts_that_end_in_one_mapping_are_adjudicated_once(monkeypatch):
    some = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 5), (5, 5)):
        cost = some.random((n, m))
        got = kernel.assignment(cost)
        assert np.isclose(sum(cost[i, j] for i, j in enumerate(got)), min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n))) and len(set(got)) == n
    calls, real = [], kernel.adjudicate
    monkeypatch.setattr(kernel, "adjudicate", lambda a, b, pairs, *rest: calls.append(tuple(pairs)) or real(a, b, pairs, *rest))
    graph = kernel.Graph([(f"part {k}", "state", 1.0, True) for k in range(4)], [(k, k + 1, "causes", 1.0, "asserted", "actual") for k in range(3)])
    assert kernel.verify(graph, graph)[0] == [(k, k) for k in range(4)]
    assert len(calls) == len(set(calls))


def test_standing_is_worked_out_in_a_side_s_row(spark, tmp_path):
    d = _orders(spark, tmp_path)
    lines = derived.order_lines(spark, d)
    label, ends = {}, {}
    for r in derived.nodes(lines).collect():
        label[r["graph_id"], r["node"]] = r["label"]
    for r in derived.relations(lines).collect():
        ends.setdefault(r["graph_id"], set()).add((label[r["graph_id"], r["src"]], label[r["graph_id"], r["dst"]], r["type"], r["assertion"]))
    graphs = sorted({g for g, _ in label}) + [99]
    sides = [(0, a, a, b, b) for a in graphs for b in graphs if a != b]
    want = {}
    for _, a, _, b, _ in sides:
        mine, theirs = ({x for (g, _), x in label.items() if g == k} for k in (a, b))
        met = [(x, y) for x in ends.get(a, ()) for y in ends.get(b, ()) if x[:3] == y[:3]]
        want[a, b] = len(mine & theirs), sum(x == y for x, y in met), sum(x != y for x, y in met), len(mine - theirs), len(theirs - mine)
    given = spark.createDataFrame(sides, "topic long, viewer long, mine long, author long, theirs long")
    for got in (product.topic_standing(given, derived.nodes(lines), derived.relations(lines)), product.topic_standing_of(given, derived.graphs(lines, "label"))):
        assert {(r["viewer"], r["author"]): tuple(r)[3:] for r in got.collect()} == want
    assert any(x[1] for x in want.values()) or any(x[2] for x in want.values())
    assert _shuffles(product.topic_standing_of(given, derived.graphs(lines, "label"))) <= 6
