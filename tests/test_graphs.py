"""Graph operators on authored graphs."""

import pytest

from graphspan import plans
from graphspan.functions import lexicon, stem, text
from graphspan.operators import extract, features, index, kernel, labels, retrieve, validate, verify
from graphspan.plans import verify_queries
from graphspan.sources import derived, fixtures, scratch, storage
from pyspark.sql import functions as F

NODES = "graph_id long, node int, label string, role string, conf double, atomic boolean"
RELS = "graph_id long, rel int, src int, dst int, type string, assertion string, modality string, conf double"


def chain(g, roles, types, labels=None, conf=0.95):
    nodes = [(g, i, (labels or [f"thing {i}"] * len(roles))[i], r, conf, False) for i, r in enumerate(roles)]
    return nodes, [(g, i, i, i + 1, t, "asserted", "actual", conf) for i, t in enumerate(types)]


@pytest.fixture(scope="module")
def tables(spark):
    nodes, rels = [], []
    for g in range(6):
        n, r = chain(g, ["problem", "mechanism", "outcome", "state"][: 3 + g % 2], ["causes", "prevents", "requires"][: 2 + g % 2])
        nodes += n
        rels += r
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(rels, RELS)


def test_paths_are_shortest_and_least(tables):
    nodes, rels = tables
    got = {(r["graph_id"], r["a"], r["b"]): (r["hops"], r["path"]) for r in features.paths(features.adjacency(nodes, rels)).collect()}
    assert got[0, 0, 1] == (1, "+causes/asserted") and got[0, 1, 0] == (1, "-causes/asserted")
    assert got[0, 0, 2] == (2, "+causes/asserted\u0001+prevents/asserted") and got[1, 3, 0][0] == 3 and (0, 0, 3) not in got


def test_equal_graphs_share_keys_shapes_and_fingerprints(tables):
    nodes, rels = tables
    keys = {}
    for r in features.keysets(features.multi_fingerprints(nodes, rels)).collect():
        keys.setdefault(r["graph_id"], set()).add(r["key"])
    assert keys[0] == keys[2] != keys[1]
    shapes = {r["graph_id"]: r["signature"] for r in features.shape_signatures(nodes, rels).collect()}
    assert shapes[0] == shapes[4] and shapes[1] == shapes[3] != shapes[0]
    renamed = nodes.withColumn("node", 9 - F.col("node")), rels.withColumns({"src": 9 - F.col("src"), "dst": 9 - F.col("dst")})
    again = {r["graph_id"]: r["signature"] for r in features.shape_signatures(*renamed).collect()}
    assert again == shapes


def test_stop_rule_needs_a_corpus(spark):
    rows = spark.createDataFrame([(g, "all") for g in range(30)] + [(0, "one")], "graph_id long, key string")
    got = {r["key"]: r["stop"] for r in index.key_stats(rows, 30).collect()}
    assert got == {"all": True, "one": False}
    assert not any(r["stop"] for r in index.key_stats(rows.filter("graph_id < 10"), 10).collect())


def test_greedy_is_one_to_one(spark):
    rows = spark.createDataFrame([(1, 2, 0, 0, 5.0), (1, 2, 0, 1, 4.0), (1, 2, 1, 0, 3.0), (1, 2, 1, 1, 1.0)], "query_id long, graph_id long, q int, c int, support double")
    seeds = retrieve.greedy(rows).first()["seeds"]
    assert [(s["q"], s["c"]) for s in seeds] == [(0, 0), (1, 1)]


def test_components_by_fold(spark):
    rels = spark.createDataFrame([(1, 0, 0, 1, "causes"), (1, 1, 2, 3, "causes"), (1, 2, 1, 2, "causes"), (1, 3, 7, 8, "causes")], "graph_id long, rel int, src int, dst int, type string")
    assert sorted(sorted(r["component"]) for r in features.connected_relations(rels).collect()) == [[0, 1, 2, 3], [7, 8]]


def test_validation_reports_each_fault(spark):
    got = {}
    for r in validate.issues(fixtures.graphs(spark)).collect():
        got.setdefault(r["thought_id"], []).append(r["path"])
    assert "good" not in got and "shuffled" not in got
    assert got["bad-role"] == ["nodes[1].role"] and got["moved-span"] == ["nodes[0].spans"] and got["dangling"] == ["relations[0].target"]
    assert got["bad-sha"] == ["source.sha256"] and got["manual"] == ["provenance.kind"]


def test_canonical_form_ignores_order(spark):
    same = fixtures.records()[:2]
    df = spark.createDataFrame([r | {"thought_id": "x"} for r in same], fixtures.GRAPH)
    assert validate.canonical(df).select("sha").distinct().count() == 1


def test_index_fails_closed(spark, tables, tmp_path):
    nodes, rels = tables
    prints = features.multi_fingerprints(nodes, rels)
    corpus = features.thought_fingerprint(nodes, rels).select("graph_id", F.col("fingerprint").alias("sha"))
    path = str(tmp_path / "index")
    storage.dump_index(prints, index.key_stats(features.keysets(prints), 6), corpus, path)
    assert storage.load_index(spark, corpus, path)[0].count() == prints.count()
    with pytest.raises(storage.IndexMismatch):
        storage.load_index(spark, corpus.filter("graph_id > 0"), path)


def graph(roles, rels, labels):
    return kernel.Graph([(labels[i], r, 0.95, False) for i, r in enumerate(roles)], [(a, b, t, 0.95, "asserted", "actual") for a, b, t in rels])


A = graph(["problem", "mechanism", "outcome", "state"], [(0, 1, "causes"), (1, 2, "prevents"), (2, 3, "requires")], ["heat load", "pump friction", "steady output", "oil level"])


def test_assignment_is_optimal():
    import itertools

    import numpy as np

    r = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 6)):
        for _ in range(20):
            cost = r.normal(size=(n, m))
            got = kernel.assignment(cost)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            assert len(set(got)) == n and abs(sum(cost[i, j] for i, j in enumerate(got)) - best) < 1e-9


def test_verifier_finds_isomorphs_and_rejects_flipped_signs():
    order = [2, 0, 3, 1]
    at = {old: new for new, old in enumerate(order)}
    shuffled = kernel.Graph([A.nodes[i] for i in order], sorted((at[s], at[t], *rest) for s, t, *rest in A.relations))
    mapping, got = kernel.verify(A, shuffled)
    assert mapping == sorted((i, at[i]) for i in range(4)) and got["structural"] > 0.9 and got["contradiction"] == 0
    flipped = graph(["problem", "mechanism", "outcome", "state"], [(0, 1, "prevents"), (1, 2, "prevents"), (2, 3, "requires")], [n[0] for n in A.nodes])
    _, got = kernel.verify(A, flipped)
    assert got["h_sign_conflict"] and got["structural"] == 0
    assert kernel.verify(A, shuffled) == kernel.verify(A, shuffled)
    mapping, got = kernel.verify(A, shuffled, solver="rrwm")
    assert len(mapping) == 4 and got["structural"] > 0.9
    assert kernel.verify(A, kernel.Graph([], []))[0] == []


def test_guarded_path_explains_a_cause():
    a = graph(["problem", "outcome"], [(0, 1, "causes")], ["heat", "wear"])
    b = graph(["problem", "mechanism", "outcome"], [(0, 1, "causes"), (1, 2, "causes")], ["heat", "rub", "wear"])
    got = kernel.adjudicate(a, b, [(0, 0), (1, 2)])
    assert got["paths"] == [(0, (0, 1), 0.95)] and got["r_path"] == pytest.approx(1.0)


def test_joins_agree_with_the_kernel(spark, tables):
    nodes, rels = tables
    pairs = spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "query_id long, graph_id long")
    mapping = pairs.join(nodes.select(F.col("graph_id").alias("query_id"), F.col("node").alias("q")), "query_id").join(nodes.select("graph_id", F.col("node").alias("c")), "graph_id").filter("q = c")
    rows = {(r["query_id"], r["graph_id"]): r for r in verify.adjudicate(pairs, mapping, nodes, rels).collect()}
    packed = {r["graph_id"]: r for r in verify.packed(nodes, rels).collect()}
    for (q, c), r in rows.items():
        a, b = (verify._graph(packed[x]["nodes"], packed[x]["relations"], [], []) for x in (q, c))
        got = kernel.adjudicate(a, b, [(i, i) for i in range(min(len(a.nodes), len(b.nodes)))], with_paths=False)
        assert r["n_role"] == pytest.approx(got["n_role"]) and r["r_direct"] == pytest.approx(got["r_direct"]) and r["n_preserved"] == len(got["preserved"])


def test_stems():
    assert [stem.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "plastered", "generalizations", "oscillators", "sky", "happy")] == ["caress", "poni", "relat", "hop", "agre", "plaster", "gener", "oscil", "sky", "happi"]
    assert stem.stem("важная") == "важн" and stem.stem("насосы") == stem.stem("насоса") == "насос"


def test_lexicon_takes_the_longest_phrase(spark):
    labels = spark.createDataFrame([("communication gaps in testing",), ("heat",), ("nothing here",)], "label string")
    got = {r["label"]: r["concepts"] for r in lexicon.label_concepts(labels).collect()}
    assert got == {"communication gaps in testing": ["COMMUNICATION_GAP", "TESTING"], "heat": ["HEAT"], "nothing here": []}


def test_scrub_and_surface(spark):
    row = spark.createDataFrame([("mail bob@x.example or call +1 555 123 4567 now, see https://a.b/c",)], "t string").select(text.scrub(F.col("t")).alias("s")).first()
    assert row["s"] == "mail [redacted] or call [redacted] now, see [redacted]"
    pair = spark.createDataFrame([("heat pump", "heat pump"), ("heat", "cold")], "label_a string, label_b string")
    got = {r["label_b"]: r["surface"] for r in labels.compare(pair, labels.features(pair.selectExpr("explode(array(label_a, label_b)) AS label"))).collect()}
    assert got["heat pump"] == 1.0 and got["cold"] < 0.2


def test_extraction():
    got = extract.extract("Because the queue is full, requests fail. Cooling does not prevent wear.")
    assert [(r["type"], r["assertion"]) for r in got["relations"]] == [("causes", "asserted"), ("prevents", "negated")]
    assert extract.extract("") == extract.extract(None) and not extract.extract("Nothing at all.")["relations"]
    assert all(got["source"][n["start"] : n["end"]] == n["label"] for n in got["nodes"])


def test_token_buckets_by_fold_and_by_state(spark, tmp_path):
    from graphspan.streaming import standing

    rows = spark.sql("select id as event_id, id % 3 as user_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id*7) as ts, 'view' as event_type from range(120)")
    batch = {(r["user_id"], r["event_id"]): r["allowed"] for r in standing.token_buckets_batch(rows, 3, 1 / 60).collect()}
    level, at, expected = {}, {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["ts"]):
        u, now = r["user_id"], r["ts"].timestamp()
        level[u] = min(3, level.get(u, 3) + (now - at.get(u, now)) / 60)
        at[u] = now
        expected[u, r["event_id"]] = level[u] >= 1
        level[u] -= level[u] >= 1
    assert batch == expected
    rows.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))
    q = standing.token_buckets(stream, 3, 1 / 60).writeStream.format("memory").queryName("buckets").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["user_id"], r["event_id"]): r["allowed"] for r in spark.table("buckets").collect()} == expected


def test_standing_search_alerts_both_sides_once(spark, tmp_path):
    from graphspan.streaming import standing

    cols = "session_id long, user_id long, share_enabled boolean, share_thought boolean, revoked boolean, deleted boolean"
    sessions = spark.createDataFrame([(1, 10, True, True, False, False), (2, 20, True, True, False, False), (3, 30, True, True, True, False)], cols)
    arrivals = spark.createDataFrame([(1,), (1,)], "session_id long")
    arrivals.write.parquet(str(tmp_path / "in"))
    match = lambda df: df.selectExpr("session_id as query_id").crossJoin(spark.createDataFrame([(2, "analogical", None), (3, "direct", None), (1, "direct", None)], "graph_id long, classification string, hard_rejection string")).withColumn("detected_at", F.lit("2024-01-01"))
    for k in range(2):
        stream = spark.readStream.schema(arrivals.schema).parquet(str(tmp_path / "in"))
        standing.run_standing(stream, match, lambda: sessions, str(tmp_path / "alerts"), str(tmp_path / f"check{k}")).awaitTermination()
    got = sorted((r["user_id"], r["mine"], r["theirs"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "alerts")).collect())
    assert got == [(10, 1, 2, "you_shared"), (20, 2, 1, "they_arrived")]


def test_queries_and_oracles_are_named_alike():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(plans.QUERIES) > 100


def write_orders(spark, path, sizes):
    """lineitem and part of orders of given sizes: {id: lines}."""
    from datetime import date

    words = ["hot iron", "cold steel", "valve linen", "gear smoke", "bolt ivory", "plum navy", "hot valve"]
    parts = [(k, f"{words[k % 7]} {k % 5}", f"Brand#{k % 5}", f"TYPE {k % 6}", k) for k in range(40)]
    lines = [(g, (g * 3 + i * 7) % 40, (g + i * i) % 11, i + 1, float(5 + (g * 5 + i * 13) % 45), 100.0 + i, ((g + i) % 10) / 100, ((g + 2 * i) % 8) / 100, "R" if (g + i) % 5 == 0 else "N", "F", date(2024, 1, 1)) for g, n in sizes.items() for i in range(n)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize(("query", "solver"), [("k30_compare", "fgw"), ("k6_random_walks", "rrwm")])
def test_every_order_is_compared(spark, tmp_path, query, solver):
    """Orders of one, two and more than eight lines, and ids that nothing divides, against the kernel pair by pair."""
    sizes = {1: 1, 2: 2, 3: 11, 4: 3, 6: 4, 7: 9, 40: 5, 41: 1, 43: 4}
    d = write_orders(spark, tmp_path, sizes)
    got = {(r["query_id"], r["graph_id"]): (r["mapping"], round(r["structural"], 6)) for r in plans.QUERIES[query](spark, d).collect()}
    lines = derived.order_lines(spark, d)
    packed = {r["graph_id"]: verify._graph(r["nodes"], r["relations"], r["about"], r["requires"]) for r in verify.packed(derived.nodes(lines), derived.relations(lines), derived.knowledge(lines)).collect()}
    expected = {}
    for g in sizes:
        if g + 1 in sizes:
            mapping, scores = kernel.verify(packed[g], packed[g + 1], None, [], solver)
            expected[g, g + 1] = (",".join(f"{i}-{j}" for i, j in mapping), round(scores["structural"], 6))
    assert len(expected) == 5 and got == expected


def test_searches_ask_every_hundredth_order(spark, tmp_path, monkeypatch):
    """Every query that shares a key with another order, small ones among them; the same answers where no side is small enough
    to be broadcast."""
    sizes = {100 * g: 2 + g % 3 for g in range(1, 13)} | {g: 2 + g % 6 for g in range(1, 60)}
    d = write_orders(spark, tmp_path, sizes)
    got = sorted(map(tuple, plans.QUERIES["structural_top5"](spark, d).collect()))
    lines, keys = derived.order_lines(spark, d), {}
    for r in features.keysets(features.multi_fingerprints(derived.nodes(lines), derived.relations(lines))).collect():
        keys.setdefault(r["graph_id"], set()).add(r["key"])
    expected = {q for q in range(100, 1300, 100) if any(keys[q] & k for g, k in keys.items() if g != q)}
    assert len(expected) > 8 and {r[0] for r in got} == expected
    assert {r["query_id"] for r in plans.QUERIES["h5_coherent"](spark, d).select("query_id").collect()} == expected
    content = sorted(map(tuple, plans.QUERIES["h6_bm25"](spark, d).collect()))
    for module in (index, retrieve):
        monkeypatch.setattr(module, "lookup_join", lambda *a: scratch.lookup_join(*a, rows=0))
    assert sorted(map(tuple, plans.QUERIES["structural_top5"](spark, d).collect())) == got
    assert sorted(map(tuple, plans.QUERIES["h6_bm25"](spark, d).collect())) == content


def test_search_finds_by_concepts(spark, tmp_path, monkeypatch):
    """What only a class relates to the query is in the pool, with its seeds, and the kernel is told the classes."""
    nodes = [(100, 0, "hot mill", "state", 0.9, False), (1, 0, "hot iron", "state", 0.9, False), (2, 0, "plum navy", "problem", 0.9, False)] + [(g, 0, f"ivory {g}", "agent", 0.9, False) for g in range(3, 10)]
    nodes, rels = spark.createDataFrame(nodes, NODES), spark.createDataFrame([], RELS)
    refs = spark.createDataFrame([], "graph_id long, node int, bucket string, ref string")
    monkeypatch.setattr(verify_queries, "_tables", lambda *a: (nodes.withColumn("label", F.when(F.col("graph_id") == 1, "heat").otherwise(F.col("label"))), rels, refs))
    pools, real = [], verify.find
    monkeypatch.setattr(verify, "find", lambda pool, graphs, k: pools.append((pool, graphs)) or real(pool, graphs, k))
    hits = verify_queries.find(spark, "").collect()
    pool, graphs = pools[0]
    rows = [(r["query_id"], r["graph_id"], r["structural"], r["concept"], r["content"], [(s["q"], s["c"]) for s in r["seeds"]]) for r in pool.collect()]
    assert rows == [(100, 1, 0.0, 1.0, 0.0, [(0, 0)])]
    assert {r["graph_id"]: r["nodes"][0]["classes"] for r in graphs.collect()} == {1: ["HEAT"], 100: ["HEAT"]}  # what is in no pool isn't packed
    assert [(r["graph_id"], r["concept_alignment"]) for r in hits] == [(1, 1.0)]
