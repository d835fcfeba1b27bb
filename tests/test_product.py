"""Product and quality operators on small rows, against plain Python."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from graphspan.operators import product, quality


def test_throttle_follows_what_was_sent(spark):
    start = datetime(2024, 1, 1)
    hours = {1: [0, 5, 19.99, 20, 39, 40, 41], 2: [3], 3: [0, 0, 25]}
    rows = [(u, i * 10 + u, start + timedelta(hours=h)) for u, hs in hours.items() for i, h in enumerate(hs)] + [(None, 99, start), (4, 98, None)]
    got = {r["event_id"]: r["sent"] for r in product.throttle(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")).collect()}
    expected = {}
    for u, hs in hours.items():
        last = None
        for i, h in enumerate(hs):
            expected[i * 10 + u] = last is None or h - last >= 20
            last = h if expected[i * 10 + u] else last
    assert got == expected


def test_briefs_refuse_versions_without_a_predecessor(spark):
    rows = [(1, 0, "a", 1), (1, 0, "late", 2), (1, 1, "b", 3), (1, 3, "lost", 4), (2, 1, "nothing before", 5)]
    df = spark.createDataFrame(rows, "workspace long, expected long, body string, event_id long").withColumn("ts", F.col("event_id"))
    assert [tuple(r) for r in product.briefs(df).collect()] == [(1, 2, "b")]


def test_ends_by_id_and_by_label(spark):
    nodes = spark.createDataFrame([("t", "n0", "Heat"), ("t", "n1", "Load"), ("u", "n0", "Other")], "thought_id string, id string, label string")
    rows = [("t", "r0", "n0", "LOAD", "causes"), ("t", "r1", " heat ", "n0", "causes"), ("t", "r2", "n0", "other", "causes"), ("t", "r3", "n0", "n1", "likes"), ("u", "r4", "n9", "n0", "causes")]
    got = {r["id"]: (r["source_id"], r["target_id"], r["issue"]) for r in product.manual_relations(spark.createDataFrame(rows, "thought_id string, id string, source string, target string, type string"), nodes).collect()}
    assert got == {"r0": ("n0", "n1", None), "r1": ("n0", "n0", "loop"), "r2": ("n0", None, "target"), "r3": ("n0", "n1", "type"), "r4": (None, "n0", "source")}


def test_serving_fails_closed(spark):
    index = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "name string, generation int")
    assert [tuple(r) for r in product.servable(index, spark.createDataFrame([("a", 2)], "name string, generation int")).collect()] == [("a", 2)]
    assert product.servable(index, index.limit(0)).count() == 0


def test_metrics_of_empty_and_equal_sets(spark):
    schema = "case int, signature string"
    a, none = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], schema), spark.createDataFrame([], schema)
    assert {r["case"]: r["f1"] for r in quality.repeat_f1(a, a).collect()} == {1: 1.0, 2: 1.0}
    assert {r["case"]: r["f1"] for r in quality.repeat_f1(a, none).collect()} == {1: 0.0, 2: 0.0}
    assert {r["case"]: round(r["f1"], 3) for r in quality.repeat_f1(a, a.filter("signature <> 'y'")).collect()} == {1: 0.667, 2: 1.0}
    nodes = spark.createDataFrame([(1, "x", "state"), (1, "x", "agent"), (1, "w", "state")], "case int, label string, role string")
    got = quality.extraction_metrics(nodes, nodes.filter("role = 'agent'")).first()
    assert (got["precision"], got["recall"], got["f1"], got["role_accuracy"]) == (1.0, 0.3333, 0.5, 1.0)


def test_names_are_stable_and_known(spark):
    names = product.pseudonyms(spark.range(600).withColumnRenamed("id", "user_id")).withColumn("known", product.is_pseudonym(F.col("pseudonym")))
    assert names.filter("not known").count() == 0 and names.select("pseudonym").distinct().count() == 600
    assert spark.range(1).select(product.is_pseudonym(F.lit("Guest 7")).alias("x")).first()["x"] is False
