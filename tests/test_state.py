"""Keyed state and the table with versions: replays, caps, two writers."""

from datetime import datetime, timedelta

import pytest

from graphspan.sources import commits
from graphspan.streaming import keyed, standing

START = datetime(2024, 1, 1)


def drain(spark, tmp_path, turns, schema, build, out_schema, late=None):
    """Each turn is a folder that arrives; what the stream has written after all of them."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    with keyed.rocksdb(spark):
        for k, rows in enumerate(turns):
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/turn={k}")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/turn=*")
            build(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return sorted(tuple(r) for r in spark.read.schema(out_schema).parquet(f"{tmp_path}/out").collect())


def test_alerts_are_told_once_and_capped(spark, tmp_path):
    schema = "user_id long, peer long, mine long, theirs long, detected_at timestamp, hard_rejection string, classification string, shape long"
    row = lambda u, p, m, t, h, hard=None, c="analogical", s=0: (u, p, m, t, START + timedelta(hours=h), hard, c, s)
    one = [row(1, 2, 10, 20, 5), row(1, 2, 10, 20, 3), row(1, 2, 10, 21, 4), row(1, 1, 10, 22, 0), row(1, 3, 10, 23, 0, "sign"), row(1, 3, 10, 24, 0, None, "Negative"), row(1, 9, 10, 25, 0), row(1, 3, 10, 26, 0, s=7), row(2, 1, 20, 10, 5)]
    two = [row(1, 2, 11, 30 + k, 10 - k) for k in range(5)]
    blocks = spark.createDataFrame([(1, 9), (3, 1)], "user_id long, peer long")
    habits = spark.createDataFrame([(7,)], "shape long")
    got = drain(spark, tmp_path, [one, one, two, two], schema, lambda s: keyed.alert_stream(s, blocks, habits, cap=4), "user_id long, mine long, theirs long, detected_at timestamp")
    at = lambda h: START + timedelta(hours=h)
    assert got == sorted([(1, 10, 20, at(3)), (1, 10, 21, at(4)), (1, 11, 34, at(6)), (1, 11, 33, at(7)), (2, 20, 10, at(5))])


def test_grants_open_once_and_run_out(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    one = [(1, 1, at(0), "code"), (1, 2, at(299), ""), (1, 3, at(299), ""), (2, 4, at(0), "code"), (2, 5, at(300), ""), (3, 6, at(5), ""), (4, 7, at(0), "code"), (4, 8, at(10), "token"), (4, 9, at(3000), ""), (5, 10, at(0), "refresh")]
    two = [(5, 11, at(29 * 86400), ""), (6, 12, at(40 * 86400), "token"), (2, 13, at(40 * 86400), "")]
    three = [(6, 14, at(40 * 86400 + 3599), ""), (5, 15, at(40 * 86400 + 5), "")]
    got = drain(spark, tmp_path, [one, two, three], "user_id long, event_id long, ts timestamp, kind string", keyed.grant_stream, "user_id long, event_id long, granted boolean")
    assert {e: g for _, e, g in got} == {2: True, 3: False, 5: False, 6: False, 9: True, 11: True, 13: False, 14: True, 15: False}


def test_replays_and_conflicts(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    one = [(1, 2, at(5), "b"), (1, 1, at(0), "a"), (2, 3, at(0), "a")]
    two = [(1, 4, at(9), "a"), (2, 5, at(9), "c"), (3, 6, at(9), "x")]
    got = drain(spark, tmp_path, [one, two], "request_id long, event_id long, ts timestamp, payload string", lambda s: keyed.replay_guard(s, 3600), "request_id long, event_id long, payload string, outcome string")
    assert {r[1]: r[3] for r in got} == {1: "first", 2: "conflict", 3: "first", 4: "replay", 5: "conflict", 6: "first"}


def test_one_of_two_writers_is_refused(spark, tmp_path):
    t = commits.Versioned(spark, str(tmp_path / "t"), "id", "id bigint, state string")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, state string, expected long")
    state = lambda g=None: sorted(tuple(r) for r in t.state(g).collect())
    assert t.generation() == 0 and state() == []
    assert t.commit(rows((1, "a", 0), (2, "b", 0)), request="r1") == 1
    assert t.commit(rows((2, "b", 0), (1, "a", 0)), request="r1") == 1 == t.generation()  # a replay
    with pytest.raises(commits.Conflict):
        t.commit(rows((1, "z", 1)), request="r1")
    with pytest.raises(commits.Conflict) as refused:
        t.commit(rows((1, "c", 0), (2, "c", 1), (3, "c", 1)))
    assert refused.value.refused == 2 and state() == [(1, "a", 1), (2, "b", 1)]
    # both have read generation 1; the second one to publish finds it gone, also if it hasn't looked again
    assert t.commit(rows((1, "first", 1)), seen=1) == 2
    with pytest.raises(commits.Conflict):
        t.commit(rows((2, "second", 1)), seen=1)
    other = commits.Versioned(spark, t.path, "id", t.schema)
    other.log = lambda known=t.log(): known
    assert t.commit(rows((2, "third", 1))) == 3
    with pytest.raises(commits.Conflict, match="another writer"):
        other.commit(rows((2, "late", 1)))
    assert state() == [(1, "first", 2), (2, "third", 2)] and state(1) == [(1, "a", 1), (2, "b", 1)]
    assert sorted(tuple(r) for r in t.audit().collect()) == [(1, 1, "insert", 1), (1, 2, "update", 2), (2, 1, "insert", 1), (2, 2, "update", 3)]
    with pytest.raises(commits.Conflict):
        t.commit(rows((3, "x", 0), (3, "y", 0)))


def test_serving_is_of_the_last_generation(spark, tmp_path):
    t = commits.Versioned(spark, str(tmp_path / "t"), "id", "id bigint, state string")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, state string, expected long")
    served = commits.Served(t)
    assert served.read() is None
    t.commit(rows((1, "a", 0)))
    assert served.publish(t.state(), 1) and served.read().count() == 1
    t.commit(rows((2, "a", 0)))
    assert served.read() is None and not served.publish(t.state(1), 1) and served.read() is None
    assert served.publish(t.state(), 2) and served.read().count() == 2


def test_folds_against_loops(spark):
    hours = [0, 0.1, 0.2, 0.3, 0.4, 0.5, 3, 3.1, 30, 30, 30]
    events = spark.createDataFrame([(1, k, START + timedelta(hours=h)) for k, h in enumerate(hours)] + [(None, 99, START), (2, 50, None), (3, 60, START)], "user_id long, event_id long, ts timestamp")
    got = {r["event_id"]: r["allowed"] for r in standing.sliding_limit(events, most=2, seconds=3600).collect()}
    log, want = [], {60: True}
    for k, h in enumerate(hours):
        log = [x for x in log if x > h - 1]
        want[k] = len(log) < 2
        log += [h] * want[k]
    assert got == want
    level, last, want = 5.0, 0.0, {60: True}
    for k, h in enumerate(hours):
        level, last = min(5.0, level + (h - last)), h
        want[k] = level >= 1
        level -= want[k]
    assert {r["event_id"]: r["allowed"] for r in standing.token_buckets_batch(events).collect()} == want
