"""Queries over sessions, users and event logs, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import sessions as ops
from ..operators import validate
from ..sources import derived


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return derived.sessions(spark, d)


def a6_discoverable(spark, d):
    return ops.discoverable(_sessions(spark, d)).select("session_id", "user_id", "created_at")


def a7_lookup(spark, d):
    return _sessions(spark, d).filter("session_id = 7").select("session_id", "user_id", "region", "record_kind")


def a8_ordered_scan(spark, d):
    """Every user's sessions by their place in order of time and id."""
    order = Window.partitionBy("user_id").orderBy("created_at", "session_id")
    return _sessions(spark, d).select("user_id", "session_id", "created_at", F.row_number().over(order).cast("long").alias("place"))


def a9_upsert(spark, d):
    orders = derived.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("version"), F.col("o_orderstatus").alias("state"))
    changes = orders.filter("id % 5 = 0").select("id", F.lit(2).alias("version"), F.lit("X").alias("state")).unionByName(orders.filter("id % 7 = 0").select("id", F.lit(1).alias("version"), F.lit("lost").alias("state")))
    return ops.upsert(orders, changes, "id", "version")


def a12_chain_filler(spark, d):
    """Synthetic chains: 200 graphs of 2 to 6 nodes from a seedless rule."""
    g = spark.range(200).select(F.col("id").alias("graph_id"), (F.col("id") % 5 + 2).alias("size"))
    return g.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("node")).select("graph_id", "node", F.concat(F.lit("filler "), ((F.col("graph_id") * 31 + F.col("node") * 7) % 97).cast("string")).alias("label"))


def b8_session_issues(spark, d):
    return validate.session_issues(_sessions(spark, d))


def b9_corpus_checks(spark, d):
    return validate.corpus_checks(_sessions(spark, d))


def b10_projection(spark, d):
    rows = _sessions(spark, d)
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & scalar.is_coarse(F.col("lat")) & scalar.is_coarse(F.col("lon")) & (F.length(F.trim("city")) > 0)
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("valid"))


def c1_share_state(spark, d):
    return _sessions(spark, d).select("session_id", ops.share_state().alias("state"))


def c2_visible(spark, d):
    return ops.visible(_sessions(spark, d), derived.users(spark, d)).select("session_id", "user_id")


def c3_presentation(spark, d):
    return ops.presentation(_sessions(spark, d), derived.users(spark, d))


def c5_allow_list(spark, d):
    rows = _sessions(spark, d)
    return ops.discoverable(rows).select("session_id", F.when(F.col("share_profile"), F.col("user_id").cast("string")).alias("user_id"), F.when(F.col("share_location"), F.col("region")).alias("region"), "record_kind")


def blocks(spark, d) -> DataFrame:
    """Block events between customers, from the event log: a user and one a rule away, blocked by errors, freed by views."""
    e = derived.table(spark, d, "events").filter("event_type in ('error', 'view')")
    return e.select(F.col("user_id").alias("user_a"), ((F.col("user_id") * 7 + 3) % 150 + 1).alias("user_b"), (F.col("event_type") == "error").alias("blocked"), "ts", "event_id").filter("user_a <> user_b")


def i5_latest_block(spark, d):
    return ops.latest_blocks(blocks(spark, d))


def _rows_for(spark, d, viewer: int) -> DataFrame:
    last = ops.latest_blocks(blocks(spark, d)).filter((F.col("low") == viewer) | (F.col("high") == viewer)).select(F.when(F.col("low") == viewer, F.col("high")).otherwise(F.col("low")).alias("user_id"), "blocked")
    rows = _sessions(spark, d).withColumn("habit", F.col("session_id") % 13 == 0)
    return rows.join(F.broadcast(last), "user_id", "left")  # the blocks of one viewer


def c6_drop_reasons(spark, d):
    return _rows_for(spark, d, 11).groupBy(F.coalesce(ops.drop_reason(F.lit(11)), F.lit("shown")).alias("reason")).agg(F.count("*").alias("n"))


def c6_project_rows(spark, d):
    return ops.project_rows(_rows_for(spark, d, 11), F.lit(11), F.lit(48.1), F.lit(11.6))


def c7_semi_join_registry(spark, d):
    """Hits kept if their session is registered, in their order."""
    hits = derived.table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.row_number().over(_by_price()).alias("rank"))
    return hits.join(ops.discoverable(_sessions(spark, d)).select("session_id"), "session_id", "left_semi").select("session_id", "rank")


def _by_price():
    return Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")


def c9_audit_filter(spark, d):
    e = derived.table(spark, d, "events")
    return e.filter(~F.col("event_type").startswith("err")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def c10_near_misses(spark, d):
    """Of hits that aren't rejected, the five of highest similarity at 0.4 or more, for customers without a better one."""
    hits = derived.table(spark, d, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("graph_id"), F.round((F.col("o_totalprice") % 1000) / 1000, 6).alias("semantic"), (F.col("o_orderstatus") == "F").alias("hard"),
        F.when(F.substring("o_orderpriority", 1, 1) == "1", "approximate").when(F.substring("o_orderpriority", 1, 1) == "2", "").otherwise("negative").alias("classification"),
    )
    return ops.near_misses(hits)


def c12_live_participants(spark, d):
    return ops.discoverable(_sessions(spark, d)).filter("record_kind = 'volunteer'").select("session_id")


def e1_haversine(spark, d):
    rows = _sessions(spark, d)
    km = scalar.haversine(F.lit(48.1), F.lit(11.6), F.col("lat"), F.col("lon"))
    return rows.select("session_id", F.round(km, 4).alias("km"), scalar.distance_bucket(km).alias("bucket"))


def e2_buckets(spark, d):
    km = scalar.haversine(F.lit(48.1), F.lit(11.6), F.col("lat"), F.col("lon"))
    return _sessions(spark, d).groupBy(scalar.distance_bucket(km).alias("bucket")).agg(F.count("*").alias("n"), F.max(scalar.coarse_km(F.round(km, 3))).alias("farthest"))


def e4_projection(spark, d):
    x, y = scalar.equirectangular(F.col("lat"), F.col("lon"), 960.0, 480.0)
    return _sessions(spark, d).select("session_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def e5_gate(spark, d):
    li = derived.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_discount").alias("m"))
    return li.select("l_orderkey", F.round(scalar.gate(F.col("n"), F.col("m") * 20), 6).alias("gate"), F.round(scalar.clamp(F.col("m") * 3 - 0.2), 6).alias("clamped"))


def e6_span_iou(spark, d):
    rows = derived.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 20).alias("a"), (F.col("o_orderkey") % 20 + 10).alias("b"), (F.col("o_custkey") % 20).alias("c"), (F.col("o_custkey") % 20 + 8).alias("e"))
    iou = scalar.span_iou(F.col("a"), F.col("b"), F.col("c"), F.col("e"))
    return rows.select("o_orderkey", F.round(iou, 6).alias("iou"), (iou >= 0.5).alias("merged"))


def e7_set_f1(spark, d):
    li = derived.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 10).alias("a"), F.collect_set(F.col("l_suppkey") % 10).alias("b"))
    return li.select("l_orderkey", F.round(scalar.set_f1(F.col("a"), F.col("b")), 6).alias("f1"))


def e8_percentile(spark, d):
    return derived.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("p50"), F.round(F.percentile("o_totalprice", 0.95), 4).alias("p95"))


def e9_recency(spark, d):
    return _sessions(spark, d).groupBy("user_id").agg(F.date_format(F.max("created_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last"))


def e10_json(spark, d):
    e = derived.table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("p.k").alias("n"))


def h9_region_buckets(spark, d):
    return ops.region_buckets(ops.discoverable(_sessions(spark, d)))


def h10_suppressed(spark, d):
    return ops.suppress_small(ops.discoverable(_sessions(spark, d)), 3).select("region", "n", "intensity", F.col("suppressed").cast("long"))


def h11_kinds(spark, d):
    return _sessions(spark, d).groupBy("record_kind").agg(F.count("*").alias("n"), F.sum(F.col("revoked").cast("long")).alias("revoked"))


def h17_generation(spark, d):
    s = _sessions(spark, d).groupBy("user_id").agg(F.count("*").alias("versions"))
    e = derived.table(spark, d, "events").filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("policy"))
    return s.join(e, "user_id", "left").select("user_id", (F.col("versions") + F.coalesce("policy", F.lit(0))).alias("generation"))


def i2_distractor_rank(spark, d):
    rows = derived.table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("graph_id"), "o_totalprice", (F.col("o_orderstatus") == "O").alias("relevant"))
    w = Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "graph_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("query_id", "graph_id", "relevant", (F.coalesce(F.sum((~F.col("relevant")).cast("long")).over(w), F.lit(0)) + 1).alias("rank")).filter("relevant")


def i6_latest_contribution(spark, d):
    e = derived.table(spark, d, "events").filter("event_type = 'purchase'")
    return ops.latest(e, ["user_id"], ["event_id", "value"], ["ts", "event_id"])


def i7_most_recent_share(spark, d):
    return ops.latest(ops.discoverable(_sessions(spark, d)), ["user_id"], ["session_id"], ["created_at", "session_id"])


def intros(spark, d) -> DataFrame:
    """Introductions: a click asks, the next purchase of the user accepts, an error declines, a view cancels."""
    kind = F.when(F.col("event_type") == "click", "requested").when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "declined").otherwise("cancelled")
    return derived.table(spark, d, "events").filter("event_type <> 'signup'").select((F.col("user_id") * 10 + F.dayofmonth("ts") % 10).alias("intro_id"), "user_id", kind.alias("kind"), "ts", "event_id")


def n2_intro_states(spark, d):
    return ops.intro_states(intros(spark, d)).select("intro_id", "state")


def g12_latest_between(spark, d):
    rows = derived.table(spark, d, "events").select(F.col("event_id").alias("intro_id"), F.col("user_id").alias("user_a"), (F.col("event_id") % 37 + 1).alias("user_b"), F.col("event_type").alias("state"), "ts").filter("user_a <> user_b")
    return ops.latest_between(rows)


def g11_members(spark, d):
    c = derived.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = derived.table(spark, d, "nation").select("n_nationkey", "n_name")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("members"))


def g13_accepted_pairs(spark, d):
    rows = derived.table(spark, d, "events").filter("event_type = 'purchase'")
    pair = lambda a, b: (F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    return rows.select(*pair(F.col("user_id"), F.col("event_id") % 37 + 1)).distinct()


def n7_authorisation(spark, d):
    o = derived.table(spark, d, "orders")
    action = F.element_at(F.array(*[F.lit(a) for a in ("discover", "intro", "message", "workspace", "other")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    flag = lambda m: F.col("o_custkey") % m == 0
    rows = o.select("o_orderkey", action.alias("action"), flag(11).alias("is_owner"), flag(7).alias("blocked"), flag(2).alias("discoverable"), flag(3).alias("accepted"), flag(5).alias("is_member"))
    return ops.authorised(rows).select("o_orderkey", "action", "decision")


def n8_reserved_ids(spark, d):
    """Thought ids of more than one session, deleted ones counted."""
    return _sessions(spark, d).groupBy(F.sha2(F.concat_ws("|", "user_id", F.to_date("created_at").cast("string")), 256).alias("thought_id")).agg(F.count("*").alias("sessions"), F.sum(F.col("deleted").cast("long")).alias("deleted")).filter("sessions > 1")


def n9_user_revoke(spark, d):
    s, u = _sessions(spark, d), derived.users(spark, d)
    return s.join(u, "user_id").select("session_id", (F.col("revoked") | F.col("hidden")).alias("revoked"))


def l11_idempotency(spark, d):
    e = derived.table(spark, d, "events").select((F.col("event_id") % 4000).alias("request_id"), F.sha2(F.concat_ws("|", "event_type", (F.col("event_id") % 3).cast("string")), 256).alias("payload_sha"), "ts", "event_id")
    return ops.idempotency_conflicts(e)


def _alert_pairs(spark, d) -> DataFrame:
    e = derived.table(spark, d, "events")
    return e.select("user_id", (F.col("event_id") % 60 + 1).alias("mine"), (F.col("event_id") % 45 + 1).alias("theirs"), F.col("ts").alias("detected_at"))


def j7_alerts(spark, d):
    return ops.alerts(_alert_pairs(spark, d), cap=20)


def l4_pending(spark, d):
    s = _sessions(spark, d)
    mine = ops.discoverable(s).select(F.col("session_id").alias("mine"), F.col("user_id"), "created_at")
    stored = mine.select("user_id", "mine", (F.col("mine") + 5).alias("theirs"), F.col("created_at").alias("detected_at"))
    return ops.pending(stored, s, ops.latest_blocks(blocks(spark, d)))


def l9_cursor(spark, d):
    """What came after a reader's cursor, at most the last 25 for each author."""
    e = derived.table(spark, d, "events").filter(F.struct("ts", "event_id") > F.struct(F.lit("2024-01-10 00:00:00").cast("timestamp").alias("ts"), F.lit(100).cast("long").alias("event_id")))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("n", F.row_number().over(w)).filter("n <= 25").select("user_id", "event_id", "n")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "abceghijln" and k[1:2].isdigit()}

SESSIONS = """
s AS (
  SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderdate AS created_at, o_orderstatus <> 'P' AS share_enabled, o_orderpriority[1] <> '5' AS share_thought, o_orderpriority[1] <= '2' AS share_location, o_orderstatus = 'O' AS share_profile,
    o_orderkey % 17 = 0 AS revoked, o_orderkey % 23 = 0 AS deleted, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'volunteer' WHEN c_mktsegment = 'AUTOMOBILE' THEN '' ELSE 'demo' END AS record_kind,
    n_name AS city, r_name AS region, round_even(n_nationkey * 6.7::DOUBLE - 80, 1) AS lat, round_even(n_nationkey * 13.3::DOUBLE - 160, 1) AS lon, c_name AS name, c_acctbal < 0 AS hidden
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), disc AS (SELECT * FROM s WHERE share_enabled AND share_thought AND NOT revoked AND NOT deleted)"""
KM = "2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(lat - 48.1) / 2), 2) + cos(radians(48.1)) * cos(radians(lat)) * power(sin(radians(lon - 11.6) / 2), 2))))"
BUCKET = f"CASE WHEN {KM} <= 300 THEN 'near' WHEN {KM} <= 1500 THEN 'regional' ELSE 'far' END"
BLOCKS = """
blocks AS (SELECT low, high, arg_max(blocked, (ts, event_id)) AS blocked FROM (
  SELECT least(user_id, (user_id * 7 + 3) % 150 + 1) AS low, greatest(user_id, (user_id * 7 + 3) % 150 + 1) AS high, event_type = 'error' AS blocked, ts, event_id FROM events WHERE event_type IN ('error', 'view') AND user_id <> (user_id * 7 + 3) % 150 + 1) GROUP BY ALL)"""
VIEW = f"""WITH {SESSIONS}, {BLOCKS}, peers AS (SELECT CASE WHEN low = 11 THEN high ELSE low END AS user_id, blocked FROM blocks WHERE low = 11 OR high = 11),
seen AS (SELECT s.*, CASE WHEN s.user_id = 11 THEN 'own' WHEN coalesce(blocked, false) THEN 'blocked' WHEN revoked OR deleted THEN 'withdrawn' WHEN NOT (share_enabled AND share_thought) THEN 'not shared' WHEN session_id % 13 = 0 THEN 'habit' END AS reason FROM s LEFT JOIN peers p ON p.user_id = s.user_id)"""
_S = f"WITH {SESSIONS}"

ORACLES = {
    "a6_discoverable": f"{_S} SELECT session_id, user_id, created_at FROM disc",
    "a7_lookup": f"{_S} SELECT session_id, user_id, region, record_kind FROM s WHERE session_id = 7",
    "a8_ordered_scan": f"{_S} SELECT user_id, session_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at, session_id) AS place FROM s",
    "a9_upsert": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS state FROM orders",
    "a12_chain_filler": "SELECT g AS graph_id, n AS node, 'filler ' || ((g * 31 + n * 7) % 97) AS label FROM (SELECT g, unnest(generate_series(0, g % 5 + 1)) AS n FROM range(200) t(g))",
    "b8_session_issues": f"""{_S} SELECT session_id, issue FROM (SELECT session_id, unnest([CASE WHEN NOT regexp_matches(CAST(session_id AS VARCHAR), '^(ses-)?[a-z0-9-]+$') THEN 'id' END, CASE WHEN share_thought AND NOT share_enabled THEN 'thought without sharing' END,
  CASE WHEN round_even(lat, 1) <> lat OR round_even(lon, 1) <> lon THEN 'precise location' END, CASE WHEN abs(lat) > 90 OR abs(lon) > 180 THEN 'location out of range' END, CASE WHEN record_kind = '' THEN 'record kind' END]) AS issue FROM s) WHERE issue IS NOT NULL""",
    "b9_corpus_checks": f"{_S} SELECT count(*) AS rows, count(DISTINCT user_id) AS people, count(*) - count(DISTINCT session_id) AS repeated, count(*) BETWEEN 20 AND 50 AND count(DISTINCT user_id) >= 8 AND count(*) = count(DISTINCT session_id) AS valid FROM s",
    "b10_projection": f"{_S} SELECT region, count(*) AS n, CAST(sum(CAST(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND round_even(lat, 1) = lat AND round_even(lon, 1) = lon AND length(trim(city)) > 0 AS INT)) AS BIGINT) AS valid FROM s GROUP BY region",
    "c1_share_state": f"{_S} SELECT session_id, CASE WHEN deleted THEN 'deleted' WHEN revoked THEN 'revoked' WHEN share_enabled AND share_thought THEN 'discoverable' ELSE 'hidden' END AS state FROM s",
    "c2_visible": f"{_S} SELECT session_id, user_id FROM disc WHERE NOT hidden",
    "c3_presentation": f"{_S} SELECT session_id, CASE WHEN share_profile THEN name ELSE 'anonymous' END AS display, CASE WHEN share_location THEN city END AS city, CASE WHEN share_location THEN region END AS region, CASE WHEN share_location THEN lat END AS lat, CASE WHEN share_location THEN lon END AS lon FROM s",
    "c5_allow_list": f"{_S} SELECT session_id, CASE WHEN share_profile THEN CAST(user_id AS VARCHAR) END AS user_id, CASE WHEN share_location THEN region END AS region, record_kind FROM disc",
    "c6_drop_reasons": f"{VIEW} SELECT coalesce(reason, 'shown') AS reason, count(*) AS n FROM seen GROUP BY 1",
    "c6_project_rows": f"{VIEW} SELECT session_id, user_id, CASE WHEN share_location THEN region END AS region, CASE WHEN share_location THEN round_even({KM}, -1) END AS km, CASE WHEN share_location THEN {BUCKET} END AS distance FROM seen WHERE reason IS NULL",
    "c7_semi_join_registry": f"{_S}, hits AS (SELECT o_orderkey AS session_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT session_id, rank FROM hits WHERE session_id IN (SELECT session_id FROM disc)",
    "c9_audit_filter": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE NOT starts_with(event_type, 'err') GROUP BY event_type",
    "c10_near_misses": """WITH hits AS (SELECT o_custkey AS query_id, o_orderkey AS graph_id, round((o_totalprice % 1000) / 1000, 6) AS semantic, o_orderstatus = 'F' AS hard, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'approximate' WHEN '2' THEN '' ELSE 'negative' END AS classification FROM orders)
SELECT * FROM (SELECT query_id, graph_id, semantic, CAST(row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, graph_id) AS INT) AS n FROM hits h WHERE NOT hard AND semantic >= 0.4
  AND NOT EXISTS (SELECT 1 FROM hits p WHERE p.query_id = h.query_id AND NOT p.hard AND p.classification NOT IN ('', 'negative'))) WHERE n <= 5""",
    "c12_live_participants": f"{_S} SELECT session_id FROM disc WHERE record_kind = 'volunteer'",
    "e1_haversine": f"{_S} SELECT session_id, round({KM}, 4) AS km, {BUCKET} AS bucket FROM s",
    "e2_buckets": f"{_S} SELECT {BUCKET} AS bucket, count(*) AS n, max(round_even(round({KM}, 3), -1)) AS farthest FROM s GROUP BY 1",
    "e4_projection": f"{_S} SELECT session_id, round((lon + 180.0) / 360.0 * 960.0, 6) AS x, round((90.0 - lat) / 180.0 * 480.0, 6) AS y FROM s",
    "e5_gate": "SELECT l_orderkey, round(sqrt(least(1.0, count(*) / 4.0) * least(1.0, sum(l_discount) * 20 / 3.0)), 6) AS gate, round(greatest(0.0, least(1.0, sum(l_discount) * 3 - 0.2)), 6) AS clamped FROM lineitem GROUP BY l_orderkey",
    "e6_span_iou": "SELECT o_orderkey, round(i / (18 - i), 6) AS iou, i / (18 - i) >= 0.5 AS merged FROM (SELECT o_orderkey, greatest(0, least(o_orderkey % 20 + 10, o_custkey % 20 + 8) - greatest(o_orderkey % 20, o_custkey % 20)) AS i FROM orders)",
    "e7_set_f1": "SELECT l_orderkey, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS f1 FROM (SELECT l_orderkey, list(DISTINCT l_partkey % 10) AS a, list(DISTINCT l_suppkey % 10) AS b FROM lineitem GROUP BY l_orderkey)",
    "e8_percentile": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY o_orderpriority",
    "e9_recency": "SELECT o_custkey AS user_id, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS last FROM orders GROUP BY o_custkey",
    "e10_json": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS k, count(json_extract(props, '$.k')) AS n FROM events GROUP BY event_type",
    "h9_region_buckets": f"{_S} SELECT region, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 4) AS intensity FROM disc GROUP BY region",
    "h10_suppressed": f"{_S}, c AS (SELECT region, count(*) AS n FROM disc GROUP BY region) SELECT region, n, round_even(n / sum(n) OVER (), 4) AS intensity, (SELECT count(*) FROM c WHERE n < 3) AS suppressed FROM c WHERE n >= 3",
    "h11_kinds": f"{_S} SELECT record_kind, count(*) AS n, CAST(sum(CAST(revoked AS INT)) AS BIGINT) AS revoked FROM s GROUP BY record_kind",
    "h17_generation": "SELECT a.user_id, v + coalesce(p, 0) AS generation FROM (SELECT o_custkey AS user_id, count(*) AS v FROM orders GROUP BY 1) a LEFT JOIN (SELECT user_id, count(*) AS p FROM events WHERE event_type = 'signup' GROUP BY 1) b ON a.user_id = b.user_id",
    "i2_distractor_rank": "SELECT * FROM (SELECT o_custkey AS query_id, o_orderkey AS graph_id, o_orderstatus = 'O' AS relevant, CAST(coalesce(sum(CAST(o_orderstatus <> 'O' AS INT)) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS rank FROM orders) WHERE relevant",
    "i5_latest_block": f"WITH {BLOCKS} SELECT * FROM blocks",
    "i6_latest_contribution": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    "i7_most_recent_share": f"{_S} SELECT user_id, arg_max(session_id, (created_at, session_id)) AS session_id FROM disc GROUP BY user_id",
    "n2_intro_states": """WITH e AS (SELECT user_id * 10 + day(ts) % 10 AS intro_id, CASE event_type WHEN 'click' THEN 'requested' WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'declined' ELSE 'cancelled' END AS kind, ts, event_id FROM events WHERE event_type <> 'signup'),
asked AS (SELECT intro_id, min((ts, event_id)) AS asked FROM e WHERE kind = 'requested' GROUP BY intro_id),
first AS (SELECT e.intro_id, arg_min(kind, (ts, event_id)) AS kind FROM e JOIN asked ON e.intro_id = asked.intro_id WHERE kind <> 'requested' AND (ts, event_id) > asked GROUP BY e.intro_id)
SELECT a.intro_id, coalesce(f.kind, 'requested') AS state FROM asked a LEFT JOIN first f ON a.intro_id = f.intro_id""",
    "g11_members": "SELECT n_name, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "g12_latest_between": "SELECT low, high, arg_max(event_id, (ts, event_id)) AS intro_id, arg_max(event_type, (ts, event_id)) AS state FROM (SELECT least(user_id, event_id % 37 + 1) AS low, greatest(user_id, event_id % 37 + 1) AS high, event_id, event_type, ts FROM events WHERE user_id <> event_id % 37 + 1) GROUP BY low, high",
    "g13_accepted_pairs": "SELECT DISTINCT least(user_id, event_id % 37 + 1) AS low, greatest(user_id, event_id % 37 + 1) AS high FROM events WHERE event_type = 'purchase'",
    "n7_authorisation": """SELECT o_orderkey, a AS action, CASE WHEN o_custkey % 11 = 0 THEN 'allow:owner' WHEN o_custkey % 7 = 0 THEN 'deny:blocked' WHEN a = 'discover' THEN CASE WHEN o_custkey % 2 = 0 THEN 'allow:discoverable' ELSE 'deny:private' END
  WHEN a = 'intro' THEN CASE WHEN o_custkey % 2 = 0 THEN 'allow:intro' ELSE 'deny:private' END WHEN a = 'message' THEN CASE WHEN o_custkey % 3 = 0 THEN 'allow:accepted' ELSE 'deny:no channel' END
  WHEN a = 'workspace' THEN CASE WHEN o_custkey % 5 = 0 THEN 'allow:member' ELSE 'deny:not a member' END ELSE 'deny:unknown action' END AS decision FROM (SELECT *, ['discover', 'intro', 'message', 'workspace', 'other'][o_orderkey % 5 + 1] AS a FROM orders)""",
    "n8_reserved_ids": f"{_S} SELECT sha256(user_id || '|' || CAST(created_at AS DATE)) AS thought_id, count(*) AS sessions, CAST(sum(CAST(deleted AS INT)) AS BIGINT) AS deleted FROM s GROUP BY 1 HAVING count(*) > 1",
    "n9_user_revoke": f"{_S} SELECT session_id, revoked OR hidden AS revoked FROM s",
    "l11_idempotency": "SELECT event_id % 4000 AS request_id, arg_min(sha256(event_type || '|' || (event_id % 3)), (ts, event_id)) AS first, count(*) AS tries, count(DISTINCT sha256(event_type || '|' || (event_id % 3))) > 1 AS conflict FROM events GROUP BY 1",
    "j7_alerts": "SELECT user_id, mine, theirs, detected_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY detected_at, mine, theirs) AS n FROM (SELECT user_id, event_id % 60 + 1 AS mine, event_id % 45 + 1 AS theirs, min(ts) AS detected_at FROM events GROUP BY ALL)) WHERE n <= 20",
    "l4_pending": f"{_S}, {BLOCKS} SELECT m.user_id, m.session_id AS mine, t.session_id AS theirs, m.created_at AS detected_at FROM disc m JOIN disc t ON t.session_id = m.session_id + 5 AND t.user_id <> m.user_id WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.blocked AND b.low = least(m.user_id, t.user_id) AND b.high = greatest(m.user_id, t.user_id))",
    "l9_cursor": "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 100)) WHERE n <= 25",
}
