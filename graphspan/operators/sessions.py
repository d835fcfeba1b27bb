"""Consent, redaction, discovery, introductions and folds over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import coarse_km, distance_bucket, haversine


def share_state() -> Column:
    """deleted before revoked before discoverable; else hidden."""
    return F.when(F.col("deleted"), "deleted").when(F.col("revoked"), "revoked").when(F.col("share_enabled") & F.col("share_thought"), "discoverable").otherwise("hidden")


def discoverable(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("share_enabled") & F.col("share_thought") & ~F.col("revoked") & ~F.col("deleted"))


def visible(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Discoverable sessions of owners who aren't hidden."""
    return discoverable(sessions).join(users.filter(~F.col("hidden")).select("user_id"), "user_id")


def presentation(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """What others may see: a name with consent to it, else "anonymous"; a place with consent to that."""
    rows = sessions.join(users.select("user_id", "name"), "user_id")
    place = lambda c: F.when(F.col("share_location"), F.col(c))
    return rows.select("session_id", F.when(F.col("share_profile"), F.col("name")).otherwise("anonymous").alias("display"), place("city").alias("city"), place("region").alias("region"), place("lat").alias("lat"), place("lon").alias("lon"))


def sanitize(graphs: DataFrame) -> DataFrame:
    """Nested graphs without their source: no text, spans, cues or references; provenance becomes manual."""
    nodes = F.transform("nodes", lambda n: n.withField("spans", F.filter(n["spans"], lambda s: F.lit(False))))
    relations = F.transform("relations", lambda r: r.withField("spans", F.filter(r["spans"], lambda s: F.lit(False))).withField("provenance_refs", F.filter(r["provenance_refs"], lambda s: F.lit(False))).withField("cue", F.nullif(r["cue"], r["cue"])))
    return graphs.withColumns({"nodes": nodes, "relations": relations, "source": F.col("source").withField("text", F.lit("")).withField("sha256", F.sha2(F.lit(""), 256)), "provenance": F.col("provenance").withField("kind", F.lit("manual"))})


def latest_blocks(events: DataFrame) -> DataFrame:
    """low, high, blocked: the last block event of each unordered pair of users (user_a, user_b, blocked, ts, event_id)."""
    return events.groupBy(F.least("user_a", "user_b").alias("low"), F.greatest("user_a", "user_b").alias("high")).agg(F.max_by("blocked", F.struct("ts", "event_id")).alias("blocked"))


def drop_reason(viewer: Column, viewer_hit_hard: Column | None = None) -> Column:
    """Why a row isn't shown, by the first rule that holds: own, blocked, withdrawn, not shared (unless it was hard-rejected),
    habit; null if it is shown."""
    hard = viewer_hit_hard if viewer_hit_hard is not None else F.lit(False)
    return (
        F.when(F.col("user_id") == viewer, "own").when(F.coalesce("blocked", F.lit(False)), "blocked").when(F.col("revoked") | F.col("deleted"), "withdrawn")
        .when(~(F.col("share_enabled") & F.col("share_thought")) & ~hard, "not shared").when(F.coalesce("habit", F.lit(False)), "habit")
    )


def project_rows(rows: DataFrame, viewer: Column, lat: Column, lon: Column) -> DataFrame:
    """Rows (with user_id, consent, place, blocked, habit) as a viewer may see them: dropped or redacted, with a distance."""
    shown = rows.withColumn("reason", drop_reason(viewer)).filter(F.col("reason").isNull())
    km = F.when(F.col("share_location"), haversine(lat, lon, F.col("lat"), F.col("lon")))
    return shown.select("session_id", "user_id", F.when(F.col("share_location"), F.col("region")).alias("region"), coarse_km(km).alias("km"), distance_bucket(km).alias("distance"))


def region_buckets(rows: DataFrame) -> DataFrame:
    """region, n, intensity: counts by region and their share of all, to four places."""
    counted = rows.filter(F.col("region").isNotNull()).groupBy("region").agg(F.count("*").alias("n"))
    return counted.select("region", "n", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("intensity"))


def suppress_small(rows: DataFrame, minimum: int = 3) -> DataFrame:
    """region_buckets of at least ``minimum`` rows, shares over those alone, with how many were suppressed."""
    if minimum < 2:
        raise ValueError("minimum must be at least 2")
    counted = rows.filter(F.col("region").isNotNull()).groupBy("region").agg(F.count("*").alias("n"))
    marked = counted.withColumn("suppressed", F.sum((F.col("n") < minimum).cast("int")).over(Window.partitionBy()))
    return marked.filter(F.col("n") >= minimum).select("region", "n", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("intensity"), "suppressed")


def latest(events: DataFrame, key: list[str], payload: list[str], order: list[str]) -> DataFrame:
    """The payload of each key's last event; an aggregation, so it combines before the shuffle."""
    last = events.groupBy(*key).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("x"))
    return last.select(*key, "x.*")


def intro_states(events: DataFrame) -> DataFrame:
    """intro_id, state, at: the state after the first valid transition out of ``requested`` (intro_id, kind, ts, event_id)."""
    asked = events.filter("kind = 'requested'").groupBy("intro_id").agg(F.min(F.struct("ts", "event_id")).alias("asked"))
    moves = events.filter("kind in ('accepted', 'declined', 'cancelled')").join(asked, "intro_id").filter(F.struct("ts", "event_id") > F.col("asked"))
    first = moves.groupBy("intro_id").agg(F.min_by(F.struct("kind", "ts"), F.struct("ts", "event_id")).alias("x"))
    return asked.join(first, "intro_id", "left").select("intro_id", F.coalesce("x.kind", F.lit("requested")).alias("state"), F.coalesce("x.ts", "asked.ts").alias("at"))


def latest_between(intros: DataFrame) -> DataFrame:
    """low, high, intro_id, state: the last introduction of each unordered pair (intro_id, user_a, user_b, state, ts)."""
    return intros.groupBy(F.least("user_a", "user_b").alias("low"), F.greatest("user_a", "user_b").alias("high")).agg(F.max_by(F.struct("intro_id", "state"), F.struct("ts", "intro_id")).alias("x")).select("low", "high", "x.*")


def authorised(rows: DataFrame) -> DataFrame:
    """decision of (action, is_owner, blocked, discoverable, accepted, is_member): the first rule that speaks."""
    a = F.col("action")
    decision = (
        F.when(F.col("is_owner"), "allow:owner").when(F.col("blocked"), "deny:blocked").when(a == "discover", F.when(F.col("discoverable"), "allow:discoverable").otherwise("deny:private"))
        .when(a == "intro", F.when(F.col("discoverable"), "allow:intro").otherwise("deny:private")).when(a == "message", F.when(F.col("accepted"), "allow:accepted").otherwise("deny:no channel"))
        .when(a == "workspace", F.when(F.col("is_member"), "allow:member").otherwise("deny:not a member")).otherwise("deny:unknown action")
    )
    return rows.withColumn("decision", decision)


def idempotency_conflicts(requests: DataFrame) -> DataFrame:
    """request_id, first, tries, conflict: the first request wins; the same id with another payload is a conflict."""
    return requests.groupBy("request_id").agg(F.min_by("payload_sha", F.struct("ts", "event_id")).alias("first"), F.count("*").alias("tries"), (F.count_distinct("payload_sha") > 1).alias("conflict"))


def alerts(pairs: DataFrame, cap: int = 200) -> DataFrame:
    """One alert for each (user, mine, theirs) forever, the first detected; at most ``cap`` for each account, the first ones."""
    once = pairs.groupBy("user_id", "mine", "theirs").agg(F.min("detected_at").alias("detected_at"))
    order = Window.partitionBy("user_id").orderBy("detected_at", "mine", "theirs")
    return once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap).drop("n")


def pending(stored: DataFrame, sessions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Alerts that still hold: both sessions live, the owner unchanged, nobody blocked.  Stored rows are never trusted."""
    live = discoverable(sessions).select("session_id", "user_id")
    mine = live.select(F.col("session_id").alias("mine"), F.col("user_id").alias("owner"))
    theirs = live.select(F.col("session_id").alias("theirs"), F.col("user_id").alias("peer"))
    now = stored.join(mine, "mine").join(theirs, "theirs").filter("owner = user_id and owner <> peer").withColumns({"low": F.least("owner", "peer"), "high": F.greatest("owner", "peer")})
    return now.join(blocks.filter("blocked"), ["low", "high"], "left_anti").select("user_id", "mine", "theirs", "detected_at")


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Log-structured write: the row of the greatest version of each key; a change that repeats a version loses."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(version), "_new")
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def near_misses(hits: DataFrame, most: int = 5, meaning: float = 0.4) -> DataFrame:
    """query_id, graph_id, semantic, n: of hits (query_id, graph_id, semantic, hard, classification) that aren't rejected, the few
    of the highest semantic similarity from ``meaning`` on, for queries that nothing matched: a hit that is neither rejected nor
    negative (or unnamed) leaves its query out."""
    open_ = hits.filter(~F.col("hard"))
    matched = open_.filter(~F.lower(F.coalesce("classification", F.lit(""))).isin("", "negative")).select("query_id").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "graph_id")
    rows = open_.filter(F.col("semantic") >= meaning).join(matched, "query_id", "left_anti")
    return rows.select("query_id", "graph_id", "semantic", F.row_number().over(w).alias("n")).filter(F.col("n") <= most)
