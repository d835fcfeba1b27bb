"""Presentation, ingestion by hand, stored results, alerts, topics and workspaces: folds of event logs, joins and lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ROLES, TYPES
from . import features
from .sessions import latest

ADJECTIVES = ("calm", "early", "gentle", "golden", "hidden", "lively", "plain", "quiet", "silver", "steady", "sunny", "tidy", "warm", "windy")
NOUNS = ("acorn", "basin", "beacon", "brook", "cedar", "cliff", "comet", "garden", "harbor", "lantern", "meadow", "orchard", "pebble", "river", "summit", "thicket", "willow")
ORDINALS = ("the Second", "the Third", "the Fourth", "the Fifth", "the Sixth", "the Seventh", "the Eighth", "the Ninth")
PHRASES = {"analogical": "another subject, built alike", "approximate": "alike in part", "direct": "the same subject, reasoned alike", "complementary": "one has what the other needs", "negative": "nothing in common"}
# Who may say whose words a thought is, and the bounds of a thought put together by hand.
AUTHORSHIP, REFUSED_AUTHORSHIP = ("their_own_words", "their_words_reorganised"), "i_proposed_it"
MOST_NODES, MOST_RELATIONS, LONGEST_LABEL = 40, 80, 120
NOTIFY_HOURS = 20


def _pick(words: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w.capitalize()) for w in words]), (F.pmod(number, F.lit(len(words))) + 1).cast("int"))


def two_word_name(identifier: Column, prefix: str = "") -> Column:
    """A stable two-word name of an id, by the first 32 bits of its digest; adjectives and nouns are this module's."""
    number = F.conv(F.substring(F.sha2(identifier.cast("string"), 256), 1, 8), 16, 10).cast("long")
    name = F.concat_ws(" ", _pick(ADJECTIVES, number), _pick(NOUNS, F.floor(number / len(ADJECTIVES))))
    return F.concat(F.lit(prefix + " "), name) if prefix else name


def verdict_words(verdict: Column) -> Column:
    """A verdict in words; one that isn't known stays as it is."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])[F.lower(F.trim(verdict))], verdict)


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def is_pseudonym(label: Column) -> Column:
    """Whether a label is an adjective and a noun of the vocabulary, with or without an ordinal."""
    title = lambda words: "|".join(w.capitalize() for w in words)
    return F.coalesce(F.trim(label).rlike(f"^({title(ADJECTIVES)})\\s+({title(NOUNS)})(\\s+({'|'.join(ORDINALS)}))?$"), F.lit(False))


def pseudonyms(users: DataFrame) -> DataFrame:
    """user_id, pseudonym: pairs of the vocabulary by turns, then the same with an ordinal; null once all are taken.  User
    ids count from 0."""
    pairs = len(ADJECTIVES) * len(NOUNS)
    n = F.col("user_id")
    ordinal = F.floor(n / pairs)
    name = F.concat_ws(" ", _pick(ADJECTIVES, n), _pick(NOUNS, F.floor(F.pmod(n, F.lit(pairs)) / len(ADJECTIVES))))
    more = F.element_at(F.array(*[F.lit(" " + o) for o in ORDINALS]), F.greatest(ordinal, F.lit(1)).cast("int"))
    return users.select("user_id", F.when(ordinal == 0, name).when(ordinal <= len(ORDINALS), F.concat(name, more)).alias("pseudonym"))


def readable(thoughts: DataFrame) -> DataFrame:
    """What others may read of a thought, field by field: a field added later can't leak."""
    return thoughts.select("thought_id", "schema_version", F.coalesce("nodes", F.array().cast(thoughts.schema["nodes"].dataType)).alias("nodes"), F.coalesce("relations", F.array().cast(thoughts.schema["relations"].dataType)).alias("relations"))


def throttle(requests: DataFrame, hours: int = NOTIFY_HOURS) -> DataFrame:
    """user_id, event_id, ts, sent: a request is sent if the user's last sent one is at least so many hours old.

    A fold along each user's requests in order of time: partitions are sorted and read through, and only a user's last time is
    held, so a user with very many requests needs no more memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, user, wait = None, None, hours * 3_600_000_000
        for frame in frames:
            sent = []
            for u, t in zip(frame["user_id"].tolist(), frame["at"].tolist(), strict=True):
                if u != user:
                    user, last = u, None
                told = last is None or t - last >= wait
                last = t if told else last
                sent.append(told)
            yield frame.assign(sent=sent)

    rows = requests.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).filter("user_id is not null and at is not null")
    told = rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, "user_id bigint, event_id bigint, at bigint, sent boolean")
    return told.select("user_id", "event_id", F.timestamp_micros("at").alias("ts"), "sent")


def explain(results: DataFrame, asked: DataFrame) -> DataFrame:
    """a, b and the last stored result of each pair asked for (nulls where there is none); results: a, b, at, result_id, verdict."""
    return asked.select("a", "b").distinct().join(latest(results, ["a", "b"], ["result_id", "verdict"], ["at", "result_id"]), ["a", "b"], "left")


def alert_states(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts (alert_key, user_id, session_id) that are left, with seen_at, after actions (kind, alert_key, session_id, user_id,
    ts): their owner saw them (the first time counts) or dismissed them, or revoked the session they point from."""
    own = actions.filter("kind in ('seen', 'dismissed')").groupBy("alert_key", "user_id").agg(F.min(F.when(F.col("kind") == "seen", F.col("ts"))).alias("seen_at"), F.bool_or(F.col("kind") == "dismissed").alias("dismissed"))
    gone = actions.filter("kind = 'revoked'").select("session_id", "user_id").distinct()
    left = alerts.join(own, ["alert_key", "user_id"], "left").filter(~F.coalesce("dismissed", F.lit(False)))
    return left.join(gone, ["session_id", "user_id"], "left_anti").select("alert_key", "user_id", "session_id", "seen_at")


def servable(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows of an index (name, generation, ...) whose generation is the corpus's now (name, generation); fails closed: an index of
    an unknown corpus or another generation serves nothing."""
    return index.join(corpus.select("name", "generation").distinct(), ["name", "generation"], "left_semi")


def stored_results(results: DataFrame, generation: DataFrame, live: DataFrame) -> DataFrame:
    """result_id, session_id, status of stored hits (result_id, generation, session_id): ``stale`` if the corpus has moved on since,
    else ``gone`` for sessions that aren't live any more, else ``ok``.  generation: one row."""
    now = results.join(F.broadcast(generation.agg(F.max("generation").alias("now"))))
    marked = now.join(live.select("session_id", F.lit(True).alias("is_live")).distinct(), "session_id", "left")
    return marked.select("result_id", "session_id", F.when(~F.col("generation").eqNullSafe(F.col("now")), "stale").when(F.col("is_live"), "ok").otherwise("gone").alias("status"))


def authorship(rows: DataFrame) -> DataFrame:
    """The same rows with accepted and reason of what they state about whose words they are."""
    stated = F.trim(F.coalesce("authorship", F.lit("")))
    reason = F.when(stated == "", "missing").when(stated == REFUSED_AUTHORSHIP, "proposed").when(~stated.isin(*AUTHORSHIP), "unknown")
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def manual_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that a person or an agent states (thought_id, id, label, role, negated, modality): what a store needs, no spans, and
    ``issue``, the first rule that one breaks."""
    label = F.trim(F.coalesce("label", F.lit("")))
    many, same = F.count("*").over(Window.partitionBy("thought_id")), F.count("*").over(Window.partitionBy("thought_id", "id"))
    issue = F.when(many > MOST_NODES, "too many nodes").when((label == "") | (F.char_length(label) > LONGEST_LABEL), "label").when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "role").when(same > 1, "duplicate id")
    return nodes.select("thought_id", "id", label.alias("label"), "role", F.when(F.coalesce("negated", F.lit(False)), "negated").otherwise("asserted").alias("assertion"), F.coalesce("modality", F.lit("actual")).alias("modality"), F.lit(True).alias("atomic"), F.lit(1.0).alias("conf"), issue.alias("issue"))


def manual_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations (thought_id, id, source, target, type): ends, which name a node by id or else by label, as ids, and ``issue``.
    Of several nodes of a label the first id counts, a shorter one before a longer one (N2 before N10)."""
    ids = nodes.select("thought_id", F.col("id").alias("key"), "id", F.lit(0).alias("kind"))
    names = nodes.select("thought_id", F.lower(F.trim("label")).alias("key"), "id", F.lit(1).alias("kind"))
    known = ids.unionByName(names).groupBy("thought_id", "key").agg(F.min(F.struct("kind", F.length("id").alias("n"), "id")).alias("x"))
    end = lambda df, c: df.withColumn("key", F.trim(c)).join(known.select("thought_id", "key", F.col("x.id").alias("_exact")), ["thought_id", "key"], "left").withColumn("key", F.lower("key")).join(known.select("thought_id", "key", F.col("x.id").alias("_lower")), ["thought_id", "key"], "left").withColumn(f"{c}_id", F.coalesce("_exact", "_lower")).drop("key", "_exact", "_lower")
    found = end(end(relations, "source"), "target")
    many = F.count("*").over(Window.partitionBy("thought_id"))
    issue = F.when(many > MOST_RELATIONS, "too many relations").when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "type").when(F.col("source_id").isNull(), "source").when(F.col("target_id").isNull(), "target").when(F.col("source_id") == F.col("target_id"), "loop")
    return found.select("thought_id", "id", "source_id", "target_id", "type", issue.alias("issue"))


def relayed(messages: DataFrame, channels: DataFrame, longest: int = 4000) -> DataFrame:
    """Messages (channel_id, author, body, ts, message_id) that a channel carries: between the two people of an accepted
    introduction (channel_id, user_a, user_b, state), not blank and not too long; with the one they are for."""
    open_ = channels.filter("state = 'accepted'").select("channel_id", "user_a", "user_b")
    joined = messages.join(open_, "channel_id").filter("author = user_a or author = user_b").filter((F.trim("body") != "") & (F.char_length("body") <= longest))
    return joined.select("message_id", "channel_id", "author", F.when(F.col("author") == F.col("user_a"), F.col("user_b")).otherwise(F.col("user_a")).alias("reader"), "body", "ts")


def members(events: DataFrame) -> DataFrame:
    """workspace, user_id, role: who is in a workspace now, by each one's last event (workspace, user_id, kind, role, ts, event_id)."""
    return latest(events, ["workspace", "user_id"], ["kind", "role"], ["ts", "event_id"]).filter("kind <> 'left'").select("workspace", "user_id", "role")


def briefs(edits: DataFrame) -> DataFrame:
    """workspace, version, body of the brief that holds: an edit names the version it read (workspace, expected, body, ts, event_id);
    of those that name the same one the first wins, and a version without a predecessor that won is refused."""
    won = edits.groupBy("workspace", "expected").agg(F.min_by("body", F.struct("ts", "event_id")).alias("body"))
    order = Window.partitionBy("workspace").orderBy("expected")
    chain = won.withColumn("n", F.row_number().over(order) - 1).filter("expected = n")
    return chain.groupBy("workspace").agg((F.max("expected") + 1).alias("version"), F.max_by("body", "expected").alias("body"))


def topic_sides(contributions: DataFrame, viewers: DataFrame) -> DataFrame:
    """topic, viewer, mine, author, theirs: the viewer's last contribution beside the last one of each other author (topic, author,
    contribution, ts); viewers (topic, viewer) without one see nothing."""
    last = latest(contributions, ["topic", "author"], ["contribution"], ["ts", "contribution"])
    own = viewers.select("topic", "viewer").distinct().join(last.select("topic", F.col("author").alias("viewer"), F.col("contribution").alias("mine")), ["topic", "viewer"])
    return own.join(last.select("topic", "author", F.col("contribution").alias("theirs")), "topic").filter("author <> viewer")


def topic_standing(sides: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """topic, viewer, author, agreed_nodes, agreed_relations, contested, yours_unanswered, theirs_unanswered of sides, by labels and
    by relations between equal labels: of the same type and assertion they agree, with another assertion they are contested."""
    return topic_standing_of(sides, features.pack(nodes.select("graph_id", "node", "label"), relations.select("graph_id", "src", "dst", "type", "assertion")))


def topic_standing_of(sides: DataFrame, graphs: DataFrame) -> DataFrame:
    """The same of graphs as rows (features.pack) whose nodes have labels: what two graphs share is worked out in their side's row."""

    def named(ids: Column) -> Column:
        label = lambda n: F.get("ns", (F.array_position(ids, n) - 1).cast("int"))["label"]
        known = F.filter("es", lambda e: F.array_contains(ids, e["src"]) & F.array_contains(ids, e["dst"]))
        return F.array_distinct(F.transform(known, lambda e: F.struct(label(e["src"]).alias("s"), label(e["dst"]).alias("t"), e["type"].alias("type"), e["assertion"].alias("assertion"))))

    told = lambda who, p: graphs.select(F.col("graph_id").alias(who), F.array_distinct(F.transform("ns", lambda n: n["label"])).alias(f"{p}_labels"), features.let(F.transform("ns", lambda n: n["node"]), named).alias(f"{p}_named"))
    rows = sides.select("topic", "viewer", "author", "mine", "theirs").distinct().join(told("mine", "a").hint("merge"), "mine", "left").join(told("theirs", "b").hint("merge"), "theirs", "left")
    agreed = F.coalesce(F.size(F.array_intersect(F.filter("a_labels", lambda x: x.isNotNull()), F.col("b_labels"))), F.lit(0))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    met = lambda x: F.filter("b_named", lambda y: (y["s"] == x["s"]) & (y["t"] == x["t"]) & (y["type"] == x["type"]))
    both = F.flatten(F.transform("a_named", lambda x: F.transform(met(x), lambda y: x["assertion"] == y["assertion"])))
    count = lambda test: F.coalesce(F.size(F.filter("same", test)), F.lit(0)).cast("long")
    rows = rows.select("topic", "viewer", "author", F.when(F.col("a_labels").isNotNull() & F.col("b_labels").isNotNull(), agreed).otherwise(0).alias("agreed"), size("a_labels").alias("n_a"), size("b_labels").alias("n_b"), F.coalesce(both, F.array().cast("array<boolean>")).alias("same"))
    return rows.select(
        "topic", "viewer", "author", F.col("agreed").cast("long").alias("agreed_nodes"), count(lambda x: x).alias("agreed_relations"), count(lambda x: ~x).alias("contested"),
        (F.col("n_a") - F.col("agreed")).cast("long").alias("yours_unanswered"), (F.col("n_b") - F.col("agreed")).cast("long").alias("theirs_unanswered"),
    )
