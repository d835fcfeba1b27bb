"""Stateful folds of streams by key, on the RocksDB state store: alerts told once, one-time grants, and a guard of replays.

Each is a processor whose state survives restarts and replayed batches with its checkpoint.  Rows of a key in one micro-batch
are taken in order of time, so results don't depend on how they arrive; what a processor holds of a key at once is bounded by
its cap (alerts) or by the rows of one grant or one request in one micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds that one-time grants live, by kind, and alerts that an account may hold.
LIFETIMES = {"code": 300, "token": 3600, "refresh": 30 * 24 * 3600}
MOST_ALERTS = 200

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Alerts(StatefulProcessor):
    """By account: which pairs it was told of, for ever, and how many.  The earliest new pairs of a batch are told, as many as the
    cap leaves room for; nothing more than those is held."""

    def __init__(self, cap: int = MOST_ALERTS):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getMapState("told", "mine long, theirs long", "detected_at timestamp")
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        room = self.cap - n
        new: dict[tuple, datetime] = {}  # the earliest so far, at most twice as many as there is room for
        for r in rows:
            pair = (r["mine"], r["theirs"])
            if room > 0 and (pair in new or not self.told.containsKey(pair)):
                new[pair] = min(new.get(pair, r["detected_at"]), r["detected_at"])
                if len(new) > 2 * room:
                    new = dict(sorted(new.items(), key=lambda x: (x[1], x[0]))[:room])
        latest = sorted((at, *pair) for pair, at in new.items())[: max(room, 0)]
        for at, mine, theirs in latest:
            self.told.updateValue((mine, theirs), (at,))
        if latest:
            self.count.update((n + len(latest),))
        return iter([Row(user_id=key[0], mine=mine, theirs=theirs, detected_at=at) for at, mine, theirs in latest])

    def close(self) -> None:
        pass


def alert_stream(pairs: DataFrame, blocks: DataFrame, habits: DataFrame, cap: int = MOST_ALERTS) -> DataFrame:
    """user_id, mine, theirs, detected_at: each (user_id, mine, theirs) of a stream is told once, for ever; ``cap`` for an account.

    pairs: user_id, peer, mine, theirs, detected_at, hard_rejection, classification, shape.  Before state: rejected and negative
    pairs, oneself, whom the account has blocked (blocks: user_id, peer; blocks are of one direction) and shapes that are a habit
    of many (habits: shape)."""
    good = pairs.filter("hard_rejection is null and lower(classification) not in ('', 'negative') and user_id <> peer and mine <> theirs")
    free = good.join(blocks.select("user_id", "peer").distinct(), ["user_id", "peer"], "left_anti").join(habits.select("shape").distinct(), "shape", "left_anti")
    return free.select("user_id", "mine", "theirs", "detected_at").groupBy("user_id").transformWithState(Alerts(cap), "user_id long, mine long, theirs long, detected_at timestamp", "append", "none")


def _micros(at: datetime) -> int:
    return round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000)


class Grants(StatefulProcessor):
    """By holder: the grant that is open, until when.  It opens one redemption before its time is up; a new one takes the place of
    the one before.  A timer clears what nobody redeems."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "until long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        until = self.open.get()[0] if self.open.exists() else None
        out = []
        for at, event, kind in sorted((r["at"], r["event_id"], r["kind"]) for r in rows):
            if kind:
                until = at + LIFETIMES[kind] * 1_000_000
            else:
                out.append(Row(user_id=key[0], event_id=event, granted=until is not None and at < until))
                until = None
        if until is None:
            self.open.clear()
        else:
            self.open.update((until,))
            self.handle.registerTimer(until // 1000)
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.open.exists() and self.open.get()[0] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def grant_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """user_id, event_id, granted of redemptions; events: user_id, event_id, ts, kind ('' redeems, others name a lifetime)."""
    rows = events.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), "kind")
    return rows.groupBy("user_id").transformWithState(Grants(), "user_id long, event_id long, granted boolean", "append", "eventTime")


class Replays(StatefulProcessor):
    """By request: the payload that came first.  The same again is a replay, another one a conflict; a request is forgotten some
    time after its first row."""

    def __init__(self, keep_seconds: int):
        self.keep = keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "payload string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = self.first.get()[0] if self.first.exists() else None
        out = []
        for at, event, payload in sorted((r["at"], r["event_id"], r["payload"]) for r in rows):
            if first is None:
                first, outcome = payload, "first"
                self.first.update((payload,))
                self.handle.registerTimer(at // 1000 + self.keep * 1000)
            else:
                outcome = "replay" if payload == first else "conflict"
            out.append(Row(request_id=key[0], event_id=event, payload=payload, outcome=outcome))
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def replay_guard(requests: DataFrame, keep_seconds: int, late: str = "1 day") -> DataFrame:
    """request_id, event_id, payload, outcome (first, replay, conflict); requests: request_id, event_id, ts, payload."""
    rows = requests.withWatermark("ts", late).select("request_id", "event_id", "ts", F.unix_micros("ts").alias("at"), "payload")
    return rows.groupBy("request_id").transformWithState(Replays(keep_seconds), "request_id long, event_id long, payload string, outcome string", "append", "eventTime")
