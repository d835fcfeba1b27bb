"""Standing search over arriving sessions, and stateful folds of event streams.

Arrivals are matched against the index batch by batch; an alert is written once for each pair and direction, whatever is
replayed: the sink is keyed, and stored alerts are checked against the current state when they are read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sessions import discoverable


def both_sides(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Alerts (user_id, mine, theirs, reason, detected_at) of matches (query_id, graph_id, classification, hard_rejection,
    detected_at): one for who shared, one for who was there, if both are live and not the same person."""
    good = hits.filter("hard_rejection is null and classification not in ('', 'negative')")
    live = discoverable(sessions).select("session_id", "user_id")
    pairs = good.join(live.select(F.col("session_id").alias("query_id"), F.col("user_id").alias("sharer")), "query_id").join(live.select(F.col("session_id").alias("graph_id"), F.col("user_id").alias("holder")), "graph_id").filter("sharer <> holder")
    rows = F.array(
        F.struct(F.col("sharer").alias("user_id"), F.col("query_id").alias("mine"), F.col("graph_id").alias("theirs"), F.lit("you_shared").alias("reason")),
        F.struct(F.col("holder").alias("user_id"), F.col("graph_id").alias("mine"), F.col("query_id").alias("theirs"), F.lit("they_arrived").alias("reason")),
    )
    return pairs.select("detected_at", F.explode(rows).alias("x")).select("x.*", "detected_at")


def run_standing(arrivals: DataFrame, match: Callable[[DataFrame], DataFrame], sessions: Callable[[], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Match each micro-batch of arrivals and append new alerts to a table at ``path``, partitioned by batch: a replayed batch
    overwrites its own part, and pairs already stored are left out."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        fresh = both_sides(match(df), sessions()).dropDuplicates(["user_id", "mine", "theirs"])
        try:
            known = spark.read.parquet(path).filter(F.col("batch") != batch_id).select("user_id", "mine", "theirs")
            fresh = fresh.join(known, ["user_id", "mine", "theirs"], "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, size: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Arrivals by event time and kind, with a watermark; an extension for dashboards."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_windows(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def latest_state(events: DataFrame) -> DataFrame:
    """Fold of an event log: each user's last event; complete or update mode."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")


def _token_bucket(capacity: float, refill: float):
    def step(key, frames: Iterator[pd.DataFrame], state):
        level, at = state.get if state.exists else (capacity, None)
        out = []
        for frame in frames:
            for ts, event in sorted(zip(frame["ts"], frame["event_id"], strict=True)):
                now = ts.timestamp()
                level = min(capacity, level + max(0.0, now - (at if at is not None else now)) * refill)
                at = now
                allowed = level >= 1
                level -= allowed
                out.append((key[0], event, bool(allowed)))
        state.update((level, at if at is not None else 0.0))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    return step


def token_buckets(events: DataFrame, capacity: float = 5, refill: float = 1 / 3600) -> DataFrame:
    """user_id, event_id, allowed: a bucket for each user, kept between batches."""
    return events.groupBy("user_id").applyInPandasWithState(_token_bucket(capacity, refill), "user_id long, event_id long, allowed boolean", "level double, at double", "append", "NoTimeout")


def _folded(events: DataFrame, start: Callable[[], Any], step: Callable[[Any, float], tuple[Any, bool]]) -> DataFrame:
    """user_id, event_id, allowed: each user's events in order of time go through a fold whose state is all that is held, so a
    user with very many events needs no more memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, None
        for frame in frames:
            told = []
            for u, at in zip(frame["user_id"].tolist(), frame["at"].tolist(), strict=True):
                if u != user:
                    user, state = u, start()
                state, allowed = step(state, at)
                told.append(allowed)
            yield frame[["user_id", "event_id"]].assign(allowed=told)

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at")).filter("user_id is not null and at is not null")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, "user_id bigint, event_id bigint, allowed boolean")


def token_buckets_batch(events: DataFrame, capacity: float = 5, refill: float = 1 / 3600) -> DataFrame:
    """The same over a bounded table."""

    def step(state: tuple, at: float) -> tuple[tuple, bool]:
        level, last = state
        level = min(float(capacity), level + max(0.0, at - (at if last is None else last)) * refill)
        return (level - (level >= 1), at), level >= 1

    return _folded(events, lambda: (float(capacity), None), step)


def sliding_limit(events: DataFrame, most: int = 20, seconds: int = 3600) -> DataFrame:
    """user_id, event_id, allowed: at most so many allowed events in any such span; refused ones don't count."""

    def step(log: deque, at: float) -> tuple[deque, bool]:
        while log and log[0] <= at - seconds:
            log.popleft()
        allowed = len(log) < most
        if allowed:
            log.append(at)
        return log, allowed

    return _folded(events, deque, step)
