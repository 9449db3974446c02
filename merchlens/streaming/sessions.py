"""ST01: session state over a turn stream, and its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

TTL_SECONDS = 3600
MAX_TURNS = 10

OUTPUT = "user_key string, created timestamp, last_access timestamp, turn_count bigint, turns array<string>, closed boolean"
STATE = "created double, last_access double, turn_count bigint, turns array<string>"


def _update(ttl: float, keep: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []

        def emit(created, last, count, turns, closed):
            done.append((key[0], pd.Timestamp(created, unit="s"), pd.Timestamp(last, unit="s"), count, list(turns), closed))

        if state.hasTimedOut:
            emit(*state.get, True)
            state.remove()
        else:
            current = state.get if state.exists else None
            rows = pd.concat(list(batches)).sort_values(["ts", "turn"])
            for ts, turn in zip(rows["ts"], rows["turn"]):
                now = ts.timestamp()
                if current is not None and now - current[1] > ttl:
                    emit(*current, True)
                    current = None
                if current is None:
                    current = (now, now, 0, [])
                turns = (list(current[3]) + [turn])[-keep:]
                current = (current[0], max(now, current[1]), current[2] + 1, turns)
            state.update(current)
            state.setTimeoutTimestamp(int((current[1] + ttl) * 1000) + 1)
            emit(*current, False)
        yield pd.DataFrame(done, columns=["user_key", "created", "last_access", "turn_count", "turns", "closed"])

    return step


def session_stream(
    turns: DataFrame, ttl: float = TTL_SECONDS, keep: int = MAX_TURNS, lateness: str = "10 minutes"
) -> DataFrame:
    """Stateful session table: (user_key, ts, turn) in, session snapshots out.

    A session is created by its first turn, touched by each turn, closed after
    ``ttl`` idle seconds of event time, and remembers its last ``keep`` turns.
    Rows older than the watermark are dropped.
    """
    return (
        turns.withWatermark("ts", lateness)
        .groupBy("user_key")
        .applyInPandasWithState(
            _update(ttl, keep), OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout
        )
    )


def sessionize(
    turns: DataFrame, user: str, ts: str, tie: str, ttl: int = TTL_SECONDS, bucket_seconds: int = 21_600
) -> DataFrame:
    """Batch twin: 1-based ``session`` per user; a gap above ``ttl`` starts a session.

    A user with a large share of the rows is cut by time: windows run inside
    (user, bucket), and one summary row per bucket carries the last time and the
    number of sessions of the buckets before it.
    """
    sec = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    rows = turns.withColumns({"_s": sec, "_b": F.floor(sec / bucket_seconds)})
    inside = W.partitionBy(user, "_b").orderBy("_s", tie)
    local = rows.withColumn("_prev", F.lag("_s").over(inside))
    before = W.partitionBy(user).orderBy("_b")
    edges = rows.groupBy(user, "_b").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    first = edges.withColumn("_carry", F.lag("_hi").over(before)).select(user, "_b", "_carry")
    linked = local.join(first, [user, "_b"]).withColumn("_prev", F.coalesce("_prev", "_carry"))
    starts = linked.withColumn(
        "_new", (F.col("_prev").isNull() | (F.col("_s") - F.col("_prev") > ttl)).cast("bigint")
    )
    totals = starts.groupBy(user, "_b").agg(F.sum("_new").alias("_n"))
    offsets = totals.withColumn(
        "_off", F.coalesce(F.sum("_n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).select(user, "_b", "_off")
    running = F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        starts.join(offsets, [user, "_b"])
        .withColumn("session", running + F.col("_off"))
        .drop("_s", "_b", "_prev", "_carry", "_new", "_off")
    )


def last_turns(rows: DataFrame, by: list[str], order: list, keep: int = MAX_TURNS) -> DataFrame:
    """W12. The last ``keep`` rows per session; pruned before the shuffle."""
    ranked = rows.withColumn("recency", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("recency") <= keep)
