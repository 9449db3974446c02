"""ST01 as a running stream: open sessions as state, closed by event-time timeouts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from merchlens.session import shared_folder
from merchlens.streaming.sessions import MAX_TURNS, TTL_SECONDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LATENESS_SECONDS = 600

# Times are microseconds.  ``recent_at`` and ``recent`` are the last turns in order; a state holds
# one entry per open session of its user.
_FIELDS = ("started", "ended", "turns")
OPEN = "started array<bigint>, ended array<bigint>, turns array<bigint>, recent_at array<array<bigint>>, recent array<array<bigint>>"
OUTPUT = "user_key bigint, started bigint, ended bigint, turns bigint, recent array<bigint>"


def _joined(a: tuple, b: tuple, keep: int) -> tuple:
    recent = sorted([*zip(a[3], a[4]), *zip(b[3], b[4])])[-keep:]
    return min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], [t for t, _ in recent], [i for _, i in recent]


def _merged(sessions: list[tuple], ttl: int, keep: int) -> list[tuple]:
    """Sessions at most ``ttl`` apart become one."""
    out: list[tuple] = []
    for s in sorted(sessions, key=lambda s: s[0]):
        if out and s[0] - out[-1][1] <= ttl:
            out[-1] = _joined(out[-1], s, keep)
        else:
            out.append(s)
    return out


def _update(ttl: int, keep: int):
    """Open sessions of a user as intervals, merged whatever the order of the turns.

    A turn joins every session it is at most ``ttl`` away from, so the result is that of all
    turns in order.  The state of a session is its bounds, a count and its last turns:
    it does not grow with the session.  Once the watermark has passed a session's end by more than
    ``ttl``, no turn that is still let in can reach it, and it is emitted.  The state of a user
    travels with its rows, many users to an Arrow batch; the timeout is that of the
    session that ends first.
    """

    def expiry(session: tuple) -> int:
        return (session[1] + ttl) // 1000 + 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions = []
        if state.exists:
            sessions = [(int(a), int(b), int(n), list(at), list(ids)) for a, b, n, at, ids in zip(*state.get)]
        if not state.hasTimedOut:
            for frame in batches:
                sessions += [(at, at, 1, [at], [turn]) for at, turn in zip(frame["at"].tolist(), frame["turn"].tolist())]
                sessions = _merged(sessions, ttl, keep)
        now = state.getCurrentWatermarkMs()
        done = [s for s in sessions if expiry(s) <= now]
        held = [s for s in sessions if expiry(s) > now]
        if held:
            state.update(tuple([s[i] if i < 3 else [int(x) for x in s[i]] for s in held] for i in range(5)))
            # Spark calls once the watermark is beyond the timeout, not when it reaches it.
            state.setTimeoutTimestamp(min(map(expiry, held)) - 1)
        elif state.exists:
            state.remove()
        rows = [(key[0], *s[:3], [int(i) for i in s[4]]) for s in done]
        yield pd.DataFrame(rows, columns=["user_key", *_FIELDS, "recent"])

    return step


def closed_sessions(
    turns: DataFrame, ttl: int = TTL_SECONDS, keep: int = MAX_TURNS, lateness: int = LATENESS_SECONDS
) -> DataFrame:
    """(user_key, started, ended, turns, recent) of every session once it is over.

    ``turns``: a stream of user_key bigint, ts timestamp, turn bigint.  Turns at or below
    the watermark, which trails the latest one seen by ``lateness`` seconds, are dropped.
    """
    timed = turns.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_micros("ts")).withWatermark("ts", f"{lateness} seconds")
    return timed.groupBy("user_key").applyInPandasWithState(
        _update(ttl * 1_000_000, keep), OUTPUT, OPEN, "append", GroupStateTimeout.EventTimeTimeout
    )


def replay(arrivals: list[DataFrame], ttl: int = TTL_SECONDS, keep: int = MAX_TURNS, lateness: int = LATENESS_SECONDS) -> DataFrame:
    """The sessions that a stream closes while ``arrivals`` come in one after the other.

    Each arrival is written to the folder the stream reads, the stream takes up its
    checkpoint, processes what is there and stops: every arrival is also a restart.
    Input, checkpoint and output lie in the shared folder.
    """
    spark = arrivals[0].sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        for rows in arrivals:
            rows.write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
            run = (
                closed_sessions(stream, ttl, keep, lateness)
                .writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
                .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
            )
            run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.parquet(f"{base}/out")
