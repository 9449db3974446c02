"""Session stream and its batch twin."""

import datetime as dt
import random

from pyspark.sql import functions as F

from merchlens.streaming import sessions as ss
from merchlens.streaming import state

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_stream_keeps_evicts_and_bounds(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "user_key string, ts timestamp, turn string"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)

    feed([("u", at(i), f"t{i:02d}") for i in range(12)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    q = (
        ss.session_stream(stream).writeStream.outputMode("update").format("memory").queryName("sess")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        q.processAllAvailable()
        feed([("u", at(100), "late")])
        q.processAllAvailable()
        feed([("v", at(400), "x")])
        q.processAllAvailable()
        feed([("v", at(401), "y")])
        q.processAllAvailable()
        rows = spark.table("sess").collect()
    finally:
        q.stop()
    first = [r for r in rows if r.user_key == "u" and not r.closed][0]
    assert first.turn_count == 12 and first.turns == [f"t{i:02d}" for i in range(2, 12)]
    closed = sorted((r.turn_count, r.turns[-1]) for r in rows if r.user_key == "u" and r.closed)
    assert closed == [(1, "late"), (12, "t11")]


def test_batch_sessions_cross_buckets(spark):
    rows, want, session, prev = [], {}, 0, None
    for i in range(400):
        t = i * 17 + (i // 25) * 90
        if prev is None or t - prev > 60:
            session += 1
        prev = t
        rows.append(("u", at(t), i))
        want[i] = session
    df = spark.createDataFrame(rows, "user string, ts timestamp, id int").repartition(5)
    got = {r.id: r.session for r in ss.sessionize(df, "user", "ts", "id", bucket_seconds=1800).collect()}
    assert got == want
    last = ss.last_turns(df.withColumn("s", F.lit(1)), ["user", "s"], [F.desc("ts")], 3)
    assert sorted(r.id for r in last.collect()) == [397, 398, 399]


def test_stream_state_equals_batch_across_restarts(spark):
    rnd = random.Random(6)
    rows = [(u, at(m), 1000 * u + i) for u in range(5) for i, m in enumerate(sorted(rnd.sample(range(3000), 60)))]
    rows += [(9, at(i / 10), 50_000 + i) for i in range(400)]  # a busy user, one session
    rows.sort(key=lambda r: r[1])
    local = [r for k in range(0, len(rows), 7) for r in rnd.sample(rows[k : k + 7], len(rows[k : k + 7]))]  # a little out of order
    schema = "user_key long, ts timestamp, turn long"

    def run(cuts):
        parts = [spark.createDataFrame(local[a:b], schema) for a, b in zip([0, *cuts], [*cuts, len(local)])]
        return sorted(map(tuple, state.replay(parts, lateness=100_000).collect()))

    want = []
    df = spark.createDataFrame(rows, schema)
    batch = ss.sessionize(df, "user_key", "ts", "turn").groupBy("user_key", "session").agg(
        F.min(F.unix_micros("ts")).alias("started"), F.max(F.unix_micros("ts")).alias("ended"), F.count("*").alias("turns"),
        F.slice(F.sort_array(F.collect_list(F.struct(F.unix_micros("ts").alias("t"), "turn")), asc=False), 1, 10).alias("last"),
    )
    horizon = max(int((r[1] - dt.datetime(1970, 1, 1)).total_seconds() * 10**6) for r in rows) // 1000 - 100_000_000
    for r in batch.collect():
        if (r.ended + 3600 * 10**6) // 1000 + 1 <= horizon:
            want.append((r.user_key, r.started, r.ended, r.turns, [x.turn for x in r["last"]][::-1]))
    assert run([]) == run([150, 151, 400]) == sorted(want) and want


def test_a_session_closes_when_the_watermark_reaches_its_end(spark):
    schema, end = "user_key long, ts timestamp, turn long", at(0)
    # One hour and one millisecond after the last turn, plus the lateness of ten minutes.
    rows = [(1, end, 1), (2, end + dt.timedelta(minutes=70, milliseconds=1), 2)]
    parts = [spark.createDataFrame([r], schema) for r in rows]
    assert [(r.user_key, r.turns, r.recent) for r in state.replay(parts).collect()] == [(1, 1, [1])]
    assert state.replay([parts[0], spark.createDataFrame([(2, rows[1][1] - dt.timedelta(milliseconds=1), 2)], schema)]).count() == 0


def test_state_travels_with_the_rows(spark):
    # A call to the state store per user and timer took most of the time.
    rows = spark.range(10).selectExpr("id AS user_key", "timestamp_micros(id) AS ts", "id AS turn")
    rate = spark.readStream.format("rate").load().selectExpr("value AS user_key", "timestamp AS ts", "value AS turn")
    assert "FlatMapGroupsInPandasWithState" in state.closed_sessions(rate)._jdf.queryExecution().analyzed().toString()
    assert state.replay([rows]).count() == 0
