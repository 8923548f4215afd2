"""State and timers: sessions expire, late rows are dropped, repeats are held back; batch by batch."""

import datetime as dt

from pyspark.sql import functions as F

from plantscribe.streaming import jobs as J, sessions as S

ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def put(spark, path, n, rows):
    data = [(k, ZERO + dt.timedelta(seconds=t), i) for k, t, i in rows]
    spark.createDataFrame(data, "session string, ts timestamp, id long").coalesce(1).write.mode("append").parquet(f"{path}/n={n}")


def seconds(us):
    return round((us - ZERO.timestamp() * 1e6) / 1e6)


def feed(spark, tmp_path, steps, run, schema="session string, ts timestamp, id long"):
    for n, rows in enumerate(steps):
        put(spark, str(tmp_path / "in"), n, rows)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        run(stream).awaitTermination()


def test_sessions_expire_and_late_rows_go(spark, tmp_path):
    root = str(tmp_path / "out")
    steps = [
        [("a", 0, 1), ("a", 60, 2), ("b", 100, 3)],
        [("a", 3000, k) for k in range(4, 30)],  # renews the session; the buffer keeps twenty
        [("c", 9000, 40)],  # the watermark passes the others' timers
        [("b", 200, 50), ("c", 9001, 51)],  # long past: dropped
        [("c", 20000, 60)],
    ]
    feed(spark, tmp_path, steps, lambda s: S.chat_sessions(s, root))
    rows = spark.read.parquet(f"{root}/sessions").orderBy("batch").collect()
    ended = {(r.session, seconds(r.session_start)): (seconds(r.expires), r.n, r.messages) for r in rows if r.state == "ended"}
    assert ended[("a", 0)] == (6600, 28, list(range(10, 30)))
    assert ended[("b", 100)] == (3700, 1, [3])
    assert ended[("c", 9000)] == (12601, 2, [40, 51])
    assert not any(50 in r.messages for r in rows)
    last = [r for r in rows if r.session == "c"][-1]
    assert (last.state, last.n, last.messages) == ("open", 1, [60])


def test_repeats_are_held_back(spark, tmp_path):
    root = str(tmp_path / "out")
    steps = [[("q", 0, 1), ("q", 299, 2), ("r", 5, 3)], [("q", 300, 4), ("q", 301, 5)], [("q", 599, 6), ("q", 600, 7), ("r", 1000, 8)], [("r", 1299, 9), ("r", 5000, 10)]]
    feed(spark, tmp_path, steps, lambda s: S.without_repeats(s, root, "session"))
    assert sorted(r.id for r in spark.read.parquet(f"{root}/passed").collect()) == [1, 3, 4, 7, 8, 10]


def test_keyed_stream_drops_what_is_late(spark, tmp_path):
    """Counts by window in update mode: a row behind the watermark doesn't count."""
    from plantscribe.streaming import telemetry as T

    root = str(tmp_path / "out")
    steps = [[("a", 0, 1), ("a", 10, 2)], [("a", 4000, 3)], [("a", 20, 4), ("a", 4010, 5)]]
    feed(spark, tmp_path, steps, lambda s: J.keyed(T.rates(s, ["session"]), "rates", root))
    got = {seconds(int(r.window_start.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)): r.n for r in J.newest_rows(spark, root, "rates", ["window_start", "session"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n").collect()}
    assert got == {0: 2, 3900: 2}
