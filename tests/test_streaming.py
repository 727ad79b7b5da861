"""A debounced stream: bursts come out once, after the quiet period, and a restart changes nothing."""

from datetime import datetime, timedelta, timezone

from tessera.streaming import changes

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def feed(spark, folder, number, rows):
    """One file of changes (key, seconds, op)."""
    data = [(k, START + timedelta(seconds=t), number * 100 + i, op) for i, (k, t, op) in enumerate(rows)]
    spark.createDataFrame(data, "key string, ts timestamp, seq long, op string").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, state, out):
    """Read what is new, then stop: the next call restarts from the checkpoint."""
    stream = spark.readStream.schema("key string, ts timestamp, seq long, op string").parquet(folder)
    before = spark.conf.get(changes.ROCKS[0], None)
    spark.conf.set(*changes.ROCKS)
    try:
        changes.debounced(stream, 5000).writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    finally:
        spark.conf.set(changes.ROCKS[0], before) if before else spark.conf.unset(changes.ROCKS[0])
    rows = spark.read.schema("key string, fired timestamp, n long, op string").parquet(out).selectExpr("key", "unix_timestamp(fired) AS at", "n", "op").collect()
    return sorted((r["key"], r["at"] - int(START.timestamp()), r["n"], r["op"]) for r in rows)


def test_a_burst_comes_out_once_and_survives_restarts(spark, tmp_path):
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    feed(spark, folder, 1, [("a", 0, "create"), ("a", 2, "modify"), ("b", 1, "modify"), ("a", 4, "modify")])
    assert run(spark, folder, state, out) == []  # quiet for too short a time
    feed(spark, folder, 2, [("a", 7, "delete"), ("c", 8, "create")])
    # b has been quiet since 1: its row is there, once; a went on in time, so its four changes are one burst that cancels out.
    assert run(spark, folder, state, out) == [("b", 6, 1, "modify")]
    feed(spark, folder, 3, [("d", 30, "rename"), ("d", 36, "modify")])
    assert run(spark, folder, state, out) == [("a", 12, 4, ""), ("b", 6, 1, "modify"), ("c", 13, 1, "create"), ("d", 35, 1, "rename")]
    feed(spark, folder, 4, [("e", 60, "create")])
    assert run(spark, folder, state, out)[-1] == ("d", 41, 1, "modify")
    assert len(run(spark, folder, state, out)) == 5  # nothing new, nothing twice
