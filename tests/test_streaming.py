"""Streams over several micro-batches against their batch forms."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weftwork.operators import orders as O
from weftwork.operators import selection as S
from weftwork.streaming import jobs, stateful


def in_parts(df, parts, path):
    """``df`` as files that a stream takes one by one; parts: a condition for each."""
    for n, condition in enumerate(parts):
        df.filter(condition).coalesce(1).write.parquet(f"{path}/in/{n}")
        for name in os.listdir(f"{path}/in/{n}"):
            if name.endswith(".parquet"):
                os.utime(f"{path}/in/{n}/{name}", (1_700_000_000 + n, 1_700_000_000 + n))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def operations(spark, n, seed, shuffle):
    """``n`` operations whose files (column part) hold them in order, or up to 40 seconds out of order."""
    rnd = random.Random(seed)
    ops = [(rnd.randrange(5), rnd.randrange(3), rnd.choice(["add", "add", "update", "remove", "clear"]), rnd.randrange(0, 4), i, (i + (rnd.randrange(-20, 20) if shuffle else 0)) // 50) for i in range(n)]
    return spark.createDataFrame(ops, "session long, item long, op string, qty int, event_id long, part int").withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_700_000_000))


def live(out):
    got = jobs.newest(out, "session").filter("quantity > 0").select("session", "item", "quantity")
    return {tuple(r) for r in got.collect()}


@pytest.mark.parametrize("shuffle", [False, True])
def test_order_stream_in_parts(spark, tmp_path, shuffle):
    df = operations(spark, 200, 8 + shuffle, shuffle)
    stream = in_parts(df, [F.col("part") == p for p in range(-1, 5)] if shuffle else [F.col("part") == p for p in range(4)], tmp_path)
    out = jobs.with_rocks(spark, lambda: jobs.finish(stateful.fold_orders_stream(stream.drop("part"), late="45 seconds"), "update"))
    assert out.select("batch").distinct().count() >= 4
    assert live(out) == {tuple(r) for r in O.fold_orders(df, "session", "item", "op", "qty", ["ts", "event_id"]).collect()}


def test_order_stream_drops_idle_sessions_and_rows_behind_the_watermark(spark, tmp_path):
    rows = [(1, 1, "add", 2, 1, 0, 0), (2, 1, "add", 1, 2, 5, 0), (2, 1, "add", 1, 3, 200, 1), (2, 1, "add", 1, 4, 400, 2), (1, 2, "add", 3, 5, 410, 3), (2, 1, "add", 9, 6, 20, 3), (2, 2, "add", 1, 7, 420, 3)]
    df = spark.createDataFrame(rows, "session long, item long, op string, qty int, event_id long, second long, part int").withColumn("ts", F.timestamp_seconds(F.col("second") + 1_700_000_000))
    stream = in_parts(df, [F.col("part") == p for p in range(4)], tmp_path).drop("part", "second")
    out = jobs.with_rocks(spark, lambda: jobs.finish(stateful.fold_orders_stream(stream, late="10 seconds", ttl_ms=100_000), "update"))
    # Session 1 was idle for longer than the time to live, so its first item is gone; session 2 was not; the operation
    # of second 20 came behind the watermark.
    assert live(out) == {(1, 2, 3), (2, 1, 3), (2, 2, 1)}
    first = {tuple(r) for r in out.filter("session = 1 and batch = 0").select("item", "quantity").collect()}
    assert first == {(1, 2)}


def test_history_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.randrange(4), i, rnd.random() < 0.15, rnd.choice(["user", "assistant"]), f"t{i}") for i in range(160)]
    df = spark.createDataFrame(rows, "session long, event_id long, reset boolean, role string, content string").withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_700_000_000))
    stream = in_parts(df, [F.col("event_id").between(40 * p, 40 * p + 39) for p in range(4)], tmp_path)
    got = jobs.with_rocks(spark, lambda: jobs.finish(stateful.history_stream(stream, 6), "append"))
    want = S.session_history(df, "session", ["ts", "event_id"], F.col("reset"), F.col("role"), F.col("content"), 6)
    pick = lambda x: sorted((r.session, r.event_id, [tuple(h) for h in r.history]) for r in x.collect())
    assert got.select("batch").distinct().count() == 4
    assert pick(got) == pick(want) and max(len(r[2]) for r in pick(want)) == 6
    with pytest.raises(ValueError):
        stateful.history_stream(stream, 0)


def test_alert_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(rnd.choice([0, 0, 0, 1, 2]), i, None if rnd.random() < 0.05 else rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, event_id long, score double").withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_700_000_000))
    stream = in_parts(df, [F.col("event_id").between(100 * p, 100 * p + 99) for p in range(4)], tmp_path)
    got = jobs.with_rocks(spark, lambda: jobs.finish(stateful.alerts_stream(stream, 0.8, 7), "append"))
    want = O.cooldown_alerts(df, "key", ["ts", "event_id"], "score", 0.8, 7)
    pick = lambda x: sorted(tuple(r) for r in x.select("key", "event_id", "score").collect())
    assert pick(got) == pick(want) and len(pick(want)) > 20
