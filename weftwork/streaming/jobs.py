"""Structured Streaming forms of the stateful operators. Each runs over what is there and returns the written result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators.ranking import shared_folder
from weftwork.operators.rules import Rule, first_match
from weftwork.streaming import stateful


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A glob reads single files as well as folders of files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def finish(stream: DataFrame, mode: str, partitions: int | None = None) -> DataFrame:
    """Run over the available input, write each batch as Parquet, and read the result."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


RULES = (Rule("browse", ("click", "view")), Rule("buy", ("purchase",)))


def category_counts(stream: DataFrame, text: str, ts: str, rules=RULES, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per window and category; events later than ``late`` are dropped by the watermark."""
    classed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).withColumn("category", first_match(F.col(text), rules, "other"))
    return classed.groupBy(F.window(ts, window), "category").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "category", "n")


def run_category_counts(spark: SparkSession, path: str) -> DataFrame:
    out = finish(category_counts(read_stream(spark, path), "event_type", "ts"), "complete")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").drop("batch")  # one row


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """``run`` while the state store is RocksDB, which list and map states need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        return run()
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def newest(snapshots: DataFrame, key: str) -> DataFrame:
    """The rows of each key's last batch."""
    last = snapshots.groupBy(key).agg(F.max("batch").alias("batch"))
    return snapshots.join(last, [key, "batch"])


def run_order_stream(spark: SparkSession, path: str) -> DataFrame:
    """Live (session, item, quantity) after all order operations of an event table."""

    def run() -> DataFrame:
        e = read_stream(spark, path)
        op = F.when(F.col("event_type").isin("click", "view"), "add").when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "error", "remove").otherwise("clear")
        ops = e.select(F.col("user_id").alias("session"), (F.col("event_id") % 5).alias("item"), op.alias("op"), (F.col("event_id") % 4).cast("int").alias("qty"), "ts", "event_id")
        return finish(stateful.fold_orders_stream(ops), "update")

    return newest(with_rocks(spark, run), "session").filter("quantity > 0").select("session", "item", "quantity")


def run_history_stream(spark: SparkSession, path: str, keep: int) -> DataFrame:
    """(user_id, event_id, history) of an event table: what a user did since the last signup, at most ``keep`` events."""

    def run() -> DataFrame:
        e = read_stream(spark, path)
        turns = e.select(F.col("user_id").alias("session"), "ts", "event_id", (F.col("event_type") == "signup").alias("reset"), F.lit("user").alias("role"), F.col("event_type").alias("content"))
        return finish(stateful.history_stream(turns, keep), "append")

    return with_rocks(spark, run).select(F.col("session").alias("user_id"), "event_id", "history")


def run_alert_stream(spark: SparkSession, path: str, threshold: float, skip: int) -> DataFrame:
    """(user_id, event_id, value) of an event table's alerts."""

    def run() -> DataFrame:
        readings = read_stream(spark, path).select(F.col("user_id").alias("key"), "ts", "event_id", F.col("value").alias("score"))
        return finish(stateful.alerts_stream(readings, threshold, skip), "append")

    return with_rocks(spark, run).select(F.col("key").alias("user_id"), "event_id", F.col("score").alias("value"))
