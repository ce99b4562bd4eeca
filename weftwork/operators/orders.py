"""Order state per session as window sums, alerts over chunks of readings, first crossings outside muted spans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.operators.ranking import checkpointed


def fold_steps(ops: DataFrame, session: str, item: str, op: str, quantity: str, order: Sequence[str]) -> DataFrame:
    """One row an operation: (session, item, op, q, order, before, after).

    add accumulates (at least 1); update sets the quantity of a present item (0 or less removes it); remove drops it;
    clear drops all items of the session. before and after are the item's quantity; of a clear, whose item is null, the
    whole order's.

    A running maximum has the session's last clear before each operation, so clears never meet items. Operations on an
    item between two clears fall into segments that start at removals; within a segment only updates after the first
    add count; the last of those starts the sum.
    """
    at = F.struct(*order)
    past = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    is_clear = F.col(op) == "clear"
    rows = ops.select(session, F.when(~is_clear, F.col(item)).alias(item), F.col(op).alias("op"), F.when(~is_clear, F.col(quantity)).alias("q"), *order)
    rows = rows.withColumn("__cleared", F.max(F.when(F.col("op") == "clear", at)).over(past))
    rows = _quantities(rows, [session, item, "__cleared"], order)
    # A clear ends the span that it closes: the changes since the clear before it are the order's quantity.
    spans = Window.partitionBy(session).orderBy(*order)
    change = F.sum(F.when(F.col("op") != "clear", F.col("after") - F.col("before"))).over(Window.partitionBy(session, F.col("__cleared")).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__sum", F.coalesce(change, F.lit(0)))
    return rows.withColumn("before", F.when(F.col("op") == "clear", F.coalesce(F.lag("__sum").over(spans), F.lit(0))).otherwise(F.col("before"))).select(session, item, "op", "q", *order, "before", "after", "__cleared")


def _quantities(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` (op, q) with ``before`` and ``after``, the quantity of each key around each operation on it."""
    now = lambda *more: Window.partitionBy(*key, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    removed = (F.col("op") == "remove") | ((F.col("op") == "update") & (F.col("q") <= 0))
    rows = rows.withColumn("__seg", F.sum(removed.cast("int")).over(now()))
    rows = rows.withColumn("__adds", F.sum((F.col("op") == "add").cast("int")).over(now("__seg")))
    valid = (F.col("op") == "update") & (F.col("q") > 0) & (F.col("__adds") > 0)
    rows = rows.withColumn("__set", F.sum(valid.cast("int")).over(now("__seg")))
    part = F.when(F.col("op") == "add", F.greatest(F.col("q"), F.lit(1))).when(valid, F.col("q")).otherwise(0)
    rows = rows.withColumn("after", F.sum(part).over(now("__seg", "__set")))
    earlier = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("before", F.coalesce(F.lag("after").over(earlier), F.lit(0)))


def fold_orders(ops: DataFrame, session: str, item: str, op: str, quantity: str, order: Sequence[str]) -> DataFrame:
    """Live (session, item, quantity) after all operations."""
    steps = fold_steps(ops, session, item, op, quantity, order)
    last = steps.withColumn("__end", F.max("__cleared").over(Window.partitionBy(session)))
    return last.filter((F.col("op") != "clear") & F.col("__cleared").eqNullSafe(F.col("__end"))).groupBy(session, item).agg(F.max_by("after", F.struct(*order)).alias("quantity")).filter("quantity > 0")


def before_after(ops: DataFrame, session: str, item: str, op: str, quantity: str, order: Sequence[str]) -> DataFrame:
    """Each operation with the item's quantity before and after it; of a clear, the order's."""
    return fold_steps(ops, session, item, op, quantity, order).drop("__cleared")


def item_steps(ops: DataFrame, session: str, item: str, op: str, quantity: str, order: Sequence[str]) -> DataFrame:
    """Each item's operations with its quantity before and after; a clear is a removal of each item of its session.

    The rows of a session's clears are as many as its clears times its items, as the result has them.
    """
    own = lambda df, op_, q: df.select(session, item, op_.alias("op"), q.alias("q"), *order)
    single = own(ops.filter(F.col(op) != "clear"), F.col(op), F.col(quantity))
    known = single.select(session, item).distinct()
    cleared = own(ops.filter(F.col(op) == "clear").select(session, *order).join(known, session), F.lit("remove"), F.lit(0))
    return _quantities(single.unionByName(cleared), [session, item], order).select(session, item, "op", "q", *order, "before", "after")


def order_totals(lines: DataFrame, key: str, price: Column, quantity: Column) -> DataFrame:
    return lines.groupBy(key).agg(F.round(F.sum(price * quantity), 2).alias("total"), F.count("*").alias("lines"))


def order_summary(lines: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """One text an order: its lines in insertion order."""
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda s: s["t"]), "\n").alias("summary"))


class _Chunk:
    """Readings of one key in one partition, from every remaining cooldown that it may be entered with.

    A class is a set of entries that have met in the same state; they never part again. ``state`` is the number of
    readings that a class still ignores.
    """

    def __init__(self, skip: int) -> None:
        self.skip = skip
        self.classes = {r: [r] for r in range(skip + 1)}

    def add(self, hits: np.ndarray, n: int) -> list[tuple[int, list[int]]]:
        """(place, entries) of the alerts among ``n`` more readings, ``hits`` being the places at the threshold."""
        after = np.searchsorted(hits, hits + 1 + self.skip).tolist()
        starts, found, ended = {}, [], {}
        for state, entries in self.classes.items():
            if state >= n:
                ended.setdefault(state - n, []).extend(entries)
            else:
                starts.setdefault(int(np.searchsorted(hits, state)), []).extend(entries)
        # Classes that reach the same hit are one from there on; places are handled in order.
        heap = sorted(starts)
        while heap:
            at = heap.pop(0)
            entries = starts.pop(at)
            if at >= len(hits):
                ended.setdefault(0, []).extend(entries)
                continue
            place = int(hits[at])
            found.append((place, entries))
            left = place + 1 + self.skip - n
            if left >= 0:
                ended.setdefault(left, []).extend(entries)
            elif after[at] in starts:
                starts[after[at]] = starts[after[at]] + entries
            else:
                starts[after[at]] = entries
                heap.append(after[at])
                heap.sort()
        self.classes = ended
        return found

    def ends(self) -> list[int]:
        out = [0] * (self.skip + 1)
        for state, entries in self.classes.items():
            for r in entries:
                out[r] = state
        return out


def _scanned(threshold: float, skip: int, names: list[str]):
    """Sorted rows (key first, score last): alerts with the entries they hold for, and a row with ends for each chunk."""

    def run(batches):
        part, chunk, last = TaskContext.get().partitionId(), None, None

        def out(batch, at, entries, ends):
            return pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), *[c.take(pa.array(at, pa.int64())) for c in batch.columns], pa.array(entries, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["part", *names, "entries", "ends"])

        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            hit = pc.fill_null(pc.greater_equal(b.column(b.num_columns - 1), threshold), False).to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(np.diff(code)) + 1, b.num_rows]
            at, entries = [], []
            for s, e in zip(starts, starts[1:]):
                key = b.column(0)[int(s)].as_py()
                if chunk is None or key != last[1]:
                    if chunk is not None:
                        yield out(last[0], [0], [None], [chunk.ends()])
                    chunk = _Chunk(skip)
                last = (b.slice(int(e) - 1, 1), key)
                for place, own in chunk.add(np.flatnonzero(hit[s:e]), int(e - s)):
                    at.append(int(s) + place)
                    entries.append(own)
            yield out(b, at, entries, [None] * len(at))
        if chunk is not None:
            yield out(last[0], [0], [None], [chunk.ends()])

    return run


def cooldown_alerts(readings: DataFrame, key: str, order: Sequence[str], score: str, threshold: float, skip: int) -> DataFrame:
    """Alerts per key: a reading at or above the threshold, after which the next ``skip`` readings are ignored.

    Readings lie in ranges of (key, order), so a key with very many spreads over tasks. Each range is scanned once, from
    every cooldown (0 to ``skip``) with which it may be entered: it leaves its alerts with the entries that they hold
    for, at most one row a reading, and where each entry ends. Composing the ends of a key's ranges in their order gives
    the entry of each, and with it the alerts. A missing score is a reading below the threshold.
    """
    names = [key, *order, score]
    dealt = readings.select(key, *order, F.col(score).cast("double").alias(score)).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    schema = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(f.name, f.dataType) for f in dealt.schema], T.StructField("entries", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])
    scanned = checkpointed(dealt.mapInArrow(_scanned(threshold, skip, names), schema))
    chunks = scanned.filter("ends is not null").groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("part", "ends"))).alias("chunks"))
    start = F.struct(F.lit(0).alias("rest"), F.array().cast("array<struct<part:int,rest:int>>").alias("entered"))
    step = lambda acc, c: F.struct(F.get(c["ends"], acc["rest"]).alias("rest"), F.concat(acc["entered"], F.array(F.struct(c["part"].alias("part"), acc["rest"].alias("rest")))).alias("entered"))
    entered = chunks.select("__key", F.explode(F.aggregate("chunks", start, step, lambda acc: acc["entered"])).alias("e")).select("__key", F.col("e.part").alias("__part"), F.col("e.rest").alias("__rest"))
    met = scanned.filter("entries is not null").join(entered, F.col(key).eqNullSafe(F.col("__key")) & (F.col("part") == F.col("__part")))
    return met.filter(F.array_contains("entries", F.col("__rest"))).select(*names)


def first_crossing(readings: DataFrame, mutes: DataFrame, session: str, ts: str, score: str, threshold: float, timeout_seconds: int, bucket_seconds: int = 3600) -> DataFrame:
    """The first reading at or above the threshold within the timeout of the session's first reading, outside mute spans.

    mutes: (session, mute_start, mute_end), ends included. Sessions without a crossing are left out. A reading is muted
    if the latest end of the spans that start by then reaches it. That running maximum is taken within time buckets and
    carried over from the buckets before, so spans are neither matched with readings one by one nor repeated for each
    bucket they cover, and a long session spreads over its buckets.
    """
    starts = readings.groupBy(session).agg(F.min(ts).alias("__start"))
    near = readings.filter(F.col(score) >= threshold).join(starts, session).filter(F.col(ts) <= F.col("__start") + F.make_dt_interval(secs=F.lit(timeout_seconds)))
    moment = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    loud = near.select(session, moment(ts).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__end"), F.col(ts).alias("__ts"), F.col(score).alias("__score"))
    spans = mutes.select(session, moment("mute_start").alias("__at"), F.lit(0).alias("__kind"), moment("mute_end").alias("__end"), F.lit(None).cast(readings.schema[ts].dataType).alias("__ts"), F.lit(None).cast(readings.schema[score].dataType).alias("__score"))
    marks = loud.unionByName(spans).withColumn("__bucket", F.floor(F.col("__at") / (bucket_seconds * 1_000_000)))
    here = Window.partitionBy(session, "__bucket").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(session).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy(session, "__bucket").agg(F.max("__end").alias("__own")).select(session, "__bucket", F.max("__own").over(before).alias("__carried"))
    open_until = marks.withColumn("__open", F.max("__end").over(here)).join(carried, [session, "__bucket"])
    heard = open_until.filter((F.col("__kind") == 1) & (F.coalesce(F.greatest("__open", "__carried"), F.col("__at") - 1) < F.col("__at")))
    return heard.groupBy(session).agg(F.min("__ts").alias("crossed_at"), F.min_by("__score", F.struct("__ts", "__score")).alias("score"))
