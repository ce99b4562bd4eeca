"""Stateful processors: order state with event-time timers, conversation history, alerts with a cooldown.

Rows of a session can come out of order. Two ways are used. Orders hold operations in a list state until the watermark
has passed them, and apply them then, in order; until then each batch shows the state as it would be. History and
alerts are given out with the row itself, so they take rows in the order of arrival between batches, and in (ts,
event_id) order within a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def applied(items: dict[int, int], op: str, item: int, qty: int) -> None:
    """One operation on quantities by item: add (at least 1), update (of a present item; 0 or less removes it), remove, clear."""
    if op == "clear":
        items.clear()
    elif op == "add":
        items[item] = items.get(item, 0) + max(1, qty)
    elif item in items and op == "update" and qty > 0:
        items[item] = qty
    elif op in ("remove", "update"):
        items.pop(item, None)


class OrderFold(StatefulProcessor):
    """Quantities by item of a session. Operations wait in a list until the watermark has passed them.

    A timer stands at the earliest waiting operation; when it fires, all that the watermark has passed are applied in
    (ts, event_id) order. A second timer stands ``ttl_ms`` after the session's last operation; when it fires, the
    session's state goes, and its last snapshot stands. Each batch gives the session's state with the waiting
    operations applied to a copy.
    """

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item long", "quantity long")
        self.waiting = handle.getListState("waiting", "micros long, event_id long, op string, item long, qty long")
        self.last = handle.getValueState("last", "micros long")

    def _held(self) -> list[tuple]:
        return sorted(tuple(r) for r in self.waiting.get())

    def _items(self) -> dict[int, int]:
        return {k[0]: v[0] for k, v in self.items.iterator()}

    def _wake(self, held: list[tuple]) -> None:
        if held:
            self.handle.registerTimer(held[0][0] // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        first = held[0][0] if held else None
        for part in rows:
            held += zip(*(part[c].tolist() for c in ("micros", "event_id", "op", "item", "qty")), strict=True)
        held.sort()
        self.waiting.put(held)
        if first is None or held[0][0] < first:
            self._wake(held)
        if self.ttl_ms is not None:  # each access to a state is a call to the JVM
            latest = max(held[-1][0], self.last.get()[0] if self.last.exists() else held[-1][0])
            self.last.update((latest,))
            self.handle.registerTimer(latest // 1000 + self.ttl_ms + 1)
        items = self._items()
        for _, _, op, item, qty in held:
            applied(items, op, item, qty)
        live = [(key[0], k, v) for k, v in sorted(items.items())]
        yield pd.DataFrame(live or [(key[0], -1, 0)], columns=["session", "item", "quantity"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held, items = self._held(), self._items()
        ripe = [r for r in held if r[0] < passed * 1000]
        if ripe:
            before = dict(items)
            for _, _, op, item, qty in ripe:
                applied(items, op, item, qty)
            for k in before.keys() - items.keys():
                self.items.removeKey((k,))
            for k, v in items.items():
                if before.get(k) != v:
                    self.items.updateValue((k,), (v,))
            held = held[len(ripe) :]
            self.waiting.put(held) if held else self.waiting.clear()
            self._wake(held)
        if self.ttl_ms is not None and not held and self.last.exists() and self.last.get()[0] // 1000 + self.ttl_ms < passed:
            self.items.clear()
            self.waiting.clear()
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def fold_orders_stream(ops: DataFrame, late: str = "1 day", ttl_ms: int | None = None) -> DataFrame:
    """(session, item, quantity) snapshots of each session that a batch touched; item -1: nothing is left.

    ops: session, item, op, qty, ts, event_id. An operation may come ``late`` after later ones; what is later still is
    dropped by the watermark. ``ttl_ms``: idle time after which a session's state goes (none: it stays).
    """
    rows = ops.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return rows.groupBy("session").transformWithStateInPandas(OrderFold(ttl_ms), "session long, item long, quantity long", "update", "eventtime")


class History(StatefulProcessor):
    """The last ``keep`` turns of a session since its last reset, in a list state."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "role string, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values(["micros", "event_id"]).itertuples():
            if r.reset:
                turns = []
            out.append((key[0], int(r.event_id), [{"role": a, "content": b} for a, b in turns]))
            turns = [*turns, (r.role, r.content)][-self.keep :]
        self.turns.put(turns)
        yield pd.DataFrame(out, columns=["session", "event_id", "history"])

    def close(self) -> None:
        pass


def history_stream(turns: DataFrame, keep: int) -> DataFrame:
    """(session, event_id, history): each turn with at most ``keep`` turns before it since the session's last reset.

    turns: session, ts, event_id, reset, role, content. A reset starts a new history with its own turn.
    """
    if keep < 1:
        raise ValueError("a history keeps one turn at least")
    rows = turns.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    return rows.groupBy("session").transformWithStateInPandas(History(keep), "session long, event_id long, history array<struct<role:string,content:string>>", "append", "none")


class Cooldown(StatefulProcessor):
    """Readings that a key still ignores, in a value state."""

    def __init__(self, threshold: float, skip: int) -> None:
        self.threshold, self.skip = threshold, skip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "rest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, out = self.rest.get()[0] if self.rest.exists() else 0, []
        for r in pd.concat(list(rows)).sort_values(["micros", "event_id"]).itertuples():
            if rest > 0:
                rest -= 1
            elif r.score >= self.threshold:  # not so for a missing score
                rest = self.skip
                out.append((key[0], int(r.event_id), float(r.score)))
        self.rest.update((rest,))
        yield pd.DataFrame(out, columns=["key", "event_id", "score"]).astype({"key": "int64", "event_id": "int64", "score": "float64"})

    def close(self) -> None:
        pass


def alerts_stream(readings: DataFrame, threshold: float, skip: int) -> DataFrame:
    """(key, event_id, score) of alerts; the next ``skip`` readings of the key after an alert are ignored.

    readings: key, ts, event_id, score.
    """
    rows = readings.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    return rows.groupBy("key").transformWithStateInPandas(Cooldown(threshold, skip), "key long, event_id long, score double", "append", "none")
