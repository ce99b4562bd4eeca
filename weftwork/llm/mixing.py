"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, piecewise linear between knots. Its integral is the
source's weight; weights share the mix, no source gives more than ``most`` times its words, and what is above that is
shared again by weight. Within a source documents stand in the order of a hash, and their running sums place them in
the source's demand, epoch after epoch. The cumulative demand up to time t is the target times the integral of the
schedule to t; its inverse gives each document's training position, and documents are range-sorted by it.

Running sums need no task for a whole source: documents are dealt in ranges of (source, hash), summed inside a range,
and the sums of the ranges before are added.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators.ranking import global_rank

from .common import stored

#: A schedule: knots (time, weight), times rising from 0 to 1.
Schedule = Sequence[tuple[float, float]]
WORDS = r"[^\x20\x09-\x0D]+"
#: A broadcast holds at most so many rows, and so many bytes of names; both are counted.
MOST_ROWS, MOST_BYTES = 50_000, 4_000_000


def areas(schedule: Schedule) -> list[float]:
    """The integral of the schedule up to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def checked(schedule: Schedule) -> Schedule:
    times = [t for t, _ in schedule]
    if len(times) < 2 or times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:], strict=False)) or any(w < 0 for _, w in schedule) or areas(schedule)[-1] <= 0:
        raise ValueError("a schedule needs knots from time 0 to 1, weights of 0 or more and a positive integral")
    return schedule


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time by which ``share`` (0 to 1) of the schedule's integral has passed."""
    area = areas(schedule)
    y = share * F.lit(area[-1])
    out = F.lit(1.0)
    for ((t0, w0), (t1, w1)), a0, a1 in reversed(list(zip(zip(schedule, schedule[1:], strict=False), area, area[1:], strict=False))):
        left, slope = y - F.lit(a0), (w1 - w0) / (t1 - t0)
        root = F.lit(float(w0)) + F.sqrt(F.greatest(F.lit(0.0), F.lit(float(w0 * w0)) + F.lit(2.0 * slope) * left))
        inside = F.when(left <= 0, F.lit(float(t0))).otherwise(F.least(F.lit(float(t1)), F.lit(float(t0)) + F.lit(2.0) * left / root))
        out = F.when(y < F.lit(a1), inside).otherwise(out)
    return out


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with a hint to broadcast it if its rows and the bytes of ``names``, both counted, are within the bounds."""
    size = df.agg(F.count("*"), reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.octet_length(n)), F.lit(0)) for n in names], F.lit(0))).first()
    return F.broadcast(df) if size[0] <= MOST_ROWS and size[1] <= MOST_BYTES else df


def levelled(sources: DataFrame, total: float) -> float:
    """The words a unit of weight gets: sources whose cap is below their part get the cap, the rest share what is left.

    sources: (weight, cap). The demand at a level is piecewise linear and concave, so these steps rise to the level and
    end; each takes two sums to the driver.
    """
    fixed, held, rest = 0, 0, sources.agg(F.sum("weight")).first()[0] or 0.0
    level = total / rest if rest else 0.0
    while rest:
        at_cap = F.col("cap") <= F.col("weight") * F.lit(level)
        n, held, rest = sources.agg(F.count(F.when(at_cap, 1)), F.coalesce(F.sum(F.when(at_cap, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0.0))).first()
        if n == fixed or not rest:
            break
        fixed, level = n, (total - held) / rest
    return level if rest else float("inf")


def _running(batches):
    """Rows come in order; adds each row's sum of earlier sizes of its source in this partition."""
    part, number, carried = TaskContext.get().partitionId(), None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        source, size = b.column(1).to_numpy(), b.column(2).to_numpy()
        starts = np.r_[0, np.flatnonzero(np.diff(source)) + 1]
        before = np.cumsum(size) - size
        base = before[starts] - np.where((np.arange(len(starts)) == 0) & (source[0] == number), carried, 0)
        before -= np.repeat(base, np.diff(np.r_[starts, n]))
        number, carried = source[-1], int(before[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), *b.columns, pa.array(before)], names=["part", "doc_id", "source_no", "size", "before"])


def curriculum(docs: DataFrame, schedules: Sequence[Schedule], share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document, in training order: (doc_id, source, size, source_size, target, taken, positions).

    Sources by code point, null last, take the schedules in turn. The mix has ``share`` times all words; a source gives
    at most ``most`` (a whole number) times its own. taken: the document's words in the mix, repeats counted; a source's
    taken words are its target without the fraction, so the document at the target is cut. positions: the training time
    (0 to 1) at which each epoch's copy starts; rows are range-sorted by the first, documents not taken last.

    A null or blank text has size 0 and is not taken. Rows with a null id, and repeated rows, are documents like any
    other; equal ids are told apart by size alone, so reruns agree. An empty table gives no rows; other columns are not
    read.
    """
    schedules = [checked(s) for s in schedules]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).isNull().alias("unnamed"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), size.alias("size")), "sizes")
    named = sized.groupBy("unnamed", "source").agg(F.sum("size").alias("source_size"))
    kind = (F.col("source_no") - 1) % len(schedules)
    weights = F.array(*[F.lit(areas(s)[-1]) for s in schedules])
    sources = stored(global_rank(named, F.col("unnamed"), F.col("source"), name="source_no").withColumns({"kind": kind, "cap": F.col("source_size") * F.lit(most)}).withColumn("weight", weights[F.col("kind")]), "sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = levelled(sources, total)
    target = F.col("cap").cast("double") if level == float("inf") else F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    aimed = stored(sources.select("unnamed", "source", "source_no", "kind", "source_size", target.alias("target")), "targets")

    dealt = ["source_no", F.md5(F.col("doc_id").cast("string")), "doc_id", "size"]
    known = sized.join(narrow(aimed.select("unnamed", "source", "source_no"), "source"), ["unnamed", "source"])
    ordered = known.repartitionByRange(*dealt).sortWithinPartitions(*dealt).select("doc_id", "source_no", "size")
    ranged = stored(ordered.mapInArrow(_running, "part int, doc_id long, source_no long, size long, before long"), "ranges")
    earlier = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("source_no", "part").agg(F.sum("size").alias("words")).select("source_no", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))

    start = F.col("before") + F.col("offset")
    goal = F.floor("target")
    at = [start + F.lit(k) * F.col("source_size") for k in range(most)]
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), goal - a)) for a in at]
    moment = lambda a: reduce(lambda rest, k: F.when(F.col("kind") == k, time_of(a / goal, schedules[k])).otherwise(rest), range(len(schedules)), F.lit(None).cast("double"))
    positions = F.filter(F.array(*[F.when(t > 0, moment(a)) for t, a in zip(takes, at, strict=True)]), lambda p: p.isNotNull())
    placed = ranged.join(narrow(offsets), ["source_no", "part"]).join(narrow(aimed, "source"), "source_no")
    out = placed.select("doc_id", F.when(~F.col("unnamed"), F.col("source")).alias("source"), "size", "source_size", "target", reduce(lambda a, b: a + b, takes).cast("long").alias("taken"), positions.alias("positions"))
    return out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")
