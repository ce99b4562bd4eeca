"""A splittable scan of JSON files that hold one array of objects.

Spark's text reader cuts a file into byte ranges and, with ``}`` as the line separator, into segments that end at a
closing brace. Whether a range starts inside a string, and how deep, follows from the ranges before it: each range is
read once from both possible states (outside and inside a string), which leaves where it ends and how the depth
changes; these small summaries are composed in file order. A second read knows each range's state, so it can cut
records: whole ones leave at once, and the pieces of a record that crosses ranges are joined by file.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.operators.ranking import checkpointed

#: A whole string, or one that does not end here.
STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)', re.S)
#: The rest of a string that began before.
CLOSE = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[{\[\]]', re.S)
BETWEEN = " \t\r\n,"
#: States of so many byte ranges are broadcast.
MOST_RANGES = 100_000


def _open(string: str) -> bool:
    """Whether a match of STRING lacks its end."""
    return len(string) == 1 or not CLOSE.fullmatch(string, 1)


def walked(segment: str, inside: bool) -> tuple[bool, int]:
    """The state after a segment and its closing brace: inside a string, change of depth."""
    if inside:
        end = CLOSE.match(segment)
        if not end:
            return True, 0
        segment = segment[end.end() :]
    if '"' in segment:
        last = ""
        rest = []
        at = 0
        for m in STRING.finditer(segment):
            rest.append(segment[at : m.start()])
            at, last = m.end(), m.group()
        rest.append(segment[at:])
        segment = "".join(rest)
        inside = at and not rest[-1] and _open(last)
    else:
        inside = False
    change = segment.count("{") + segment.count("[") - segment.count("]")
    return bool(inside), change if inside else change - 1


def _summaries(batches):
    """A row a range: (file, block, first visible character, [ends inside, change of depth] from outside and from inside)."""
    now, tracks, first = None, None, ""

    def out():
        flat = [v for inside, depth in tracks for v in (int(inside), depth)]
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([first]), pa.array([flat], pa.list_(pa.int64()))], names=["file", "block", "first", "ends"])

    for b in batches:
        for file, block, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, block) != now:
                if now is not None:
                    yield out()
                now, tracks, first = (file, block), [(False, 0), (True, 0)], ""
            first = first or text.lstrip("\ufeff \t\r\n")[:1]
            moved = {}
            for inside in {t[0] for t in tracks}:
                moved[inside] = walked(text, inside)
            tracks = [(moved[i][0], d + moved[i][1]) for i, d in tracks]
    if now is not None:
        yield out()


class _Cutter:
    """Records of one range, from the state in which it starts."""

    def __init__(self, inside: bool, depth: int) -> None:
        self.inside, self.depth = inside, depth
        self.parts: list[str] = []
        self.starts = False
        self.bad = False

    def add(self, text: str):
        """(text, starts) of a record that ends with this segment, or None."""
        if self.depth >= 2 or self.inside:
            inside, change = walked(text, self.inside)
            self.inside, self.depth = inside, self.depth + change
            self.parts.append(text + "}")
            if self.depth == 1 and not inside:
                return self.ended()
            return None
        at, start = 0, -1
        for m in TOKEN.finditer(text):
            token = m.group()
            if token == "{" and self.depth == 1:
                self.bad |= bool(text[at : m.start()].strip(BETWEEN))
                start, self.depth = m.start(), 2
                break
            if self.depth == 0 and token == "[":
                at, self.depth = m.end(), 1
            elif token == "]":
                self.bad |= bool(text[at : m.start()].strip(BETWEEN))
                at, self.depth = m.end(), self.depth - 1
            elif self.depth >= 1:
                self.bad = True  # a string or an array among the elements
                self.depth += token == "["
        if start < 0:
            self.depth -= 1
            return None
        self.starts = True
        text = text[start:]
        self.inside, change = walked(text, False)
        self.depth = 1 + change
        self.parts.append(text + "}")
        return self.ended() if self.depth == 1 and not self.inside else None

    def ended(self):
        out = "".join(self.parts), self.starts
        self.parts, self.starts = [], False
        return out


def _records(batches):
    now, cutter = None, None

    def out(rows):
        file, block = now
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.bool_())], names=["file", "block", "record", "starts", "ends"])

    def closed():
        if cutter.bad:
            raise ValueError(f"{now[0]}: an element of the array is not an object")
        if cutter.parts:
            yield out([("".join(cutter.parts), cutter.starts, False)])

    for b in batches:
        rows = []
        for file, block, text, inside, depth in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (file, block) != now:
                if now is not None:
                    yield out(rows)
                    yield from closed()
                now, cutter, rows = (file, block), _Cutter(inside, depth), []
            if (done := cutter.add(text.removeprefix("\ufeff"))) is not None:
                rows.append((*done, True))
        if now is not None:
            yield out(rows)
    if now is not None:
        yield from closed()


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): the text of each object of the files' top-level arrays. A large file is read by several tasks.

    Another value at the top, an array that does not end, or an element that is no object is an error.
    """
    with _same_ranges(spark):
        return _array_records(spark, path)


@contextmanager
def _same_ranges(spark: SparkSession):
    """Both reads are cut alike: the size of Spark's byte ranges goes by its tasks at once, which grow while executors join."""
    key = "spark.sql.files.minPartitionNum"
    old = spark.conf.get(key, None)
    spark.conf.set(key, old or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def _array_records(spark: SparkSession, path: str) -> DataFrame:
    segments = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ranges = checkpointed(segments.mapInArrow(_summaries, "file string, block long, first string, ends array<long>"))
    start = F.struct(F.lit(0).cast("long").alias("inside"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<block:long,inside:long,depth:long>>").alias("entered"))

    def step(acc, r):
        at = (acc["inside"] * 2).cast("int")
        entered = F.struct(r["block"].alias("block"), acc["inside"].alias("inside"), acc["depth"].alias("depth"))
        return F.struct(F.get(r["ends"], at).alias("inside"), (acc["depth"] + F.get(r["ends"], at + 1)).alias("depth"), F.concat(acc["entered"], F.array(entered)).alias("entered"))

    files = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "ends", "first"))).alias("ranges"))
    folded = checkpointed(files.select("file", F.array_join(F.transform("ranges", lambda r: r["first"]), "").alias("first"), F.aggregate("ranges", start, step).alias("end")))
    wrong = F.when(~F.col("first").startswith("["), "the top is not an array").when((F.col("end.inside") != 0) | (F.col("end.depth") != -1), "the array does not end")
    if bad := folded.select("file", wrong.alias("wrong")).filter("wrong is not null").limit(1).collect():
        raise ValueError(f"{bad[0].file}: {bad[0].wrong}")
    entered = folded.select("file", F.explode("end.entered").alias("e")).select("file", "e.block", (F.col("e.inside") == 1).alias("inside"), F.col("e.depth").cast("int").alias("depth"))
    pieces = checkpointed(_entered(segments, entered).mapInArrow(_records, "file string, block long, record string, starts boolean, ends boolean"))
    order = Window.partitionBy("file").orderBy("block", "starts")
    parts = pieces.filter(~(F.col("starts") & F.col("ends"))).withColumn("n", F.sum(F.col("starts").cast("int")).over(order))
    joined = parts.groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "starts", "record"))), lambda p: p["record"]), "").alias("record"))
    # A null where a piece is no whole record: a later filter on parsed records can be tested before this one.
    whole = pieces.select("file", F.when(F.col("starts") & F.col("ends"), F.col("record")).alias("record")).filter("record is not null")
    return whole.unionByName(joined.select("file", "record"))


def _entered(segments: DataFrame, entered: DataFrame) -> DataFrame:
    """Segments with the state of their range, a range's in order.

    There is one state a byte range (128 MB as a rule). A broadcast join keeps the order; more ranges than ``MOST_RANGES``
    (counted) are joined by shuffle and sorted again.
    """
    if entered.limit(MOST_RANGES + 1).count() <= MOST_RANGES:
        return segments.join(F.broadcast(entered), ["file", "block"]).select("file", "block", "value", "inside", "depth")
    placed = segments.withColumn("place", F.monotonically_increasing_id()).join(entered, ["file", "block"])
    return placed.repartition("file", "block").sortWithinPartitions("file", "block", "place").select("file", "block", "value", "inside", "depth")
