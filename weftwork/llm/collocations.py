"""Phrase collocations by direct-address tiling.

Words get ids in the order of their frequency. A block holds some million words of one language as codes into its own
list of distinct symbols. Codes are put in the order of the global ids, so frequent words come first, and adjacent
pairs fall into square tiles of codes: a tile with many pairs is counted by one dense ``bincount`` whose cells are
addressed directly, the pairs of thin tiles are sorted (COO) and counted by runs. The blocks' counts are summed by
Spark. Pairs that are frequent enough are symbols in their turn: they are ranked again, the blocks are coded anew with
them, and two adjacent pairs are a phrase of three words. So level n counts phrases of n words, and nothing rarer than
``least`` is ever paired again.

No vocabulary is broadcast: each block's distinct symbols are joined with the ranked ones and go back to the block.
Between steps all lies in flat rows, a row a distinct symbol of a block and one row with the block's codes, so that no
reader holds more than one block.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators.ranking import global_rank

from .common import dropped, released, stored, swept

#: Piece ends become byte FF, which no UTF-8 text holds; a tab becomes a space.
MARK = b"\xff"
_TABLE = bytes(255 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
#: Words of one language in a block, and of all languages that wait in a task.
BLOCK, WAITING = 1 << 20, 1 << 22
#: Bits of the filter before a join with ranked symbols (4 MB).
BITS = 1 << 25
#: A long text is taken in slices of about so many bytes, cut at piece ends.
SLICE = 1 << 20
#: A block's rows: one for each distinct symbol (at: its code), and one at ``CODES`` with the codes and, as count, how many symbols there are.
CODES = 2**31 - 1
WORDS = "block long, at int, lang string, word string, count long, codes binary"
PAIRS = "block long, at int, x long, y long, count long, codes binary"


def slices(text: bytes):
    """The text in parts that end where pieces end."""
    at = 0
    while at < len(text):
        cut = text.find(MARK, at + SLICE)
        end = len(text) if cut < 0 else cut + 1
        yield text[at:end]
        at = end


class _Coder:
    """Words of one language in codes 1, 2, ... by first appearance; 0 ends a piece."""

    def __init__(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known[MARK]
        self.parts, self.n = [], 0

    def add(self, text: bytes) -> int:
        words = text.replace(MARK, b" \xff ").split()
        words.append(MARK)
        self.parts.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        self.n += len(words)
        return len(words)

    def rows(self, block: int, lang: str):
        codes = np.concatenate(self.parts) - 1
        words = [w.decode("utf-8", "surrogatepass") for w in list(self.known)[1:]]
        n = len(words)
        counts = np.bincount(codes[codes >= 0], minlength=n)
        one = pa.array([n], pa.int64())
        columns = [np.full(n, block), np.arange(n, dtype=np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([lang] * n, pa.string()), pa.array(words, pa.string()), pa.array(counts), pa.nulls(n, pa.binary())], names=_names(WORDS))
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([CODES], pa.int32()), pa.array([lang]), pa.nulls(1, pa.string()), one, pa.array([codes.tobytes()], pa.binary())], names=_names(WORDS))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _blocks(batches):
    base, made, waiting, held = TaskContext.get().partitionId() << 32, 0, {}, 0

    def ready(langs):
        nonlocal made
        for lang in langs:
            yield from waiting.pop(lang).rows(base + made, lang)
            made += 1

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for part in slices(text.encode("utf-8", "surrogatepass").lower().translate(_TABLE)):
                held += (coder := waiting.setdefault(lang, _Coder())).add(part)
                if coder.n >= BLOCK:
                    held -= coder.n
                    yield from ready([lang])
                elif held >= WAITING:
                    held = 0
                    yield from ready(list(waiting))
    yield from ready(list(waiting))


def tiled(x: np.ndarray, y: np.ndarray, n: int, width: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (x, y) of codes below ``n``, their counts, and for each given pair its place among the distinct."""
    width = max(width, -(-n // 1024))
    across, cells = -(-n // width), width * width
    tile = x // width * across + y // width
    full = np.bincount(tile, minlength=across * across)
    dense = np.flatnonzero(full >= cells // 8)
    slot = np.full(len(full), -1, np.int64)
    slot[dense] = np.arange(len(dense))
    mine = slot[tile]
    inside = mine >= 0
    place = np.empty(len(x), np.int64)

    cell = mine[inside] * cells + x[inside] % width * width + y[inside] % width
    count = np.bincount(cell, minlength=len(dense) * cells)
    used = np.flatnonzero(count)
    address = np.empty(len(count), np.int64)
    address[used] = np.arange(len(used))
    place[inside] = address[cell]
    at = dense[used // cells]
    dx, dy = at // across * width + used % cells // width, at % across * width + used % width

    key = x[~inside] * n + y[~inside]
    order = np.argsort(key, kind="stable")
    run = key[order]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
    place[np.flatnonzero(~inside)[order]] = len(used) + np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(run)]))
    return np.r_[dx, run[first] // n], np.r_[dy, run[first] % n], np.r_[count[used], np.diff(np.r_[first, len(run)])], place


def paired(codes: np.ndarray, at: np.ndarray, ids: np.ndarray, symbols: int):
    """Adjacent pairs of ranked symbols: global ids, counts, and the sequence in codes of these pairs (-1: no pair)."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    local = np.full(symbols + 1, -1, np.int64)  # the last stands for -1
    local[at[order]] = np.arange(len(order))
    seq = local[codes]
    there = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
    x, y, count, place = tiled(seq[there], seq[there + 1], max(1, len(ids)))
    out = np.full(max(0, len(seq) - 1), -1, np.int32)
    out[there] = place
    return ids[x], ids[y], count, out


def _pairs(last: bool):
    """Rows come sorted by (block, at): a block's ranked symbols, then its codes."""

    def out(block: int, codes: np.ndarray, at: np.ndarray, ids: np.ndarray, symbols: int):
        x, y, count, coded = paired(codes, at, ids, symbols)
        n = len(x)
        for k in range(0, n, 1 << 16):
            part = slice(k, min(n, k + (1 << 16)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.stop - k, block)), pa.array(np.arange(k, part.stop, dtype=np.int32)), *[pa.array(c[part].astype(np.int64)) for c in (x, y, count)], pa.nulls(part.stop - k, pa.binary())], names=_names(PAIRS))
        if n and not last:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([CODES], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([n], pa.int64()), pa.array([coded.tobytes()], pa.binary())], names=_names(PAIRS))

    def run(batches):
        held_at, held_ids = [], []
        for b in batches:
            at, ids, start = b.column(1).to_numpy(), b.column(2).to_numpy(), 0
            for end in np.flatnonzero(at == CODES).tolist():
                held_at.append(at[start:end])
                held_ids.append(ids[start:end])
                codes = np.frombuffer(b.column(3)[end].as_buffer(), np.int32)
                yield from out(b.column(0)[end].as_py(), codes, np.concatenate(held_at), np.concatenate(held_ids), int(ids[end]))
                held_at, held_ids, start = [], [], end + 1
            held_at.append(at[start:].copy())
            held_ids.append(ids[start:].copy())

    return run


def coded(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(text_col).alias("text")).filter("text is not null").mapInArrow(released(_blocks), WORDS)


def ranked(entries: DataFrame, names: list[str], least: int) -> DataFrame:
    """(names, a, id) of the symbols that occur ``least`` times or more; ids rise as frequencies fall."""
    often = entries.groupBy(*names).agg(F.sum("count").alias("a")).filter(F.col("a") >= least)
    return stored(global_rank(often, F.col("a").desc(), *[F.col(n) for n in names], name="id"), "ranked")


def bitmap(symbols: DataFrame, names: list[str]) -> DataFrame:
    """One row with ``BITS`` bits as an array: set at the hashes of the symbols. Its size is fixed, whatever their number."""
    at = F.xxhash64(*names).bitwiseAND(BITS - 1)
    words = symbols.select(F.shiftright(at, 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bits")).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    whole = symbols.sparkSession.range(BITS // 64).join(words, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w"))
    return whole.select(F.transform("w", lambda x: x["bits"]).alias("__bits"))


def admitted(entries: DataFrame, symbols: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``entries`` without most of those that have no ranked symbol, so that they need not be shuffled to the join that decides."""
    at = F.xxhash64(*names).bitwiseAND(BITS - 1)
    bit = F.call_function("shiftright", F.get("__bits", F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")).bitwiseAND(1)
    return entries.crossJoin(F.broadcast(bitmap(symbols, names))).filter(bit == 1).drop("__bits")  # one row of BITS bits


def next_level(blocks: DataFrame, names: list[str], symbols: DataFrame, last: bool) -> DataFrame:
    """The blocks in pairs of ranked symbols."""
    known = admitted(blocks.filter(F.col("at") < CODES).select("block", "at", *names), symbols, names).join(symbols.select(*names, "id"), names).select("block", "at", "id", F.lit(None).cast("binary").alias("codes"))
    codes = blocks.filter(F.col("at") == CODES).select("block", "at", F.col("count").alias("id"), "codes")
    return stored(known.unionByName(codes).repartition("block").sortWithinPartitions("block", "at").mapInArrow(released(_pairs(last)), PAIRS), "pairs", "zstd")


def _scored(n: int):
    """The lowest-scoring cut, ties to the smallest k: (score, k, l, r)."""
    wide = lambda c: c.cast("decimal(16,0)")
    cuts = []
    for k in range(1, n):
        left, right = F.col("heads")[k - 1], F.col("tails")[n - k - 1]
        above, below = F.lit(1_000_000).cast("decimal(7,0)") * wide(F.col("a")) * wide(F.col("a")), wide(left) * wide(right)
        cuts.append(F.struct(F.call_function("div", above, below).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at spaces and tabs. a: occurrences of the
    phrase inside pieces, ``least`` at least; l and r: those of the two parts of its lowest-scoring cut; n: words of the
    language; score: floor(1000000 * a * a / (l * r)) in exact arithmetic. A phrase inside a longer one that has
    ``inside`` percent of its occurrences or more is dropped. Order: score and a falling, then the phrase by bytes.

    A null language is ``und``; null, empty and blank texts have no words; repeated rows count as often as they occur;
    an empty table gives no rows; columns besides language and text are not read. Texts are taken whole, a long one in
    slices that end at piece ends.
    """
    blocks, names = stored(coded(docs, lang_col, text_col), "blocks", "zstd"), ["lang", "word"]
    entries = blocks.filter(F.col("at") < CODES)
    words = stored(entries.groupBy("lang").agg(F.sum("count").alias("n")), "words")
    symbols = ranked(entries, names, least)
    level = symbols.select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("end"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"))
    found = []
    for n in range(2, longest + 1):
        before, blocks = blocks, next_level(blocks, names, symbols, last=n == longest)
        dropped(before)
        swept(docs.sparkSession)
        names = ["x", "y"]
        symbols = ranked(blocks.filter(F.col("at") < CODES), names, least)
        swept(docs.sparkSession)
        left = level.select("lang", F.col("id").alias("x"), F.col("phrase").alias("__left"), F.col("heads").alias("__heads"))
        right = level.select(F.col("id").alias("y"), "end", F.col("tails").alias("__tails"))
        joined = symbols.join(left, "x").join(right, "y")
        if found:
            over = symbols.select(F.explode(F.array("x", "y")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("__over"))
            found[-1] = found[-1].join(over, "id", "left").filter(F.col("__over").isNull() | (100 * F.col("__over") < inside * F.col("a"))).drop("__over")
        level = stored(joined.select("lang", "id", F.concat_ws(" ", "__left", "end").alias("phrase"), "end", "a", F.concat("__heads", F.array("a")).alias("heads"), F.concat("__tails", F.array("a")).alias("tails")), "phrases")
        found.append(level.withColumn("cut", _scored(n)).select("id", "lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").alias("score")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    kept = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return kept.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
