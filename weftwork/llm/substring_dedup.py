"""Exact removal of repeated word windows by prefix-partitioned suffix trees.

A suffix starts at each word and is cut at the window's length. Suffixes are split into groups by a prefix of variable
length: the ``gram`` words of its anchor (the ``gram``-word group with the smallest hash among those in the window,
leftmost first) or, where more than ``hot`` runs share these, the whole window. Equal windows have the same anchor and
meet in one group. A row per suffix would send each word 35 times; neighbouring suffixes share an anchor, so they travel
as one run of words, and the words of a suffix before its anchor stand in its run instead of in the key. Steps:

1. One scan writes the runs: (anchor hash, document, first suffix, number of suffixes), about one per 14 words.
2. Anchors are counted. One that occurs once is a leaf; its suffixes repeat nowhere and need no text. For the others, the
   words of the runs are sent to the anchor's group. An anchor with more than ``hot`` runs would make a group beyond
   memory: its suffixes get the longest prefix, and each task first merges the equal ones that it has.
3. A task builds the tree of its groups as a suffix array with the lengths of common prefixes (LCP). Internal nodes of
   depth ``window`` are the stretches of the array whose LCP reaches it; all their leaves repeat. Ranks are exact: words
   are numbered, and no hash decides.
4. The marks go back to the documents, which drop the covered words.

Windows are judged on the input. Exact for documents of any length: sets gathered per document are bounded by it, and
repeated rows (same id and text) share one set.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, released, spread, stored

RUN = "h long, k1 long, k2 long, start int, n int"
PART = "key long, k1 long, k2 long, start int, n int, words binary, known boolean"
MARK = "k1 long, k2 long, start int, n int"
LOW = np.uint64((1 << 24) - 1)
SLICE = 1 << 22
_A, _B = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x ^= x >> np.uint64(29)
    x *= _B
    return x ^ (x >> np.uint64(32))


def _names(h: np.ndarray, depth: int) -> np.ndarray:
    """Names of the ``depth`` words from each position, by doubling; the last depth - 1 positions have none."""
    n = len(h) - depth + 1
    if n <= 0:
        return h[:0]
    width, level = 1, h
    while width * 2 <= depth:
        level = _mix(level[:-width], level[width:])
        width *= 2
    return level[:n] if width == depth else _mix(level[:n], level[depth - width : depth - width + n])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n, w = len(v) - width + 1, 1
    while w * 2 <= width:
        v = np.minimum(v[:-w], v[w:])
        w *= 2
    return np.minimum(v[:n], v[width - w : width - w + n])


def _slices(n: int, window: int):
    """(first word, words, suffixes) of a document of n words, so that each suffix lies in one slice."""
    for at in range(0, max(0, n - window + 1), SLICE):
        suffixes = min(SLICE, n - window + 1 - at)
        yield at, suffixes + window - 1, suffixes


def _runs(window: int, gram: int):
    def flush(hashes, heads):
        h = np.concatenate(hashes)
        g = _names(h, gram)
        v = (g & ~LOW) | np.arange(len(g), dtype=np.uint64)
        anchor = (_least(v, window - gram + 1) & LOW).astype(np.int64)
        owner = np.full(len(anchor), -1)
        at = 0
        for d, (_, _, _, words, suffixes) in enumerate(heads):
            owner[at : at + suffixes] = d
            at += words
        first = np.flatnonzero((owner >= 0) & (np.r_[-1, anchor[:-1]] != anchor) | (owner != np.r_[-1, owner[:-1]]) & (owner >= 0))
        last = np.r_[first[1:], len(anchor)]
        begin = np.cumsum([0] + [x[3] for x in heads])[:-1]
        own = owner[first]
        stop = begin[own] + np.array([x[4] for x in heads])[own]
        n = np.minimum(last, stop) - first
        k1, k2, base = (np.array([x[i] for x in heads], np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(g[anchor[first]].view(np.int64)), pa.array(k1[own]), pa.array(k2[own]), pa.array((first - begin[own] + base[own]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "k1", "k2", "start", "n"])

    def run(batches):
        hashed = xxhash.xxh64_intdigest
        hashes, heads, total = [], [], 0
        for b in batches:
            for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass")) if text else []
                if len(words) < window:
                    continue
                h = np.fromiter(map(hashed, words), np.uint64, len(words))
                for at, size, suffixes in _slices(len(words), window):
                    hashes.append(h[at : at + size])
                    heads.append((k1, k2, at, size, suffixes))
                    total += size
                    if total > 1 << 19:
                        yield flush(hashes, heads)
                        hashes, heads, total = [], [], 0
        if hashes:
            yield flush(hashes, heads)

    return run


def _stretches(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions as (first, number) of neighbours."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first = np.r_[0, cut] if len(starts) else cut
    return starts[first], np.diff(np.r_[first, len(starts)])


def _parts(window: int, most: int = 1 << 17):
    """Words of each needed run; of hot runs, one row a distinct window, and marks for windows that repeat in this task."""
    names = [c.split()[0] for c in PART.split(", ")]

    def batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        seen: dict[bytes, list] = {}

        def emptied():
            rows = [(int(np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64)), k1, k2, s, 1, w, known) for w, (k1, k2, s, known) in seen.items()]
            seen.clear()
            return batch(rows)

        rows, size = [], 0
        for b in batches:
            k1s, k2s, texts, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)
            ends, flat = lists.offsets.to_numpy(), lists.values
            start_, n_, h_, hot_ = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for i, (k1, k2) in enumerate(zip(k1s, k2s, strict=True)):
                words = WORD_BYTES.findall(texts[i].as_py().encode("utf-8", "surrogatepass"))
                again = []
                for j in range(ends[i], ends[i + 1]):
                    s, n = int(start_[j]), int(n_[j])
                    if not hot_[j]:
                        content = b" ".join(words[s : s + n + window - 1])
                        rows.append((int(h_[j]), k1, k2, s, n, content, False))
                        size += len(content)
                        continue
                    for p in range(s, s + n):
                        content = b" ".join(words[p : p + window])
                        if content in seen:
                            seen[content][3] = True
                            again.append(p)
                        else:
                            seen[content] = [k1, k2, p, False]
                for s, n in zip(*_stretches(np.unique(np.array(again, np.int64))), strict=True):
                    rows.append((int(np.uint64(xxhash.xxh64_intdigest(b"%d %d %d" % (k1, k2, s))).view(np.int64)), k1, k2, int(s), int(n), None, True))
                if size > 4_000_000 or len(rows) > 20_000:
                    yield batch(rows)
                    rows, size = [], 0
                if len(seen) > most:
                    yield emptied()
        yield batch(rows)
        yield emptied()

    return run


def suffix_tree(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``at`` of ``text`` (numbers), cut at ``depth``: their order and the LCP of each with the one before.

    Ranks double their length until ``depth``; every suffix must have that many words. Suffixes of one node are
    neighbours, and a node of depth d is a stretch whose LCPs (but the first) are d or more.
    """
    levels, width = [text], 1
    while width * 2 <= depth:
        low = levels[-1]
        pair = low[:-width] * (int(low.max()) + 1) + low[width:]
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        width *= 2
    top, rest = levels[-1], depth - width
    order = np.lexsort((top[at + rest], top[at]))
    a, b = at[order[1:]], at[order[:-1]]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(2 if k == len(levels) - 1 else 1):
            fits = lcp + (1 << k) <= depth
            x, y = a + np.where(fits, lcp, 0), b + np.where(fits, lcp, 0)
            lcp += np.where(fits & (levels[k][x] == levels[k][y]), 1 << k, 0)
    return order, np.r_[0, lcp] if len(order) else lcp


def _repeats(window: int):
    """Marks of the suffixes below internal nodes of full depth. Rows come sorted by key; the last key waits for the next batch."""

    def solve(table: pa.Table):
        keep = table.filter(pa.compute.is_valid(table["words"]))
        done = table.filter(pa.compute.is_null(table["words"])).select(["k1", "k2", "start", "n"])
        yield from done.to_batches()
        if not keep.num_rows:
            return
        code: dict[bytes, int] = {}
        named = code.setdefault
        ids = np.array([named(w, len(code)) for c in keep["words"].to_pylist() for w in c.split(b" ")], np.int64)
        n = keep["n"].to_numpy().astype(np.int64)
        size = n + window - 1
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[row] + nth
        order, lcp = suffix_tree(ids, at, window)
        deep = lcp >= window  # this suffix and the one before it lie below one node of full depth
        repeat = keep["known"].to_numpy(zero_copy_only=False)[row].astype(bool)
        repeat[order[deep | np.r_[deep[1:], False]]] = True
        hit = np.flatnonzero(repeat)
        if not len(hit):
            return
        place = at[hit] + row[hit]  # a gap between rows: neighbours only within one
        first, number = _stretches(place)
        own = row[hit][np.searchsorted(place, first)]
        start = keep["start"].to_numpy().astype(np.int64)[own] + first - own - begin[own]
        yield pa.RecordBatch.from_arrays([pa.array(keep["k1"].to_numpy()[own]), pa.array(keep["k2"].to_numpy()[own]), pa.array(start.astype(np.int32)), pa.array(number.astype(np.int32))], names=["k1", "k2", "start", "n"])

    def run(batches):
        wait: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            tail = b.column(0)[b.num_rows - 1].as_py()
            wait.append(b)
            size += b.nbytes
            if size > 6_000_000 and tail != last:
                whole = pa.Table.from_batches(wait)
                cut = int(np.searchsorted(whole["key"].to_numpy(), tail))
                if cut:
                    yield from solve(whole.slice(0, cut))
                wait = whole.slice(cut).to_batches()
                size = sum(x.nbytes for x in wait)
            last = tail
        if wait:
            yield from solve(pa.Table.from_batches(wait))

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("__k1", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).withColumn("__k2", F.xxhash64(text))


def repeat_marks(keyed: DataFrame, text_col: str, window: int = 35, gram: int = 8, hot: int = 512) -> DataFrame:
    """(k1, k2, marks array of (start, n)) for documents with suffixes start .. start + n - 1 that occur elsewhere."""
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    runs = stored(keyed.select("__k1", "__k2", text.alias("t")).mapInArrow(released(_runs(window, gram)), RUN), "runs")
    # Written first: joined with plain exchanges on both sides, so that Spark can split a very frequent anchor.
    groups = stored(runs.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h", (F.col("c") > hot).alias("hot")), "anchors")
    needed = runs.join(groups, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n", "h", "hot")).alias("runs"))
    having = keyed.join(needed, (keyed["__k1"] == needed["k1"]) & (keyed["__k2"] == needed["k2"]))
    # All columns go in, though four are read: then this exchange of the documents is the one that the last join uses.
    parts = having.select("k1", "k2", text.alias("t"), "runs", *[keyed[c] for c in keyed.columns]).mapInArrow(released(_parts(window)), PART)
    marks = spread(parts, "key").sortWithinPartitions("key").mapInArrow(released(_repeats(window)), MARK)
    return marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("marks"))


def _covered(n_words: int, marks, window: int) -> np.ndarray | None:
    if not marks:
        return None
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, [m["start"] for m in marks], 1)
    np.add.at(change, [m["start"] + m["n"] + window - 1 for m in marks], -1)
    return np.cumsum(change)[:n_words] > 0


def _report(window: int):
    def run(batches):
        for b in batches:
            rows = []
            for doc, text, marks in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass"))
                gone = _covered(len(words), marks, window)
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``docs``.

    Words are runs of bytes outside space and \\x09-\\x0D, unchanged. A null text has no words. Repeated rows count as
    occurrences of each other and are each returned; a null id is kept; an empty table gives no rows; columns besides
    id and text are not read.
    """
    keyed = _keyed(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")), "__id", "__text")
    marks = repeat_marks(keyed, "__text", window, **how)
    joined = keyed.join(marks, (keyed["__k1"] == marks["k1"]) & (keyed["__k2"] == marks["k2"]), "left")
    return joined.select("__id", "__text", "marks").mapInArrow(released(_report(window)), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cleaned(window: int, at: int, names: list[str]):
    def run(batches):
        for b in batches:
            texts = []
            for text, marks in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if marks:
                    data = text.encode("utf-8", "surrogatepass")
                    spans = [m.span() for m in WORD_BYTES.finditer(data)]
                    kept = np.flatnonzero(~_covered(len(spans), marks, window))
                    first, number = _stretches(kept)
                    text = b"\n".join(data[spans[f][0] : spans[f + n - 1][1]] for f, n in zip(first.tolist(), number.tolist(), strict=True)).decode("utf-8", "surrogatepass")
                texts.append(text)
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, **how) -> DataFrame:
    """``docs`` with its own columns; a text with repeats keeps its other stretches as they stand, one to a line."""
    plain = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])  # no name of theirs meets one of ours
    keyed = _keyed(plain, f"__c{docs.columns.index(id_col)}", f"__c{docs.columns.index(text_col)}")
    marks = repeat_marks(keyed, f"__c{docs.columns.index(text_col)}", window, **how)
    joined = keyed.join(marks, (keyed["__k1"] == marks["k1"]) & (keyed["__k2"] == marks["k2"]), "left")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    return joined.select(*plain.columns, "marks").mapInArrow(released(_cleaned(window, docs.columns.index(text_col), docs.columns)), schema)
