"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits). Two fingerprints at two or fewer differing bits
agree on at least one whole segment (three segments, two errors), and differ by at most two bits in each of the
others. The binary Golay code of length 23 is perfect: every word is within 3 bits of exactly one of its 4,096
codewords. A word decodes to that codeword and, if it is 3 bits away, also to the five codewords 4 bits away; two
words that differ by at most 2 bits always have a codeword in common. So the keys (segment i exactly, a codeword of
segment i + 1) meet for every linked pair, and their 33 or more bits keep chance meetings rare. Candidates that meet
are verified on the whole fingerprints.

Equal fingerprints are one node from the start, so copies never multiply. What a key gathers is linked inside its
task by XOR in blocks and leaves as a spanning forest, never as all pairs. A key with more than ``hot`` fingerprints
is dealt out again with the codewords of the third segment, which linked pairs also share, as a longer key.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, spread, stored
from .components import connected_components, local_components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEED = 42


def fingerprints_of(texts: list[str | None], words: int) -> np.ndarray:
    """The fingerprint of each whole text: bit j is 1 if more than half of its shingles' hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    hashed = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        if not text:
            continue
        w = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower())
        if not w:
            continue
        shingles = map(b" ".join, zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
        h = np.array([hashed(s, SEED) for s in shingles], np.uint64)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):  # a very long text in pieces
            ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, fp long): A-Z are lower-cased, words are runs of bytes outside space and \\x09-\\x0D; null or wordless text: 0."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(b.column(1).to_pylist(), words).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


@lru_cache
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome (11 bits): up to six error patterns of weight 3 or less, or 4, that lead to a codeword; their number."""
    shift = np.zeros(23, np.int64)
    for bit in range(23):
        r = 1 << bit
        for k in range(bit, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        shift[bit] = r
    patterns: list[list[int]] = [[] for _ in range(2048)]
    level = [(0, 0, -1)]
    for weight in range(5):
        for pattern, syndrome, _ in level:
            if weight < 4 or bin(patterns[syndrome][0]).count("1") == 3:
                patterns[syndrome].append(pattern)
        level = [(p | 1 << k, s ^ int(shift[k]), k) for p, s, last in level for k in range(last + 1, 23)]
    table = np.zeros((2048, 6), np.int64)
    for s, found in enumerate(patterns):
        table[s, : len(found)] = found
    return table, np.array([len(x) for x in patterns])


@lru_cache
def _syndromes() -> np.ndarray:
    """Syndrome of every 12-bit high part; the low 11 bits are their own remainder."""
    out = np.zeros(4096, np.int64)
    for high in range(4096):
        r = high << 11
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        out[high] = r
    return out


def codewords(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: the row of each key and the key (the 12 information bits of a codeword)."""
    table, count = golay_keys()
    syndrome = _syndromes()[word >> 11] ^ (word & 2047)
    n = count[syndrome]
    rows = np.repeat(np.arange(len(word)), n)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return rows, (word[rows] ^ table[syndrome[rows], nth]) >> 11


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    at, width = SEGMENTS[k]
    return ((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _keys(batches):
    for b in batches:
        signed = b.column(0).to_numpy()
        fp = signed.view(np.uint64)
        for i in range(3):
            rows, code = codewords(_segment(fp, (i + 1) % 3))
            key = _segment(fp, i)[rows] << 16 | code << 4 | i
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(signed[rows])], names=["key", "fp"])


def _longer(batches):
    for b in batches:
        key, signed = b.column(0).to_numpy(), b.column(1).to_numpy()
        fp = signed.view(np.uint64)
        for i in range(3):
            own = np.flatnonzero(key & 15 == i)
            rows, code = codewords(_segment(fp[own], (i + 2) % 3))
            yield pa.RecordBatch.from_arrays([pa.array(key[own][rows] << 12 | code | 1 << 62), pa.array(signed[own][rows])], names=["key", "fp"])


def _linked(max_bits: int):
    limit = np.uint8(max_bits)

    def edges_of(fp: np.ndarray):
        fp = np.unique(fp)
        n, block = len(fp), 2048
        label = np.arange(n)
        for i in range(0, n, block):
            for j in range(i, n, block):
                a, b = np.nonzero(np.bitwise_count(fp[i : i + block, None] ^ fp[None, j : j + block]) <= limit)
                a, b = a + i, b + j
                keep = label[a] != label[b]
                label = label[local_components(label[a[keep]], label[b[keep]], n)]
        child = np.flatnonzero(label != np.arange(n))
        return fp[child], fp[label[child]]

    def run(batches):
        """Rows come sorted by key; the last key of a batch waits for the next batch."""
        wait_key, wait = None, []

        def ready(key, fp):
            cut = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(key)]
            size = ends - starts
            out_a, out_b = [], []
            two = starts[size == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= limit
            out_a.append(fp[two][near])
            out_b.append(fp[two + 1][near])
            for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
                a, b = edges_of(fp[s:e])
                out_a.append(a)
                out_b.append(b)
            return np.concatenate(out_a), np.concatenate(out_b)

        def batch_of(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for b in batches:
            key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            if wait_key is not None:
                wait.append((key, fp))
                if key[-1] == wait_key:
                    continue
                key, fp = (np.concatenate(x) for x in zip(*wait, strict=True))
            last = np.searchsorted(key, key[-1])
            wait_key, wait = key[-1], [(key[last:], fp[last:])]
            if last:
                yield batch_of(*ready(key[:last], fp[:last]))
        if wait:
            yield batch_of(*ready(*(np.concatenate(x) for x in zip(*wait, strict=True))))

    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = 2, hot: int = 4096) -> DataFrame:
    """Spanning edges (src, dst: fingerprints) of all links at ``max_bits`` (2 at most) or fewer differing bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys guarantee links of up to 2 differing bits")
    keys = stored(distinct.select("fp").mapInArrow(_keys, "key long, fp long"), "golay")
    busy = keys.groupBy("key").count().filter(F.col("count") > hot).select("key")
    usual = keys.join(busy, "key", "left_anti")
    longer = keys.join(busy, "key", "left_semi").select("key", "fp").mapInArrow(_longer, "key long, fp long")
    dealt = spread(usual.select("key", "fp").union(longer), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_linked(max_bits), "src long, dst long")


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest id reachable over links of ``max_bits`` or fewer differing bits. Null, empty and
    wordless texts have fingerprint zero and are linked like any other; a text of fewer than ``words`` words is one
    shingle; a repeated row is returned as often as it occurs; rows with a null id are kept with a null
    component_id; an empty table gives an empty one; columns besides id and text are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    members = connected_components(fingerprint_links(nodes, max_bits))
    tied = members.join(nodes, members.node == nodes.fp).select("fp", "component", "least")
    top = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = stored(tied.join(top, "component").select("fp", "component_id"), "linked")
    placed = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(placed, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
