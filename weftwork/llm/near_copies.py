"""One document of each group of near-copies, by wide SimHash fingerprints and Golay-code keys.

A similarity of 0.8 (Jaccard, five-word shingles) differs in about 15 of 100 SimHash bits, far beyond two bits of 64.
So the fingerprint is wider here (``WIDTH`` bits, from one hash per shingle mixed into several words), and pairs meet
by many keys instead of by a guarantee: each key joins a codeword near 23 sampled bits (one to six keys, as in
:mod:`simhash`) with some more bits exactly. The exact bits grow with the logarithm of the rows, so that the rows behind
a key do not grow, and the keys with them, so that a pair of similarity 0.8 always meets with a chance of about 0.95
(one of 0.9 with 0.99 and more); :func:`keys_for` has the rule. Pairs that meet are admitted by the whole fingerprint, which travels with the key, and
then decided by the exact similarity of their shingle sets.

Rows of equal shingles are one node. Large groups behind one key give spanning forests of their candidates, small ones
all. Of a row's candidates the one with the smallest id is decided first, so these pairs are fewer than the rows. Where
candidates then still stand in different groups, as in many texts of one template that are alike but below 0.8, the groups meet
again by their rarest shingles, which is exact: two sets of similarity t share one of the first n - ceil(t n) + 1 shingles
in any common order, and their first common one leaves enough behind it in both. Pairs below t mostly fail that bound.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, released, spread, stored, swept
from .components import connected_components, local_components
from .simhash import SEED, codewords

LANES = 4
WIDTH = 64 * LANES
#: Rows behind a key that the exact bits aim at, by the rows' number; at least so many exact bits.
BEHIND, LEAST_BITS = 64, 8
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
NAMES = ["id", *[f"w{k}" for k in range(LANES)]]


def wide_fingerprints(texts: list[str | None], words: int) -> np.ndarray:
    """(texts, LANES) words; null and wordless texts are all zero."""
    out = np.zeros((len(texts), LANES), np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    hashed = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        w = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
        if not w:
            continue
        shingles = map(b" ".join, zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
        h = np.array([hashed(s, SEED) for s in shingles], np.uint64)
        for lane in range(LANES):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 15):
                x = h[at : at + (1 << 15)] * _MIX[lane]
                x ^= x >> np.uint64(32)
                x *= _MIX[lane - 1]
                x ^= x >> np.uint64(29)
                ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i, lane] = powers[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; none for null and wordless texts."""
    w = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    shingles = map(b" ".join, zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)] if w else []
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64))


def _digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


def _prints(words: int):
    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            wide = wide_fingerprints(texts, words).view(np.int64)
            digest = np.array([_digest(shingle_hashes(t, words)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(wide[:, k])) for k in range(LANES)], pa.array(digest)], names=[*NAMES, "digest"])

    return run


def _sets(words: int):
    def run(batches):
        for b in batches:
            sets = [shingle_hashes(t, words) for t in b.column(1).to_pylist()]
            digest = np.array([_digest(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["id", "digest", "hashes"])

    return run


def shared_codeword(share: float) -> float:
    """Chance that two words of 23 bits have a codeword in common if each bit differs with chance ``share``.

    Words at 2 or fewer bits always do; farther ones by their weights around the codewords, taken from random words.
    """
    rng = np.random.default_rng(5)
    word = rng.integers(0, 1 << 23, 4000)
    other = word ^ ((rng.random((4000, 23)) < share) @ (1 << np.arange(23)))
    left, right = ([set() for _ in word] for _ in range(2))
    for sets, words in ((left, word), (right, other)):
        for r, c in zip(*codewords(words), strict=True):
            sets[r].add(int(c))
    return float(np.mean([bool(a & b) for a, b in zip(left, right, strict=True)]))


def keys_for(rows: int, similarity: float, miss: float = 0.05) -> tuple[int, int]:
    """(exact bits, number of keys): 2^(12 + bits) values for ``rows``, and a chance of ``miss`` that a pair of ``similarity`` never meets."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1, rows / BEHIND)))) - 12)
    meet = shared_codeword(share) * (1 - share) ** bits
    return bits, max(20, int(np.ceil(np.log(miss) / np.log1p(-meet))))


@lru_cache
def _sampled(bits: int, tables: int) -> np.ndarray:
    """Bit places of each key: 23 for the codeword, then the exact ones; fixed for all runs."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(WIDTH)[: 23 + bits] for _ in range(tables)])


def _keys(exact_bits: int, tables: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                wide = np.stack([b.column(1 + k).to_numpy() for k in range(LANES)], 1)
                bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                for t, places in enumerate(_sampled(exact_bits, tables)):
                    word = bits[:, places[:23]] @ (1 << np.arange(23))
                    exact = bits[:, places[23:]] @ (1 << np.arange(exact_bits))
                    rows, code = codewords(word)
                    key = (t << 40) | (exact[rows] << 12) | code
                    yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(b.column(k).to_numpy()[rows]) for k in range(2 + LANES)]], names=["key", *NAMES, "component"])

    return run


def _within(limit: int):
    """Whether fingerprints differ in at most ``limit`` bits."""
    return lambda a, b: np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= limit


def _room(similarity: float):
    """Whether sets of (size, rest from the common shingle on) can still share enough for ``similarity``."""
    share = similarity / (1 + similarity)
    return lambda a, b: np.minimum(a[..., 1], b[..., 1]) >= share * (a[..., 0] + b[..., 0]) - 1e-6


def _meet(near, turn: int | None, width: int = LANES, group: int = 8):
    """Candidates (src, dst, part): ids of different components with one key for whose ``width`` columns ``near`` holds.

    Rows (key, id, columns, component) come sorted by key and id. Of a group of more than ``group`` rows only a spanning forest of candidates is
    taken (part 1), grown in an order that changes with ``turn``; without a turn all of them are.
    """

    def large(ids, wide, label):
        n, pairs = len(ids), []
        if turn:
            order = np.argsort(ids.view(np.uint64) * _MIX[turn % LANES], kind="stable")
            ids, wide, label = ids[order], wide[order], label[order]
        label = np.unique(label, return_inverse=True)[1]
        left, waiting = label.max() + 1, 0
        for i in range(n - 1):
            if left == 1:
                break
            j = i + 1 + np.flatnonzero(near(wide[i], wide[i + 1 :]))
            j = j[label[j] != label[i]]
            if not len(j):
                continue
            if turn is not None:
                j = j[np.unique(label[j], return_index=True)[1]]
                label[np.isin(label, label[j])] = label[i]
                left -= len(j)
            pairs.append((np.full(len(j), ids[i]), ids[j]))
            waiting += len(j)
            if waiting > 100_000:
                yield batch(pairs, turn is not None)
                pairs, waiting = [], 0
        yield batch(pairs, turn is not None)

    def batch(pairs, part):
        a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), int(part)))], names=["src", "dst", "part"])

    def ready(key, ids, wide, label):
        start = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
        size = np.diff(np.r_[start, len(key)])
        of, out = np.repeat(size, size), []
        rows, lag = np.flatnonzero((of > 1) & (of <= group)), 1
        while len(rows):
            rows = rows[rows + lag < len(key)]
            rows = rows[key[rows] == key[rows + lag]]
            hit = rows[near(wide[rows], wide[rows + lag]) & (label[rows] != label[rows + lag])]
            out.append((ids[hit], ids[hit + lag]))
            lag += 1
        yield batch(out, False)
        for s, n in zip(start[size > group], size[size > group], strict=True):
            yield from large(ids[s : s + n], wide[s : s + n], label[s : s + n])

    def run(batches):
        wait: list[tuple] = []
        for r in batches:
            if not r.num_rows:
                continue
            part = (r.column(0).to_numpy(), r.column(1).to_numpy(), np.stack([r.column(2 + k).to_numpy() for k in range(width)], 1).view(np.uint64), r.column(2 + width).to_numpy())
            if wait and part[0][-1] == wait[-1][0][-1]:
                wait.append(part)
                continue
            key, ids, wide, label = (np.concatenate(c) for c in zip(*wait, part, strict=True))
            last = np.searchsorted(key, key[-1])
            if last:
                yield from ready(key[:last], ids[:last], wide[:last], label[:last])
            wait = [(key[last:], ids[last:], wide[last:], label[last:])]
        if wait:
            yield from ready(*(np.concatenate(c) for c in zip(*wait, strict=True)))

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, name: str, most: int = 500) -> DataFrame:
    """``pairs`` with the set of their ``end``. An id of more than ``most`` pairs has several copies of its set."""
    hot = pairs.groupBy(F.col(end).alias("hot")).agg(F.ceil(F.count("*") / most).alias("copies")).filter("copies > 1")
    hot = F.broadcast(hot)  # at most one row for ``most`` pairs
    other = "dst" if end == "src" else "src"
    dealt = pairs.join(hot, pairs[end] == F.col("hot"), "left").withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1)))).drop("hot", "copies")
    many = sets.join(hot, sets["id"] == F.col("hot"), "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)))
    many = many.select(F.col("id").alias(end), "copy", F.col("hashes").alias(name))
    return dealt.join(many, [end, "copy"]).drop("copy")


def _verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(src, dst, part, ok): whether the exact similarity of the pair's shingle sets is at least ``similarity``."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    sets = rows.join(ends, "id", "left_semi").mapInArrow(released(_sets(words)), "id long, digest long, hashes array<long>")
    sets = stored(sets.dropDuplicates(["id", "digest"]).select("id", "hashes"), "sets")
    both = _with_sets(_with_sets(pairs, sets, "src", "a"), sets, "dst", "b")
    shared = F.size(F.array_intersect("a", "b"))
    both = both.select("src", "dst", "part", shared.alias("shared"), (F.size("a") + F.size("b")).alias("sizes"))
    ok = F.coalesce(F.try_divide("shared", F.col("sizes") - F.col("shared")) >= similarity, F.lit(False))
    # An id that occurs with several texts counts by its best one.
    return both.groupBy("src", "dst", "part").agg(F.max(ok).alias("ok"))


def _rarest(live: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, id, digest, size, rest): the rarest shingles of each node of ``live`` (id, digest), in the order of their number among them.

    ``rest`` is the number of the node's shingles from this one on. As many are taken as two sets of ``similarity`` need
    to meet; a shingle of a single node is left out, as nothing meets there.
    """
    sets = rows.join(live.select("id").distinct(), "id", "left_semi").mapInArrow(released(_sets(words)), "id long, digest long, hashes array<long>")
    each = stored(sets.join(live.select("id", "digest"), ["id", "digest"]).dropDuplicates(["id", "digest"]).select("id", "digest", F.explode("hashes").alias("key")), "shingles")
    held = each.groupBy("key").agg(F.count("*").alias("n"))
    ordered = each.join(held, "key").groupBy("id", "digest").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"))
    size = F.size("own").cast("long")
    first = F.slice("own", F.lit(1), F.size("own") - F.ceil(F.size("own") * similarity - 1e-6).cast("int") + 1)
    return ordered.select("id", "digest", size.alias("size"), F.posexplode(first).alias("at", "own")).filter("own.n > 1").select("own.key", "id", "digest", "size", (F.col("size") - F.col("at")).alias("rest"))


def _apart(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b), a < b: different components that ``pairs`` has a pair between."""
    at = placed.select("id", "component")
    ends = pairs.join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst").filter("a <> b")
    return ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, turns: int = 2) -> DataFrame:
    """(doc_id, component_id) for rows with an id: the smallest id reachable over links of ``similarity`` or more.

    Null, empty and wordless texts are one group. A link is a pair that meets behind a key, differs in at most as many
    bits as the similarity's angle plus three standard deviations, and has the similarity on its shingle sets. The
    large groups of a key give a spanning forest of candidates, and each row tries its smallest partner. Components that
    have candidates between them, and are still apart then, meet again by their rarest shingles (see above), in ``turns``
    turns of which the last tries all remaining candidates, the ones before forests.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    limit = int(WIDTH * share + 3 * (share * (1 - share) * WIDTH) ** 0.5)
    same = [*NAMES[1:], "digest"]
    long = lambda *names: ", ".join(f"{n} long" for n in names)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("id is not null")
    prints = stored(rows.mapInArrow(released(_prints(words)), long(*NAMES, "digest")), "wide")
    nodes = stored(prints.groupBy(*same).agg(F.min("id").alias("id")).select(*NAMES, "digest"), "nodes")
    bits, tables = keys_for(nodes.count(), similarity)
    placed, tried, rarest = nodes.withColumn("component", F.col("id")), None, None
    for turn in [*range(turns), None]:
        if tried is None:
            met = nodes.select(*NAMES, F.col("id").alias("component")).mapInArrow(released(_keys(bits, tables)), long("key", *NAMES, "component"))
            near, width = _within(limit), LANES
        else:
            met = rarest.join(live, ["id", "digest"]).select("key", "id", "size", "rest", "component")
            near, width = _room(similarity), 2
        pairs = spread(met, "key").sortWithinPartitions("key", "id").mapInArrow(_meet(near, turn, width), long("src", "dst", "part")).groupBy("src", "dst").agg(F.max("part").alias("part"))
        if tried is None:
            first = stored(pairs, "candidates")
            pairs = first.groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst", F.lit(1).cast("long").alias("part"))
        elif turn is None:
            pairs = pairs.join(tried.select("src", "dst"), ["src", "dst"], "left_anti")
        new = stored(_verified(stored(pairs, "pairs"), rows, words, similarity), "tried")
        left = first if tried is None else new.filter("not ok and part = 1")
        tried = new if tried is None else tried.union(new)
        if not new.filter("ok").isEmpty():
            top = connected_components(tried.filter("ok").select("src", "dst"))
            placed = stored(nodes.join(top, nodes["id"] == top["node"], "left").select(*NAMES, "digest", F.coalesce("component", "id").alias("component")), "placed")
        swept(docs.sparkSession)
        if turn is None:
            break
        again = stored(_apart(left, placed), "apart")
        if again.isEmpty():
            break
        again = again.select(F.explode(F.array("a", "b")).alias("component")).distinct()
        live = stored(placed.join(again, "component", "left_semi").select("id", "digest", "component"), "again")
        rarest = stored(_rarest(live, rows, words, similarity), "rarest") if rarest is None else rarest
    placed = placed.select(*same, F.col("component").alias("component_id"))
    return prints.join(placed, same).select(F.col("id").alias("doc_id"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose group has a smaller id; columns as they are.

    Rows with a null id stay. A repeated row (same id) stays as often as it occurs.
    """
    groups = near_copy_groups(docs, id_col, text_col, words, similarity)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti").select(*docs.columns)
