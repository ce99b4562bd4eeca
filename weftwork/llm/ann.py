"""Approximate nearest neighbours: a forest of random-projection trees behind one priority queue, then exact reranking.

The forest is fitted on a bounded sample (``sample`` rows, those with the smallest hash of their id): every level of a
tree has one random direction, every node the median of its sampled rows on it. The depth grows with the number of rows
until a leaf holds ``leaf`` of them, or four sampled rows. What is broadcast is bounded: trees x depth directions and
trees x 2^depth medians. Every row is indexed: each tree sends it to one leaf. A query keeps one priority queue over all
trees; the branch with the smallest margin so far is opened next, until ``visits`` leaves are open. Where ``visits`` is
not given, it is the number that ``recall`` of the true neighbours within the sample need, measured on some sampled rows.

Search is two joins by equality, and nothing meets everything:

1. Rows are packed into blocks, in the order of the first tree's leaves, and written once. Each block lists, by tree
   and node, its rows' places and leaves. These lists join the nodes that the queries open, on (tree, node, salt), and
   give the places in open leaves; a node with many lists has several salts. Nodes are leaves where few leaves hold the
   neighbours; otherwise they are the deepest ones of which the audited rows open at most MOST_NODES on average.
2. The places found by all trees for a query in a block are united, and join the block's vectors on (block, part); a
   block with many queries has several parts. Distances are exact, in double precision, on the original vectors. A
   block returns a query's ``k`` nearest only.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, released, stored

FOUND = "query_id long, vec_id long, score double"
#: Size of a block's vectors, and the most rows that a place of 16 bits can tell apart.
BLOCK_BYTES, MOST_PLACES = 16 << 20, 1 << 16
#: Nodes that a query's open leaves lie in, on average at most: the rows of a query in the first join.
MOST_NODES = 384


class Forest:
    """Complete trees: node k has children 2k + 1 and 2k + 2; a leaf's number is its place in the last level."""

    def __init__(self, x: np.ndarray, trees: int, depth: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.direction = rng.standard_normal((trees, depth, x.shape[1]))
        self.direction /= np.linalg.norm(self.direction, axis=2, keepdims=True)
        self.median = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            parts = [np.arange(len(x))]
            for level in range(depth):
                p = self.along(x, t, level)
                cuts = np.array([np.median(p[rows]) if len(rows) else 0.0 for rows in parts])
                self.median[t, (1 << level) - 1 : (2 << level) - 1] = cuts
                parts = [side for rows, cut in zip(parts, cuts, strict=True) for side in (rows[p[rows] < cut], rows[p[rows] >= cut])]

    def along(self, x: np.ndarray, tree: int, level: int) -> np.ndarray:
        """Not a matrix product: its last digits would depend on the number of rows, and a copy could reach another leaf."""
        return (x * self.direction[tree, level]).sum(1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (self.along(x, t, level) >= self.median[t, node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def opened(self, q: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """The ``visits`` (tree, leaf) with the smallest margins over all trees together, in the order of the queue."""
        place = (self.direction * q).sum(2).tolist()
        inner = (1 << self.depth) - 1
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        out: list[tuple[int, int]] = []
        while queue and len(out) < visits:
            worst, t, node, level = heapq.heappop(queue)
            if node >= inner:
                out.append((t, node - inner))
                continue
            margin = place[t][level] - self.median[t, node]
            near = 2 * node + (2 if margin >= 0 else 1)
            heapq.heappush(queue, (worst, t, near, level + 1))
            heapq.heappush(queue, (max(worst, abs(margin)), t, 4 * node + 3 - near, level + 1))
        return out

    def margins(self, q: np.ndarray) -> np.ndarray:
        """(tree, leaf): the margin at which the queue reaches each leaf."""
        place, cost = (self.direction * q).sum(2), np.zeros((self.trees, 1))
        for level in range(self.depth):
            m = place[:, level, None] - self.median[:, (1 << level) - 1 : (2 << level) - 1]
            cost = np.stack([np.maximum(cost, np.maximum(m, 0)), np.maximum(cost, np.maximum(-m, 0))], 2).reshape(self.trees, -1)
        return cost


def visits_for(forest: Forest, x: np.ndarray, k: int, recall: float, tried: int = 100) -> int:
    """Leaves to open so that ``recall`` of the ``k`` nearest of ``tried`` rows of ``x``, among ``x``, are reached."""
    leaf, nth, need = forest.leaves(x), np.arange(forest.trees), []
    for i in range(min(tried, len(x))):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)] if len(x) > 1 else []
        cost = forest.margins(x[i])
        level = np.sort(cost, axis=None)
        need += [int(np.searchsorted(level, cost[nth, leaf[j]].min(), side="right")) for j in near]
    return max([forest.trees, *([int(np.quantile(need, recall, method="higher"))] if need else [])])


def levels_below(forest: Forest, x: np.ndarray, visits: int, tried: int = 30) -> int:
    """Levels from the joined nodes down to the leaves."""
    opened = [forest.opened(q, visits) for q in x[:tried]]
    for below in range(forest.depth):
        if np.mean([len({(t, leaf >> below) for t, leaf in o}) for o in opened]) <= MOST_NODES:
            return below
    return forest.depth


def valid(vector: str):
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column; all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _first_leaf(forest):
    """Rows with their leaf in the first tree."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forest.value.leaves(_matrix(b.column(1)))[:, 0])], names=["id", "v", "leaf"])

    return run


def _blocks(size: int):
    """Rows of a task packed ``size`` to a block: (block, ids, vectors), vectors in the type they came in."""

    def run(batches):
        import hashlib

        ids, vectors, have = [], [], 0

        def one():
            own, x = np.concatenate(ids), np.concatenate(vectors)
            name = hashlib.blake2b(own.tobytes() + x.tobytes(), digest_size=8).digest()  # the same if the task runs again
            return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(name, "little", signed=True)], pa.int64()), pa.array([own.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "vectors"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, size - have)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                ids.append(part.column(0).to_numpy().astype(np.int64))
                vectors.append(flat.reshape(part.num_rows, -1))
                have, at = have + part.num_rows, at + part.num_rows
                if have == size:
                    yield one()
                    ids, vectors, have = [], [], 0
        if have:
            yield one()

    return run


def _unpacked(ids: bytes, vectors: bytes, kind) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vectors, kind).reshape(len(own), -1).astype(np.float64)


def _lists(forest, kind, below: int):
    """(tree, node, block, places, leaves) of each block, in the order of leaves; leaves are numbered within their node."""

    def run(batches):
        for b in batches:
            for block, ids, vectors in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                leaf = forest.value.leaves(_unpacked(ids, vectors, kind)[1])
                for t in range(leaf.shape[1]):
                    order = np.argsort(leaf[:, t], kind="stable")
                    of = leaf[order, t]
                    node, first = np.unique(of >> below, return_index=True)
                    cut = lambda v: pa.array([p.astype(np.uint16).tobytes() for p in np.split(v, first[1:])], pa.binary())  # noqa: B023, E731
                    n = len(node)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(node.astype(np.int32)), pa.array(np.full(n, block)), cut(order), cut(of & ((1 << below) - 1))], names=["tree", "node", "block", "places", "leaves"])

    return run


def _opened(forest, visits: int, below: int):
    """(tree, node, query_id, open): the open leaves of each node, numbered within it."""

    def run(batches):
        for b in batches:
            for query, vector in zip(b.column(0).to_pylist(), _matrix(b.column(1)), strict=True):
                nodes: dict[tuple[int, int], list[int]] = {}
                for t, leaf in forest.value.opened(vector, visits):
                    nodes.setdefault((t, leaf >> below), []).append(leaf & ((1 << below) - 1))
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in nodes], pa.int32()), pa.array([n for _, n in nodes], pa.int32()), pa.array(np.full(len(nodes), query, np.int64)), pa.array([np.array(v, np.uint16).tobytes() for v in nodes.values()], pa.binary())], names=["tree", "node", "query_id", "open"])

    return run


def _in_open(below: int):
    """(block, query_id, places): the places whose leaf is open."""

    def run(batches):
        is_open = np.zeros(1 << below, bool)
        for b in batches:
            found = []
            for places, leaves, opened in zip(*(b.column(c).to_pylist() for c in ("places", "leaves", "open")), strict=True):
                now = np.frombuffer(opened, np.uint16)
                is_open[now] = True
                found.append(np.frombuffer(places, np.uint16)[is_open[np.frombuffer(leaves, np.uint16)]].tobytes())
                is_open[now] = False
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("block")), b.column(b.schema.get_field_index("query_id")), pa.array(found, pa.binary())], names=["block", "query_id", "places"])

    return run


def _nearest(k: int, kind):
    """Rows of one part of a block, the block's own row (no query) first; then its queries with the places to look at."""

    def run(batches):
        ids = x = None
        for b in batches:
            out = [], [], []
            for query, own, vectors, vector, places in zip(*(b.column(c).to_pylist() for c in ("query_id", "ids", "vectors", "v", "places")), strict=True):
                if own is not None:
                    ids, x = _unpacked(own, vectors, kind)
                    continue
                near = np.unique(np.frombuffer(b"".join(places), np.uint16))
                near = near[ids[near] != query]
                d = np.sqrt(((x[near] - np.array(vector)) ** 2).sum(1))
                if len(near) > k:
                    keep = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                    near, d = near[keep], d[keep]
                top = np.lexsort((ids[near], d))[:k]
                for c, v in zip(out, (np.full(len(top), query), ids[near][top], d[top]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, t), type=a) for c, t, a in zip(out, (np.int64, np.int64, float), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def candidates(vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, trees: int = 24, leaf: int = 64, visits: int | None = None, recall: float = 0.95, sample: int = 16_384, block: int | None = None):
    """What a search looks at: (blocks, queries, asks, type), asks with the places that each query has in each block; None without rows.

    A block has ``block`` rows, by default as many as BLOCK_BYTES hold, so that a leaf's rows lie in few blocks.
    """
    context = vectors.sparkSession.sparkContext
    rows = vectors.filter(valid(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").head(1)
    if not widths:
        return None
    width, total = widths[0]
    rows = rows.filter(F.size("v") == width)
    kind = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    rows = rows.select("id", F.col("v").cast("array<float>" if kind == np.float32 else "array<double>").alias("v"))
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = _matrix(fitted["v"].combine_chunks())
    depth = max(0, min(int(np.ceil(np.log2(max(1, total / leaf)))), int(np.log2(max(1, len(x) / 4)))))
    own = Forest(x, trees, depth)
    visits = visits or visits_for(own, x, k, recall)
    forest = context.broadcast(own)
    plain = "array<float>" if kind == np.float32 else "array<double>"
    located = rows.mapInArrow(_first_leaf(forest), f"id long, v {plain}, leaf int")
    block = min(MOST_PLACES, block or max(256, BLOCK_BYTES // (np.dtype(kind).itemsize * width)))
    # A range of leaves a block: a leaf of many equal vectors is dealt over several by the hash of the id.
    # Read by as many tasks as there are blocks, however many partitions the exchange has: small blocks make many lists.
    tasks = max(4, -(-total // block))
    ordered = located.repartitionByRange(tasks, "leaf", F.xxhash64("id")).sortWithinPartitions("leaf").coalesce(tasks)
    blocks = stored(ordered.select("id", "v").mapInArrow(_blocks(block), "block long, ids binary, vectors binary"), "blocks")
    asked = stored(rows.filter(queries).groupBy("id").agg(F.min("v").alias("v")), "asked")
    below = levels_below(own, x, visits)
    lists = stored(blocks.mapInArrow(_lists(forest, kind, below), "tree int, node int, block long, places binary, leaves binary"), "lists")
    salts = lists.groupBy("tree", "node").agg(F.ceil(F.count("*") / 1000).alias("salts"))  # at most trees x leaves rows: bounded by the parameters
    listed = lists.join(F.broadcast(salts), ["tree", "node"]).withColumn("salt", F.pmod(F.xxhash64("block"), "salts")).drop("salts")
    opened = asked.mapInArrow(_opened(forest, visits, below), "tree int, node int, query_id long, open binary")
    opened = opened.join(F.broadcast(salts), ["tree", "node"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    met = listed.join(opened, ["tree", "node", "salt"]).mapInArrow(_in_open(below), "block long, query_id long, places binary")
    asks = met.filter(F.length("places") > 0).groupBy("block", "query_id").agg(F.collect_list("places").alias("places"))  # at most one list a tree and node
    return blocks, asked, asks, kind


def nearest(vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, part: int = 512, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that the condition ``queries`` picks.

    ``queries`` is a condition on ``id`` and ``v``. score is the Euclidean distance; ties go to the smaller id, and rows
    with the query's own id are no neighbours of it. Null, zero and non-finite vectors take no part, nor do null ids or
    vectors of another length than most; a query with fewer candidates returns them all. An id that is asked for
    several times is one query (of several vectors the smallest); a repeated row counts as a neighbour each time. An
    empty table gives no rows; other columns are not read. ``how``: see :func:`candidates`.
    """
    found = candidates(vectors, queries, id_col, vector_col, k, **how)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks, asked, asks, kind = found
    asks = stored(asks.join(asked, asked["id"] == asks["query_id"]).select("block", "query_id", "v", "places"), "asks")
    parts = asks.groupBy("block").agg(F.ceil(F.count("*") / part).alias("parts"))
    dealt = asks.join(parts, "block").select("block", F.pmod(F.xxhash64("query_id"), "parts").alias("part"), "query_id", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("vectors"), F.col("v").cast("array<double>").alias("v"), "places")
    copies = blocks.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("query_id"), "ids", "vectors", F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("array<binary>").alias("places"))
    met = copies.union(dealt).repartition(parallelism(vectors.sparkSession), "block", "part").sortWithinPartitions("block", "part", F.col("query_id").asc_nulls_first())
    near = met.mapInArrow(released(_nearest(k, kind)), FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
