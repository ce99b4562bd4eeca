"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node with a weight, so copies never multiply. Nodes are dealt to shards of bounded size; each
shard's graph is built, audited and written in one task. The audit searches a bounded sample (``audit`` nodes of all
shards and as many of its own, those with the smallest hash of their id, and a planted near copy of each own one) and
compares with all products, without a node's hit on itself: the shard's beam is widened until ``recall`` of the links are found, and a shard where no beam finds them is searched by products.
Nodes that no path of the graph's lowest layer reaches are kept beside it and compared with every query.

Every block of nodes is then searched in every shard (the blocks stream past a graph). A search whose beam holds links
only is repeated with a wider beam. Cosines are verified in double precision; links leave a task as weighted counts and
as a spanning forest per block, never as all pairs, and the forests are united by connected components.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import _matrix, valid
from .common import parallelism, released, stored
from .components import connected_components, local_components

#: What a task holds at a time besides its graph: bytes of the marks of seen nodes, cells of beams, pairs of vectors by bytes.
SEEN_BYTES, CELLS, PAIR_BYTES = 16 << 20, 1 << 18, 1 << 20
#: Ties that a block collects before they are shrunk to a forest.
MOST_TIES = 50_000
#: A graph travels in rows of about so many bytes.
PIECE_BYTES = 4 << 20


class Graph:
    """Layers of neighbour lists over unit vectors. Layers are built from the top; the layer above gives entry points."""

    def __init__(self, x: np.ndarray, links: int = 12, beam: int = 48, seed: int = 11) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        self.links, n = links, len(x)
        height = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # nodes of the layer, neighbour table by node
        for level in range(int(height.max(initial=0)), -1, -1):
            self.grow(np.flatnonzero(height >= level), 2 * links if level == 0 else links, beam)

    def grow(self, nodes: np.ndarray, width: int, beam: int) -> None:
        table = np.full((len(self.x), width), -1, np.int32)
        at, have = 0, nodes[:0]
        while at < len(nodes):
            new = nodes[at : at + min(512, max(64, at // 2))]
            at += len(new)
            own = self.x[new] @ self.x[new].T
            np.fill_diagonal(own, -2)
            k = min(self.links, len(new) - 1)
            near = np.argpartition(-own, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(new), 0), int)
            ids, sims = new[near], np.take_along_axis(own, near, 1)
            if len(have):
                found, score = self.beam(self.x[new], table, self.entries(self.x[new], have), beam)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, score], 1)
            self.link(table, new, ids, sims, min(self.links, width))
            have = nodes[:at]
        self.layers.append((nodes, table))

    def link(self, table, new, ids, sims, most) -> None:
        chosen = self.select(ids, sims, most)
        table[new, : chosen.shape[1]] = chosen
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(hit), 256):
            h, f, c = hit[at : at + 256], first[at : at + 256], count[at : at + 256]
            width = min(int(c.max(initial=0)), 4 * table.shape[1])
            nth = np.arange(width)
            take = np.minimum(f[:, None] + nth, len(source) - 1)
            more = np.where(nth < c[:, None], source[take], -1)
            both = np.concatenate([table[h], more], 1)
            score = np.where(both >= 0, np.einsum("bcd,bd->bc", self.x[both], self.x[h]), -2)
            table[h] = self.select(both, score, table.shape[1])

    def select(self, ids, sims, most) -> np.ndarray:
        """Up to ``most`` neighbours: first those that are nearer to the node than to a chosen one, then the nearest rest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        fine = (ids >= 0) & (sims > -2)
        v = self.x[ids]
        among = v @ v.transpose(0, 2, 1)
        keep = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            keep[:, c] = fine[:, c] & ~(keep & (among[:, c] > sims[:, c, None])).any(1) & (keep.sum(1) < most)
        rank = np.where(keep, 0, np.where(fine, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        best = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(fine, best, 1), np.take_along_axis(ids, best, 1), -1).astype(np.int32)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def entries(self, q: np.ndarray, among: np.ndarray) -> np.ndarray:
        start = None
        for nodes, table in self.layers:
            at = np.full((len(q), 1), nodes[0]) if start is None else start
            start = self.beam(q, table, at, 4)[0][:, :1]
        return np.full((len(q), 1), among[0]) if start is None else np.where(np.isin(start, among), start, among[0])

    def fits(self, width: int) -> int:
        """Queries that are searched together with a beam of ``width``."""
        return max(1, min(SEEN_BYTES // max(1, len(self.x)), CELLS // (width + max(192, width))))

    def beam(self, q: np.ndarray, table: np.ndarray, start: np.ndarray, width: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of up to ``width`` nearest found of each query, nearest first; -1 and -2 where fewer."""
        b, n, fit, step = len(q), len(self.x), self.fits(width), max(step, width // 24)
        if b > fit:
            parts = [self.beam(q[at : at + fit], table, start[at : at + fit], width, step) for at in range(0, b, fit)]
            return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
        ids = np.full((b, width), -1, np.int32)
        sims = np.full((b, width), -2, np.float32)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.einsum("bcd,bd->bc", self.x[start], q)
        done = ids < 0
        seen = np.zeros(b * n, bool)
        seen[np.arange(b)[:, None] * n + start] = True
        live = np.arange(b)
        while len(live):
            open_ = np.where(done[live], -3, sims[live])
            k = min(step, width)
            pick = np.argpartition(-open_, k - 1, axis=1)[:, :k] if k < width else np.tile(np.arange(width), (len(live), 1))
            fresh = np.take_along_axis(open_, pick, 1) > -2
            some = fresh.any(1)
            live, pick, fresh = live[some], pick[some], fresh[some]
            if not len(live):
                break
            rows = live[:, None]
            done[rows, pick] = True
            near = np.where(fresh[:, :, None], table[ids[rows, pick]], -1).reshape(len(live), -1)
            near.sort(axis=1)
            good = near >= 0
            good[:, 1:] &= near[:, 1:] != near[:, :-1]  # one node can be a neighbour of several opened ones
            place = rows * n + near
            good &= ~seen[place]
            cell = np.flatnonzero(good)
            seen[place.ravel()[cell]] = True
            score = np.full(near.shape, -2, np.float32)
            score.ravel()[cell] = self.similar(near.ravel()[cell], q[live], good.sum(1))
            all_s = np.concatenate([sims[live], score], 1)
            best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(good, near, -1)], 1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~good], 1), best, 1)
            sims[live] = np.take_along_axis(all_s, best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def similar(self, nodes: np.ndarray, q: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Products of ``nodes`` with their queries; the first ``count[0]`` nodes are the first query's, and so on."""
        of, out = np.repeat(np.arange(len(q)), count), np.empty(len(nodes), np.float32)
        step = max(1, PAIR_BYTES // (4 * self.x.shape[1]))
        for at in range(0, len(nodes), step):
            out[at : at + step] = np.einsum("kd,kd->k", self.x[nodes[at : at + step]], q[of[at : at + step]])
        return out

    def pieces(self, q: np.ndarray, limit: float, width: int, wide: int | None = None):
        """:meth:`within` in pieces of bounded size. Where a query would need a beam over ``wide`` nodes, it meets all products."""
        todo, n, first = np.arange(len(q)), len(self.x), True
        while len(todo):
            width, again = min(width, n), []
            if wide is not None and width > wide and not first:
                for r, c in product_pieces(self.x, q[todo], limit):
                    yield todo[r], c
                return
            fit = self.fits(width)
            for at in range(0, len(todo), fit):
                rows = todo[at : at + fit]
                ids, sims = self.beam(q[rows], self.layers[-1][1], self.entries(q[rows], self.layers[-1][0]), width)
                full = (sims[:, -1] >= limit) & (width < n)
                r, c = np.nonzero((sims >= limit) & ~full[:, None])
                yield rows[r], ids[r, c].astype(np.int64)
                again.append(rows[full])
            todo, width, first = np.concatenate(again), 4 * width, False

    def within(self, q: np.ndarray, limit: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of similarity ``limit`` or more that a beam of ``width``, or wider where it is full of links, finds."""
        out = list(self.pieces(q, limit, width))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 2

    def unreached(self) -> np.ndarray:
        """Nodes to which no path of the lowest layer leads from the first entry point."""
        table = self.layers[-1][1]
        seen = np.zeros(len(self.x), bool)
        front = self.layers[0][0][:1]
        while len(front):
            seen[front] = True
            near = np.unique(table[front])
            near = near[near >= 0]
            front = near[~seen[near]]
        return np.flatnonzero(~seen)


def product_pieces(x: np.ndarray, q: np.ndarray, limit: float, among: np.ndarray | None = None):
    """:func:`products` in pieces of bounded size."""
    size = len(x) if among is None else len(among)
    for first in range(0, len(q), 128):
        for at in range(0, size, 4096):
            rows = slice(at, at + 4096) if among is None else among[at : at + 4096]
            r, c = np.nonzero(q[first : first + 128] @ x[rows].T >= limit)
            yield first + r, c + at if among is None else rows[c]


def products(x: np.ndarray, q: np.ndarray, limit: float, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of similarity ``limit`` or more by all products with ``x`` (or its rows ``among``)."""
    out = [(np.zeros(0, int), np.zeros(0, int)), *product_pieces(x, q, limit, among)]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _packed(batch: pa.RecordBatch) -> bytes:
    ids, weight = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    kind = np.float32 if pa.types.is_float32(batch.column(2).type.value_type) else np.float64
    return pickle.dumps((ids, weight, _matrix(batch.column(2)).astype(kind)))


def planted(unit: np.ndarray, cosine: float) -> np.ndarray:
    """Unit vectors at ``cosine`` to those given, in a direction drawn at random."""
    away = np.random.default_rng(7).standard_normal(unit.shape)
    away -= (away * unit).sum(1, keepdims=True) * unit
    size = np.sqrt((away * away).sum(1, keepdims=True))
    away = np.divide(away, size, out=np.zeros_like(away), where=size > 0)  # in one dimension there is no other direction
    return _unit(unit * cosine + away * (1 - cosine**2) ** 0.5)


def audited(graph: Graph, q: np.ndarray, threshold: float, beam: int, recall: float, ids: np.ndarray | None = None, q_ids: np.ndarray | None = None, loose: np.ndarray | None = None) -> int:
    """The beam with which ``recall`` of the links of ``q`` are found; 0 where none does. With ids, a node's hit on itself is no link.

    Nodes that are ``loose`` count as found: a search compares them with every query, and no beam, however wide, reaches them.
    """

    width, n = beam, len(graph.x)
    while True:
        have = links = 0
        fit = graph.fits(width)
        for at in range(0, len(q), fit):
            some, truth, found = q[at : at + fit], np.zeros((len(q[at : at + fit]), n), bool), np.zeros((len(q[at : at + fit]), n), bool)
            for r, c in product_pieces(graph.x, some, threshold):
                truth[r, c] = True
            for r, c in graph.pieces(some, threshold - 1e-4, width):
                found[r, c] = True
            if loose is not None:
                found[:, loose] = True
            if ids is not None:
                truth &= q_ids[at : at + fit, None] != ids
            links += int(truth.sum())
            have += int((truth & found).sum())
        if have >= recall * links:
            return width
        if width >= n:
            return 0
        width = min(4 * width, n)


def _graph_rows(graph: Graph, ids, weight, x, width: int, loose):
    """The graph's rows (shard is added by the caller): nodes with their vectors and lowest neighbours, a range at a time.

    The first has the layers above, by their own nodes, the beam and the nodes beside the graph.
    """
    head = ([(nodes, table[nodes]) for nodes, table in graph.layers[:-1]], width, loose)
    base = graph.layers[-1][1]
    size = max(1, PIECE_BYTES // (16 + x.itemsize * x.shape[1] + 4 * base.shape[1]))
    for at in range(0, len(x), size):
        part = slice(at, at + size)
        yield pickle.dumps((ids[part], weight[part], x[part], base[part], None if at else head))


def _graph_of(parts: list):
    """(graph, ids, weight, x, beam, nodes beside the graph) of the rows of :func:`_graph_rows`; empties ``parts``."""
    above, width, loose = parts[0][4]
    ids, weight, x, base = (np.concatenate([p[k] for p in parts]) for k in range(4))
    parts.clear()
    graph = Graph.__new__(Graph)
    graph.x, graph.layers = np.empty(x.shape, np.float32), []
    for at in range(0, len(x), 8192):
        graph.x[at : at + 8192] = _unit(x[at : at + 8192].astype(np.float64))
    for nodes, near in above:
        table = np.full((len(x), near.shape[1]), -1, np.int32)
        table[nodes] = near
        graph.layers.append((nodes, table))
    graph.layers.append((np.arange(len(x)), base))
    return graph, ids, weight, x, width, loose


def _build(links: int, beam: int, threshold: float, audit: int, recall: float, tried):
    """Rows (id, weight, v, shard) sorted by shard: one graph a shard, with its beam and the nodes beside it, in pieces."""

    def graph(shard, parts):
        ids, weight, x = (np.concatenate(c) for c in zip(*(pickle.loads(_packed(p)) for p in parts), strict=True))
        parts.clear()
        unit = _unit(x.astype(np.float64))
        own = np.argsort(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")[:audit]
        some_ids, some = tried.value.get(x.shape[1], (ids[:0], unit[:0]))
        copies = planted(unit[own], (1 + threshold) / 2)
        q = np.concatenate([some, unit[own], copies]).astype(np.float32)
        q_ids = np.concatenate([some_ids, ids[own], np.full(len(own), -1)])  # the copies link with their originals
        unit = unit.astype(np.float32)
        g = Graph(unit, links, beam)
        loose = g.unreached()
        width = audited(g, q, threshold, beam, recall, ids, q_ids, loose)
        for k, data in enumerate(_graph_rows(g, ids, weight, x, width, loose)):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["shard", "piece", "data"])

    def run(batches):
        now, parts = None, []
        for b in batches:
            shards = b.column(3).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e == s:
                    continue
                if now is not None and shards[s] != now:
                    yield from graph(now, parts)
                now = int(shards[s])
                parts.append(b.slice(s, e - s))
        if parts:
            yield from graph(now, parts)

    return run


def _query_blocks(size: int):
    def run(batches):
        for b in batches:
            width = pa.compute.list_value_length(b.column(2)).to_numpy()
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                for at in range(0, len(rows), size):
                    yield pa.RecordBatch.from_arrays([pa.array([int(w)], pa.int32()), pa.array([pickle.dumps(pickle.loads(_packed(b.take(pa.array(rows[at : at + size]))))[::2])], pa.binary())], names=["width", "data"])

    return run


def _search(threshold: float):
    """Rows (slot, shard, kind, piece, data) sorted so that a graph comes before its blocks. Out: (0, id, links) and (1, id, id)."""

    def size(x):
        """Lengths of the rows; the rows as doubles are made in steps."""
        step = max(1, PAIR_BYTES // (8 * x.shape[1]))
        return np.concatenate([np.sqrt((x[at : at + step].astype(np.float64) ** 2).sum(1)) for at in range(0, len(x), step)])

    def near(graph, width, loose, unit):
        """Pieces of pairs, each pair once."""
        limit = threshold - 1e-4
        if not width:
            yield from product_pieces(graph.x, unit, limit)
            return
        beside = np.zeros(len(graph.x), bool)
        beside[loose] = True
        for r, c in graph.pieces(unit, limit, width, len(graph.x) // 8):
            yield r[~beside[c]], c[~beside[c]]
        if len(loose):
            yield from product_pieces(graph.x, unit, limit, loose)

    def verified(pairs, x, lengths, q, q_lengths):
        step = max(1, PAIR_BYTES // (8 * x.shape[1]))
        for all_r, all_c in pairs:
            for at in range(0, len(all_r), step):
                r, c = all_r[at : at + step], all_c[at : at + step]
                ok = np.einsum("kd,kd->k", q[r], x[c].astype(np.float64)) / (q_lengths[r] * lengths[c]) >= threshold
                yield r[ok], c[ok]

    none = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forest(ties):
        """Ids that are tied, each but the smallest with the smallest."""
        a, b = (np.concatenate(c) for c in zip(*ties, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_components(at[: len(a)], at[len(a) :], len(ids))
        more = np.flatnonzero(root != np.arange(len(ids)))
        return ids[more], ids[root[more]]

    def run(batches):
        parts, at, graph = [], None, None
        for b in batches:
            for k in range(b.num_rows):
                shard, kind, data = b.column(1)[k].as_py(), b.column(2)[k].as_py(), pickle.loads(b.column(4)[k].as_buffer())
                if kind == 0:
                    if at != shard:
                        parts, at, graph = [], shard, None
                    parts.append(data)
                    continue
                if at != shard:  # no vector of this length is in the shard
                    continue
                if graph is None:
                    graph, ids, weight, x, width, loose = _graph_of(parts)
                    lengths = size(x)
                q_ids, q = data[0], data[1].astype(np.float64)
                n, ties, held, most = np.zeros(len(q), np.int64), [none], 0, MOST_TIES
                for r, c in verified(near(graph, width, loose, _unit(q).astype(np.float32)), x, lengths, q, size(q)):
                    other = q_ids[r] != ids[c]
                    r, c = r[other], c[other]
                    if len(r):
                        n += np.bincount(r, weights=weight[c], minlength=len(q)).astype(np.int64)
                        ties.append(forest([(q_ids[r], ids[c])]))
                        held += len(ties[-1][0])
                        if held > most:
                            ties = [forest(ties)]
                            held = len(ties[0][0])
                            most = MOST_TIES + 2 * held
                ends = forest(ties)
                some = n > 0
                kinds = np.r_[np.zeros(some.sum(), np.int32), np.ones(len(ends[0]), np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.r_[q_ids[some], ends[0]]), pa.array(np.r_[n[some], ends[1]])], names=["kind", "a", "b"])

    return run


def embedding_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, shard_rows: int = 65_536, least_shards: int = 8, links: int = 12, beam: int = 48, block: int = 512, audit: int = 512, recall: float = 1.0, streamed: int = 262_144) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null id, link with nothing;
    vectors link only with vectors of their own length. Equal vectors (a repeated row too) are linked with each
    other. At most ``streamed`` vectors pass one copy of a graph in a task. An empty table gives no rows; other columns
    are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    fine = F.col("vec_id").isNotNull() & valid("v")
    nodes = stored(rows.filter(fine).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).select("id", "weight", "v"), "nodes")
    total = nodes.count()
    shards = max(least_shards, -(-total // shard_rows))
    tried: dict[int, list] = {}
    for r in nodes.orderBy(F.xxhash64("id"), "id").limit(audit).select("id", "v").collect():
        tried.setdefault(len(r.v), []).append(r)
    tried = spark.sparkContext.broadcast({w: (np.array([r.id for r in of], np.int64), _unit(np.array([r.v for r in of], np.float64))) for w, of in tried.items()})
    width = F.size("v").cast("long")
    place = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    dealt = nodes.withColumn("shard", width * 1_000_000 + place).repartitionById(shards, place).sortWithinPartitions("shard", "id")  # a task a shard, in an order that no shuffle changes
    graphs = stored(dealt.mapInArrow(released(_build(links, beam, threshold, audit, recall, tried)), "shard long, piece int, data binary"), "graphs")
    # A graph has some two times its vectors' bytes: with no more copies of it than shards, copies are not much more than blocks.
    chunks = max(2, min(2 * parallelism(spark) // shards, shards), -(-total // streamed))
    blocks = nodes.mapInArrow(_query_blocks(block), "width int, data binary")
    blocks = blocks.withColumn("chunk", F.pmod(F.xxhash64("data"), F.lit(chunks))).withColumn("one", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    blocks = blocks.select((F.col("one") * chunks + F.col("chunk")).cast("int").alias("slot"), (F.col("width").cast("long") * 1_000_000 + F.col("one")).alias("shard"), F.lit(1).alias("kind"), F.lit(0).alias("piece"), "data")
    copies = graphs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    copies = copies.select((F.col("shard") % 1_000_000 * chunks + F.col("chunk")).cast("int").alias("slot"), "shard", F.lit(0).alias("kind"), "piece", "data")
    ready = copies.union(blocks).repartitionById(shards * chunks, F.col("slot")).sortWithinPartitions("slot", "shard", "kind", "piece")
    hits = stored(ready.mapInArrow(released(_search(threshold)), "kind int, a long, b long"), "hits")
    counts = hits.filter("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    members = connected_components(hits.filter("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = nodes.join(counts, "id", "left").join(members, members.node == nodes.id, "left")
    placed = placed.select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.filter(fine).join(placed, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
