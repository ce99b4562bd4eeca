"""Connected components of an edge table by alternating large-star and small-star steps.

Every task first shrinks its own edges to a spanning forest (union-find over the edges of one partition), so a
clique of n nodes costs at most n - 1 edges a task from then on; what is left is shrunk again in tasks of about ``CHUNK``
edges, which is all for a small table. The rounds end when only stars are left. The star steps are two partial minimum aggregations
and joins a round. A hub, a node with many edges, is not joined by its key: the edges have at most twice as many ends as
``1 / SHARE`` hubs with a share of ``SHARE`` of them, so the hubs' minima are broadcast. Each round is written to the
shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

EDGE = "src long, dst long"
#: A node with more than this share of the edges (and more than FEW) is a hub; there are at most 2 / SHARE of them.
SHARE, FEW = 1e-5, 500
#: Edges that a task shrinks together before the first round; what fits one such chunk needs no round.
CHUNK = 50_000


class Forest:
    """Union-find over long ids, smallest id as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while (nxt := up.get(x, x)) != top and nxt != x:
            up[x] = top
            x = nxt
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up.setdefault(a, a)
        self.up[b] = a
        return True


def _shrink(batches):
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a is not None and b is not None:
                forest.join(a, b)
    nodes = [n for n in forest.up if forest.root(n) != n]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.root(n) for n in part], pa.int64())], names=["src", "dst"])


def _with_least(edges: DataFrame, least: DataFrame, many: float) -> DataFrame:
    """``edges`` joined with ``least(src, m, n)`` on src; edges of nodes with n above ``many`` are not shuffled."""
    hubs = F.broadcast(least.filter(F.col("n") > many).select("src", "m"))  # at most 2 / SHARE rows
    usual = edges.join(hubs, "src", "left_anti").join(least.filter(F.col("n") <= many).select("src", "m"), "src")
    return usual.select("src", "dst", "m").union(edges.join(hubs, "src").select("src", "dst", "m"))


def _stars(edges: DataFrame, count: int) -> DataFrame:
    """One large-star and one small-star step; edges point from the larger to the smaller id."""
    many = max(FEW, SHARE * count)
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"), F.count("*").alias("n"))
    large = _with_least(both.filter("dst > src"), least, many).filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
    small = large.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n"))
    out = _with_least(large, small, many).filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return out.union(small.select("src", F.col("m").alias("dst"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """(nodes that are not yet in place, edges). In place: stars only, each node pointing to one that points nowhere."""
    ends = edges.select("src", F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("dst", F.lit(0), F.lit(1)))
    each = ends.groupBy("src").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    row = each.agg(F.count_if(F.expr("out > 1 or out = 1 and into = 1")), F.coalesce(F.sum("out"), F.lit(0))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(src long, dst long)``; component is the smallest reachable node.

    Null ends and self-loops carry no link; repeated and two-way edges count once; no edges give an empty table.
    """
    now = stored(edges.select("src", "dst").filter("src <> dst").mapInArrow(_shrink, EDGE).distinct(), "edges")
    tasks = max(1, -(-now.count() // CHUNK))
    full = now.coalesce(tasks).mapInArrow(_shrink, EDGE)
    now = stored(full if tasks == 1 else full.distinct(), "edges")
    for _ in range(max_rounds):
        unsettled, count = _state(now) if tasks > 1 else (0, 0)
        if not unsettled:
            break
        new = stored(_stars(now, count), "stars")
        dropped(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Component label (smallest index) of each of n local nodes under links a-b; vectorised min-propagation with jumps."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == label).all():
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    while (label != (up := label[label])).any():
        label = up
    return label
