"""Operators over embeddings against brute force."""

import pickle
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from weftwork.llm import ann, hnsw_dedup
from weftwork.llm.common import table
from weftwork.llm.components import local_components

ODD = [(900001, None), (900002, [0.0] * 64), (900003, [float("nan")] + [1.0] * 63), (900004, [1.0, 2.0]), (900005, [2.0, 4.0]), (None, [1.0] * 64), (900006, [1.0] * 63 + [None])]


@pytest.fixture(scope="module")
def vectors(spark, sf):
    d = sf.replace("sf0.001", "sf0.1")
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    odd = spark.createDataFrame(ODD, "vec_id long, embedding array<float>")
    copies = e.filter("vec_id < 3").selectExpr("vec_id + 800000 as vec_id", "embedding")
    return e.union(odd).union(copies)


@pytest.fixture(scope="module")
def plain(vectors):
    p = vectors.toPandas()
    p = p[[i == i and x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x) and any(x) for i, x in zip(p.vec_id, p.embedding, strict=True)]].sort_values("vec_id")
    return p.vec_id.to_numpy().astype(int), np.array(p.embedding.tolist(), float)


def recall_of(got, ids, x, k=10):
    hits = asked = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, k + 1)) and q not in set(g.vec_id)
        assert np.allclose(g.score, [d[ids == v][0] for v in g.vec_id], atol=1e-12) and (np.diff(g.score) >= 0).all()
        d[ids == q] = np.inf
        hits, asked = hits + len(set(ids[np.lexsort((ids, d))[:k]]) & set(g.vec_id)), asked + k
    return hits / asked


@pytest.mark.parametrize("how", [{}, {"block": 37, "part": 5, "sample": 500}])
def test_nearest(vectors, plain, how):
    ids, x = plain
    got = ann.nearest(vectors, "id % 100 = 0", **how).toPandas()
    assert sorted(set(got.query_id)) == [i for i in ids if i % 100 == 0]
    assert recall_of(got, ids, x) >= 0.9


def share(df, queries, rows):
    _, asked, asks, _ = ann.candidates(df, queries)
    seen = sum(len(np.unique(np.frombuffer(b"".join(r["places"]), np.uint16))) for r in asks.collect())
    return seen / asked.count() / rows


def test_candidates_become_a_smaller_share(spark):
    rng = np.random.default_rng(0)
    shares = []
    for n in (2000, 8000):
        x = np.repeat(rng.standard_normal((n // 50, 24)), 50, 0) + 0.25 * rng.standard_normal((n, 24))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        assert recall_of(ann.nearest(df, "id % 100 = 0").toPandas(), np.arange(n), x) >= 0.9
        shares.append(share(df, "id % 100 = 0", n))
    assert shares[1] < 0.5 * shares[0] and shares[1] < 0.2


def test_queue_follows_margins():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 8))
    forest = ann.Forest(x, 5, 4)
    for q in x[:20]:
        cost = forest.margins(q)
        taken = forest.opened(q, 30)
        assert [cost[t, leaf] for t, leaf in taken] == sorted(cost.ravel())[:30]
        assert all((t, leaf) in taken for t, leaf in enumerate(forest.leaves(q[None])[0]))


def test_nearest_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (2, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in ann.nearest(few, "id % 100 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.nearest(few.limit(0), "id % 100 = 0").count() == 0
    one = ann.nearest(few.limit(1), "id % 100 = 0")
    assert one.count() == 0 and one.columns == ["query_id", "rank", "vec_id", "score"]


def test_repeated_query_rows_are_one_query(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 6)))]
    once = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 100 = 0").collect()
    twice = ann.nearest(spark.createDataFrame([*rows, rows[0], rows[100], rows[0]], "vec_id long, embedding array<double>"), "id % 100 = 0").collect()
    assert sorted(r for r in once if r["query_id"] == 200)[:1] == sorted(r for r in twice if r["query_id"] == 200)[:1]
    assert len(twice) == len(once) == 30 and len({(r["query_id"], r["rank"]) for r in twice}) == 30
    assert len({r["vec_id"] for r in twice if r["query_id"] == 0}) == 10


def test_embedding_duplicates(vectors, plain):
    ids, x = plain
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    top = ids[local_components(*np.nonzero(links), len(ids))]
    got = hnsw_dedup.embedding_near_duplicates(vectors, least_shards=3, block=64).toPandas()
    assert len(got) == vectors.count()
    g = got[got.vec_id.notna()].set_index("vec_id")
    assert g.loc[ids, "n_links"].tolist() == links.sum(1).tolist() and g.loc[ids, "component_id"].tolist() == top.tolist()
    assert g.loc[[900001, 900002, 900003, 900006], "n_links"].tolist() == [0] * 4
    assert g.loc[[900004, 900005], "component_id"].tolist() == [900004, 900004] and g.loc[900005, "kept"] == False  # noqa: E712


def test_dense_group_and_empty(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal(16)
    near = [(i, (base + 0.03 * rng.standard_normal(16)).tolist()) for i in range(300)]
    far = [(1000 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    df = spark.createDataFrame(near + far, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in near + far])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = hnsw_dedup.embedding_near_duplicates(df, least_shards=2, block=100).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == want.tolist() and (got.component_id[:300] == 0).all()
    assert hnsw_dedup.embedding_near_duplicates(df.limit(0)).count() == 0


def test_links_of_odd_ids_are_audited_too(spark):
    rng = np.random.default_rng(5)
    base = np.repeat(rng.standard_normal((150, 12)), 4, 0)
    x = base + 0.12 * rng.standard_normal(base.shape)
    ids = 2 * np.arange(len(x)) + 1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = hnsw_dedup.embedding_near_duplicates(df, least_shards=2, beam=2, links=2, audit=60, block=50).toPandas().set_index("vec_id")
    want, have = links.sum(), got.loc[ids, "n_links"].sum()
    assert 0.9 * want <= have <= want


def test_nodes_without_a_path_are_kept_beside_the_graph():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw_dedup.Graph(x, 4, 16)
    table = graph.layers[-1][1]
    table[table == 150] = -1
    if graph.layers[0][0][0] != 150:
        assert 150 in graph.unreached()
    table[:] = -1
    assert len(graph.unreached()) == 199 and hnsw_dedup.audited(graph, x[:50].astype(np.float32), 0.5, 4, 1.0) == 0
    r, c = hnsw_dedup.products(graph.x, x[:50].astype(np.float32), 0.5)
    assert set(zip(r, c, strict=True)) == set(zip(*np.nonzero(x[:50] @ x.T >= 0.5), strict=True))


def test_audit_by_planted_copies():
    """Without duplicates a node's hit on itself says nothing; a planted copy asks for its original."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(400) + 1000
    graph = hnsw_dedup.Graph(x, 4, 16)
    q, own = x[:60].astype(np.float32), ids[:60]
    assert hnsw_dedup.audited(graph, q, 0.95, 2, 1.0, ids, own) == 2  # nothing to find
    copies = hnsw_dedup.planted(x[:60], 0.975)
    assert np.abs((copies * x[:60]).sum(1) - 0.975).max() < 1e-12
    both, both_ids = np.concatenate([q, copies.astype(np.float32)]), np.r_[own, np.full(60, -1)]
    width = hnsw_dedup.audited(graph, both, 0.95, 2, 1.0, ids, both_ids)
    assert width > 2
    found = graph.within(copies.astype(np.float32), 0.95 - 1e-4, width)
    assert set(range(60)) <= {r for r, c in zip(*found, strict=True) if r == c}
    graph.layers[-1][1][:] = -1
    assert hnsw_dedup.audited(graph, both, 0.95, 2, 1.0, ids, both_ids) == 0


def traced(run):
    """(result, most MB held meanwhile)."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def near_copies(n, width=16):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(width) + 0.03 * rng.standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_audit_of_wide_beams_is_bounded():
    """Beams that widen to all nodes of a shard are searched for few queries at a time."""
    x = near_copies(4000)
    graph = hnsw_dedup.Graph(x)
    width, most = traced(lambda: hnsw_dedup.audited(graph, x[:1536].astype(np.float32), 0.95, 48, 1.0))
    assert width == 48 and most < 80, most


def test_nodes_beside_the_graph_need_no_wider_beam(monkeypatch):
    """A link to a node without a path is found beside the graph; it does not send the audit through all beams, nor the shard to products."""

    class Cut(hnsw_dedup.Graph):
        def __init__(self, *how):
            super().__init__(*how)
            for _, table in self.layers:
                table[table == 150] = -1

    rng = np.random.default_rng(12)
    x = rng.standard_normal((400, 16))
    monkeypatch.setattr(hnsw_dedup, "Graph", Cut)
    tried = []
    monkeypatch.setattr(Cut, "beam", lambda self, q, table, start, width, *step: (tried.append(width), hnsw_dedup.Graph.__base__.beam(self, q, table, start, width, *step))[1])
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(400)), pa.array(np.ones(400, int)), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(np.full(400, 16_000_000))], names=["id", "weight", "v", "shard"])
    out = list(hnsw_dedup._build(12, 48, 0.95, 400, 1.0, SimpleNamespace(value={}))(iter([rows])))
    assert max(tried) < 400
    _, width, loose = pickle.loads(out[0].column(2)[0].as_py())[4]
    assert width >= 48 and 150 in loose


def test_search_of_one_large_group_is_bounded(monkeypatch):
    """A graph travels in rows of bounded size; a block that links with all of it is verified and counted in pieces."""
    monkeypatch.setattr(hnsw_dedup, "PIECE_BYTES", 100_000)
    x, ids = near_copies(4000), np.arange(4000) + 50
    x[:10] = np.random.default_rng(5).standard_normal((10, 16))
    vectors = pa.array(x.tolist(), pa.list_(pa.float64()))
    rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.ones(4000, int)), vectors, pa.array(np.full(4000, 16_000_000))], names=["id", "weight", "v", "shard"])
    graph = list(hnsw_dedup._build(12, 48, 0.95, 20, 1.0, SimpleNamespace(value={}))(iter([rows])))
    assert len(graph) > 5 and max(b.nbytes for b in graph) < 130_000
    (block,) = hnsw_dedup._query_blocks(512)(iter([rows.slice(0, 512)]))
    feed = [(0, k, b.column(2)[0].as_py()) for k, b in enumerate(graph)] + [(1, 0, block.column(1)[0].as_py())]
    feed = [pa.RecordBatch.from_arrays([pa.array([0]), pa.array([16_000_000]), pa.array([kind]), pa.array([piece]), pa.array([data])], names=["slot", "shard", "kind", "piece", "data"]) for kind, piece, data in feed]
    (out,), most = traced(lambda: list(hnsw_dedup._search(0.95)(iter(feed))))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u[:512] @ u.T >= 0.95).sum(1) - 1
    kind, a, b = (c.to_numpy() for c in out.columns)
    assert dict(zip(a[kind == 0], b[kind == 0], strict=True)) == {i: n for i, n in zip(ids, links, strict=False) if n}
    assert (kind == 1).sum() < 4000 and set(b[kind == 1]) == {60} and set(a[kind == 1]) == set(range(61, 4050))
    assert most < 80, most
