"""Mixing, collocations and whitening against direct versions, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests import oracle
from weftwork.llm import collocations, mixing, whitening
from weftwork.llm.common import table
from weftwork.llm.queries import CURRICULUM

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.mark.parametrize("name", ["op11_mixing", "op12_collocations"])
def test_equals_sql(spark, sf, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), oracle.connect(sf).sql(entry.oracle_sql()[name]).df()
    assert oracle.rows(got) == oracle.rows(want) and len(got)


def direct_targets(sizes, weights, share=1.5, most=2):
    """By rounds: what is above a cap is shared again by weight among the others."""
    target, free, left = {}, set(sizes), share * sum(sizes.values())
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if most * sizes[s] < weights[s] * level}
        if not full:
            return target | {s: weights[s] * level for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mixing_targets_and_order(spark):
    rnd = random.Random(4)
    names = [None, *(f"s{k}" for k in range(40)), "Z", "é", "\U0001f600"]
    docs = [(i, " ".join("w" for _ in range(rnd.choice([0, 1, 5, 60, 900]))), rnd.choice([names[3], *names])) for i in range(3000)]
    got = mixing.curriculum(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(9), CURRICULUM).collect()
    assert len(got) == 3000
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = direct_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = Counter()
    for r in got:
        assert r.size == len(docs[r.doc_id][1].split()) and 0 <= r.taken <= 2 * r.size and r.source == docs[r.doc_id][2]
        assert r.target == pytest.approx(want[r.source], abs=1e-6) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    first = [r.positions[0] for r in got if r.positions]
    assert first == sorted(first) and 0 <= first[0] and max(p for r in got for p in r.positions) <= 1
    assert all(len(r.positions) == -(-r.taken // r.size) for r in got if r.taken and r.size)

    # the first third of the training takes from a fading source what its schedule has there
    fading = [s for k, s in enumerate(order) if k % 3 == 0 and want[s] > 20000]
    for s in fading:
        early = sum(min(r.size, r.taken - i * r.size) for r in got if r.source == s for i, p in enumerate(r.positions) if p < 1 / 3)
        assert early / taken[s] == pytest.approx((7.5 / 3 - 2.5 / 9) / 5, abs=0.05)
    again = mixing.curriculum(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(2), CURRICULUM).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedules(spark):
    for schedule in [*CURRICULUM, ((0, 0), (0.5, 0), (1, 3)), ((0, 4), (0.25, 0), (1, 0))]:
        area = mixing.areas(schedule)[-1]
        fine = np.linspace(0, 1, 200001)
        passed = np.interp(fine, *zip(*schedule))
        passed = np.concatenate([[0], np.cumsum((passed[1:] + passed[:-1]) / 2 * np.diff(fine))])
        shares = [k / 16 for k in range(1, 16)]
        got = spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.time_of(F.col("s"), schedule).alias("t")).collect()
        assert [r.t for r in got] == pytest.approx([float(np.interp(s * area, passed, fine)) for s in shares], abs=1e-4)
    for bad in (((0, 1),), ((0, 1), (0.5, 1)), ((0, 0), (1, 0)), ((0, -1), (1, 5))):
        with pytest.raises(ValueError):
            mixing.checked(bad)


def test_mixing_edges(spark, edge_docs, no_docs):
    got = mixing.curriculum(edge_docs, CURRICULUM).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted([(1, 3), (1, 3), (2, 0), (3, 0), (4, 0), (0, 3), (0, 0), (5, 400), (6, 400), (7, 3), (8, 3)])
    assert all(r.source is None and r.source_size == 815 and r.target == 1222.5 for r in got) and sum(r.taken for r in got) == 1222
    assert mixing.curriculum(no_docs, CURRICULUM).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r.taken, r.target, list(r.positions)) for r in mixing.curriculum(empty, CURRICULUM).collect()] == [(0, 0.0, [])] * 2


def direct_phrases(rows, longest=3, least=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, count in f.items():
        cands = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (q := p[i:j]) != p and 100 * a >= inside * cands[q]}
        found = []
        for p, a in cands.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("longest,top,small", [(3, 2000, False), (3, 7, True), (4, 2000, True)])
def test_collocations(spark, monkeypatch, longest, top, small):
    if small:  # several blocks and slices a task
        monkeypatch.setattr(collocations, "SLICE", 50)
    rnd = random.Random(longest)
    words = ["a", "The", "of", "x-y", "été", "\x00", "\xa0", "né\x1d", "日本", "w ", *(f"v{k}" for k in range(30))]
    text = lambda: "".join(rnd.choice(words[: rnd.choice([4, 12, 40])]) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!?"]) for _ in range(rnd.randrange(400)))
    rows = [(rnd.choice(["en", "en", "fr", None, "und"]), text()) for _ in range(120)] + [("de", None), ("de", ""), ("de", " . "), ("en", "over and over " * 3000)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(5), longest=longest, top=top)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == direct_phrases(rows, longest, top=top)


def test_tiled_counts():
    rnd = np.random.default_rng(1)
    for n, size, width in ((1, 50, 256), (40, 5000, 8), (3000, 40000, 16), (70000, 3000, 256), (5, 0, 256)):
        x, y = (rnd.integers(0, n, size) ** 2 // max(1, n) for _ in range(2))  # low codes are frequent
        a, b, count, place = collocations.tiled(x, y, n, width)
        assert dict(zip(zip(a.tolist(), b.tolist()), count.tolist())) == Counter(zip(x.tolist(), y.tolist()))
        assert (a[place] == x).all() and (b[place] == y).all()


def test_collocations_exact_arithmetic(spark):
    frame = spark.createDataFrame([(3_000_000_000, [3_000_000_001, 3_000_000_000], [3_000_000_007, 3_000_000_000])], "a long, heads array<long>, tails array<long>")
    r = frame.select(collocations._scored(2).alias("c")).first().c
    assert r.score == 1_000_000 * 3_000_000_000**2 // (3_000_000_001 * 3_000_000_007) and (r.k, r.l, r.r) == (1, 3_000_000_001, 3_000_000_007)


def test_collocations_edges(spark, edge_docs, no_docs):
    assert [(r.lang, r.phrase, r.a, r.l, r.r) for r in collocations.collocations(edge_docs).collect()] == [("und", "wörld wörld wörld", 796, 800, 798)]
    assert collocations.collocations(no_docs).count() == 0


def check_spectrum(a, most=16):
    values, vectors = whitening.leading(a, most)
    want = np.linalg.eigvalsh(a)[::-1][: len(values)]
    scale = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-12 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-10
    assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-11 * scale
    return values


def test_spectrum_slicing():
    rnd = np.random.default_rng(5)
    for size in (1, 2, 5, 30, 64):
        x = rnd.standard_normal((3 * size, size)) * np.geomspace(1, 50, size)
        a = x.T @ x
        assert len(check_spectrum(a)) == min(16, size)
        for shift in rnd.uniform(0, np.trace(a), 20):
            assert whitening.positives(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
        b = rnd.standard_normal((size, size))
        assert whitening.positives(b + b.T, 0.0) == (np.linalg.eigvalsh(b + b.T) > 0).sum()
    q, _ = np.linalg.qr(rnd.standard_normal((20, 20)))
    for values in ([5] * 20, [9, 9, 9, 4, 4, *[1] * 15], [1, 1 - 1e-9, 1 - 2e-9, *[0.5] * 17], [3, 2, 1, *[0] * 17], [1e9, 1, *[1e-2] * 18]):
        a = (q * np.array(values, float)) @ q.T
        assert len(check_spectrum((a + a.T) / 2)) >= min(16, sum(v > 1e-11 * sum(values) for v in values))
    assert not len(whitening.leading(np.zeros((4, 4)), 16)[0])


def test_whitening(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    odd = [(-1, None), (-2, []), (-3, [1.0] * 63 + [None]), (-4, [float("nan")] * 64), (-5, [float("inf")] * 64), (-6, [1.0, 2.0])]
    base = [(r.vec_id, [float(c) for c in r.embedding]) for r in rows if r.embedding is not None] + [(None, [0.0] * 64), (7777, [0.0] * 64)]
    base = [r for r in base if all(np.isfinite(c) for c in r[1])]
    schema = "vec_id long, embedding array<double>, n long, x array<long>, component string"
    got = whitening.whiten(spark.createDataFrame([(*r, 1, [1], "c") for r in base + odd], schema).repartition(5)).toPandas()
    x = np.floor(np.array([v for _, v in base]) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    assert len(got) == 16 * len(base) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    want = {}
    for (i, _), row in zip(base, x):
        want[i] = (int(((n * row.astype(object) - s) ** 2).sum()), ((row - s / n) @ u) / np.sqrt(e))
    signs = {}
    for r in got.itertuples():
        i = None if r.vec_id != r.vec_id else int(r.vec_id)
        deviation, white = want[i]
        assert r.deviation == deviation
        w = white[r.component - 1]
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-9)
        assert abs(abs(r.whitened) - abs(w)) < 1e-8
        if abs(w) > 1e-3:
            assert signs.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)


def test_whitening_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)] * 2, "vec_id long, embedding array<float>")
    got = whitening.whiten(line).collect()
    assert len(got) == 20 and {r.component for r in got} == {1} and {round(r.explained, 9) for r in got} == {1.0}
    huge = spark.createDataFrame([(1, [2.0**45, 0.0]), (2, [-(2.0**45), 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert all(r.deviation is None or r.deviation >= 0 for r in whitening.whiten(huge).collect())


