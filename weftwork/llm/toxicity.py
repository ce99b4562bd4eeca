"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, distance-weighted votes.

Fitting reads a bounded sample of labelled rows (``labelled`` rows outside the held-out fold, those with the smallest
hash of their id; its ids and labels are broadcast). At most ``examples`` of them are indexed with every term that they
hold; at most ``calibration`` other rows calibrate the vote by pooled neighbours (isotonic). Document frequencies count
all documents. A term's TF-IDF weight is multiplied by its relevance (:func:`relevance`), which is zero for words that
the labelled rows hold with either label as often as chance would have it.

A term that no indexed example holds adds to no product and would scale all cosines of a text alike, so it changes
neither order nor votes; norms are those of the vocabulary's terms.

A search sums the block maxima of its terms to an upper bound per block of examples, opens blocks by falling bound,
and stops when the k-th cosine reaches the next bound, so the cosines found are exactly the k largest.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, stored, trimmed

BLOCK = 128
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKS = re.compile(rb"\xe2[\x80\x81].|\xc2[\x80-\xbf]", re.S)
SCORED = "doc_id long, score double, evidence string"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters, A-Z lower-cased; digits, ASCII signs and general punctuation part terms."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if b"\xe2" in data or b"\xc2" in data:
        data = _MARKS.sub(b" ", data)
    return data.translate(_FOLD).split()


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. stop[i] - 1 of all i, in order."""
    size = stop - start
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _foremost(score: np.ndarray, example: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores with their examples, largest first; of equal ones the smaller example number."""
    if len(score) > k:
        some = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, example = score[some], example[some]
    best = np.lexsort((example, -score))[:k]
    return score[best], example[best]


class Index:
    """Inverted lists of unit example vectors (terms, weights), cut into blocks with their largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], width: int) -> None:
        # Examples with the same strongest term stand together, which keeps block maxima tight.
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (vectors[i][0][vectors[i][1].argmax()], i)), int)
        self.blocks = -(-len(vectors) // BLOCK)
        sizes = np.array([len(vectors[i][0]) for i in self.order], int)
        term = np.concatenate([vectors[i][0] for i in self.order]) if len(vectors) else np.zeros(0, int)
        weight = np.concatenate([vectors[i][1] for i in self.order]) if len(vectors) else np.zeros(0)
        place = np.repeat(np.arange(len(vectors)), sizes)
        by_term = np.argsort(term, kind="stable")
        term, self.place, self.weight = term[by_term], place[by_term].astype(np.int32), weight[by_term]
        key = term.astype(np.int64) * max(1, self.blocks) + self.place // BLOCK
        self.cut = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, int)
        first = self.cut[:-1]
        self.part_block = (self.place[first] // BLOCK).astype(np.int32)
        self.part_top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.part_of = np.searchsorted(term[first], np.arange(width + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k largest positive cosines with their examples, largest first; of equal ones the smaller example number."""
        start, stop = self.part_of[terms], self.part_of[terms + 1]
        part, w = _ranges(start, stop), np.repeat(weights, stop - start)
        if not len(part):
            return []
        of = self.part_block[part]
        bound = np.bincount(of, weights=w * self.part_top[part], minlength=self.blocks)
        by_bound = np.argsort(-bound, kind="stable")
        score, example = np.zeros(0), np.zeros(0, int)
        at, step, floor = 0, 8, 0.0
        while at < self.blocks and bound[by_bound[at]] * (1 + 1e-12) >= floor and bound[by_bound[at]] > 0:
            opened = np.zeros(self.blocks, bool)
            opened[by_bound[at : at + step]] = True
            here = opened[of]
            a, z = self.cut[part[here]], self.cut[part[here] + 1]
            rows = _ranges(a, z)
            total = np.bincount(self.place[rows], weights=np.repeat(w[here], z - a) * self.weight[rows])
            hit = np.flatnonzero(total > 0)
            score, example = np.concatenate([score, total[hit]]), np.concatenate([example, self.order[hit]])
            score, example = _foremost(score, example, k)
            floor = score.min() if len(score) == k else 0.0
            at, step = at + step, 2 * step
        return list(zip(score.tolist(), example.tolist(), strict=True))


def pooled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of y on x by pooling neighbours: (upper ends of x, values), each pool eased by one half of either label."""
    pools: list[list[float]] = []
    for v in np.unique(x):
        rows = y[x == v]
        pools.append([float(v), float(rows.sum()), float(len(rows))])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            end, s, n = pools.pop()
            pools[-1] = [end, pools[-1][1] + s, pools[-1][2] + n]
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    worth: np.ndarray  # inverse document frequency times relevance
    index: Index
    ids: list[int]
    labels: list[int]
    k: int
    unknown: float  # score of a text without any known term
    ends: np.ndarray = field(default_factory=lambda: np.array([1.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def near(self, text: str | None) -> list[tuple[float, int]]:
        known = self.vocabulary
        counts = {known[w]: n for w, n in Counter(terms_of(text)).items() if w in known}
        terms = np.fromiter(counts, np.int64, len(counts))
        return self.index.nearest(*weighted(terms, np.fromiter(counts.values(), float, len(counts)), self.worth), self.k)

    def vote(self, near: list[tuple[float, int]]) -> float:
        return sum(c * self.labels[i] for c, i in near) / sum(c for c, _ in near)

    def score(self, text: str | None) -> tuple[float, str]:
        near = self.near(text)
        if not near:
            return self.unknown, ""
        place = min(int(np.searchsorted(self.ends, self.vote(near) - 1e-12)), len(self.ends) - 1)
        return float(self.values[place]), ",".join(f"{self.ids[i]}:{self.labels[i]}:{c:.4f}" for c, i in near[:3])


def weighted(terms: np.ndarray, counts: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order and their weights of length one; terms of no worth are left out."""
    by_term = np.argsort(terms)
    terms = terms[by_term]
    w = (1 + np.log(counts[by_term])) * worth[terms]
    some = w > 0
    return terms[some], w[some] / np.sqrt((w * w).sum()) if some.any() else w[some]


def relevance(n: np.ndarray, n1: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """How far the chi-squared statistic of term and label lies above its mean of 1, as a root; 0 below it.

    ``n`` of ``rows`` labelled rows hold the term, ``n1`` of them toxic.
    """
    share = min(max(toxic / max(rows, 1), 1e-6), 1 - 1e-6)
    chi = (n1 - n * share) ** 2 / (np.maximum(n, 1) * share * (1 - share))
    return np.sqrt(np.maximum(chi - 1, 0))


def fold(id_col) -> F.Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5))


def _terms(batches):
    """(id, y, ts, ns): the distinct terms of a text and how often each occurs."""
    for b in batches:
        counts = [Counter(terms_of(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], names=["id", "y", "ts", "ns"])


def _told(vocabulary):
    """(term, n, n1) per task: rows and toxic rows that hold each term of the vocabulary."""

    def run(batches):
        known = vocabulary.value
        n, n1 = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        for b in batches:
            for y, terms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [known[t] for t in terms if t in known]
                n[found] += 1
                if y:
                    n1[found] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(n1[some])], names=["term", "n", "n1"])

    return run


def _frequencies(vocabulary):
    """(term, n) per task: documents that hold each term; term -1 counts the documents."""

    def run(batches):
        known, docs = vocabulary.value, 0
        n = np.zeros(len(known), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                docs += 1
                n[[known[w] for w in set(terms_of(text)) if w in known]] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[docs, n[some]])], names=["term", "n"])

    return run


class Sample:
    """A collected sample of labelled rows; terms stay in Arrow memory."""

    def __init__(self, table: pa.Table) -> None:
        table = table.combine_chunks()
        self.ids, self.labels = table["id"].to_pylist(), table["y"].to_pylist()
        lists = table["ts"].combine_chunks()
        self.terms, self.cut = lists.flatten(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(int)
        self.counts = table["ns"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)

    def vectors(self, vocabulary: pa.Array, worth: np.ndarray):
        """The weighted vector of each row, in turn."""
        number = pa.compute.index_in(self.terms, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, z in zip(self.cut[:-1], self.cut[1:], strict=True):
            known = number[a:z] >= 0
            yield weighted(number[a:z][known], self.counts[a:z][known], worth)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = 65_536, examples: int = 4096, calibration: int = 4096, k: int = 15) -> Model:
    """A model from the labelled documents outside the held-out fold. A document with several labels has the largest."""
    context = docs.sparkSession.sparkContext
    lab = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id is not null and __y is not null")
    lab = lab.filter(fold(F.col("__id")) != 0).groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(labelled)
    text = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t"))
    known = text.join(F.broadcast(lab), "__id")  # at most ``labelled`` pairs of numbers
    sampled = stored(known.select("__id", "__t", "__y").mapInArrow(released(_terms), "id long, y int, ts array<binary>, ns array<int>"), "labelled")
    total = sampled.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    held = fold(F.col("id")) == 1
    pick = lambda cond, most: Sample(sampled.filter(cond).orderBy(F.xxhash64("id"), "id").limit(most).toArrow())
    shown = pick(~held, examples)
    terms = pa.compute.unique(shown.terms)
    terms = terms.take(pa.compute.sort_indices(terms))
    worth = np.zeros(len(terms))
    if len(terms):
        shared = context.broadcast({t: i for i, t in enumerate(terms.to_pylist())})
        told = sampled.select("y", "ts").mapInArrow(released(_told(shared)), "term int, n long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).toArrow()
        seen = text.select("__t").mapInArrow(released(_frequencies(shared)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        shared.unpersist()
        n, n1, df = (np.zeros(len(terms) + 1) for _ in range(3))  # the last place is that of term -1
        n[told["term"].to_numpy()], n1[told["term"].to_numpy()] = told["n"].to_numpy(), told["n1"].to_numpy()
        df[seen["term"].to_numpy()] = seen["n"].to_numpy()
        worth = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * relevance(n[:-1], n1[:-1], total["n"], total["n1"] or 0)
        telling = np.flatnonzero(worth > 0)
        terms, worth = terms.take(pa.array(telling)), worth[telling]
        del told, seen, shared, n, n1, df
    vectors = list(shown.vectors(terms, worth))
    some = [i for i, v in enumerate(vectors) if len(v[0])]
    index = Index([vectors[i] for i in some], len(terms))
    model = Model({t: i for i, t in enumerate(terms.to_pylist())}, worth, index, [shown.ids[i] for i in some], [shown.labels[i] for i in some], k, 0.5)
    del shown, vectors
    tried = pick(held, calibration)
    near = [index.nearest(*v, k) for v in tried.vectors(terms, worth)]
    votes = [(model.vote(x), y) for x, y in zip(near, tried.labels, strict=True) if x]
    silent = [y for x, y in zip(near, tried.labels, strict=True) if not x]
    del tried, near
    trimmed()
    if total["n"]:  # texts without telling terms: their share of toxic ones, or that of all labelled rows
        model.unknown = (sum(silent) + 0.5) / (len(silent) + 1) if silent else (total["n1"] + 0.5) / (total["n"] + 1)
    if votes:
        model.ends, model.values = pooled(np.array([v for v, _ in votes]), np.array([y for _, y in votes]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) per row; evidence: nearest examples as id:label:cosine.

    A null or empty text, and one without telling terms, has the share of toxic rows among such labelled texts. Repeated
    rows are each scored; a null id is kept (not held out); an empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            found = [m.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.string())], names=["doc_id", "score", "evidence"])

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(released(run), SCORED)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t)[0] < limit for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(released(run), T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
