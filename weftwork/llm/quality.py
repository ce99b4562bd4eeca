"""Quality by a weak-label model: overlapping heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each labeller votes good (1), bad (0) or nothing (-1) on a whole text. All documents' votes are counted by pattern on
Spark (the number of patterns is bounded by three to the power of the labellers); expectation-maximisation over the
counts estimates every labeller's accuracy on good and on bad texts, and each pattern's posterior. A linear scorer
on hashed features learns the posteriors of a bounded sample of documents (``sample`` rows, those with the smallest
hash of their id) and scores every document. Given labels are never read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 10
MEASURES = ("words", "mean_length", "signs", "digits", "capitals", "distinct", "repeated_lines", "sentence_ends", "pipes", "doubled", "function_words", "tail_signs")
#: Frequent short words of the four languages, as fixed values.
FUNCTION_WORDS = frozenset("the of and to in is that for it was on with as be at by this from or an der die das und in von mit zu den ist auf für nicht sich ein le la les de des et en un une du que pour dans qui est el los las y por con una del se".encode().split())
#: Words over which the share of distinct ones is taken, and then averaged: over a whole text it would fall with the length.
WINDOW = 250
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_CAPS = re.compile(rb"[A-Z]")
_DIGITS = re.compile(rb"[0-9]")
_SIGNS = re.compile(rb"[!-/:-@\[-`{-~]")
#: Last bytes of a word that are neither letters, digits, parts of other characters, nor plain punctuation.
_TAILS = frozenset(c for c in range(128) if not (bytes([c]).isalnum() or c in b".,;:"))


def measures(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return np.zeros(len(MEASURES)), words
    distinct = set(words)
    various = sum(len(set(words[k : k + WINDOW])) for k in range(0, n, WINDOW)) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    signs, caps = len(_SIGNS.findall(data)), len(_CAPS.findall(data))
    ends = data.count(b".") + data.count(b"!") + data.count(b"?")
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    tails = sum(w[-1] in _TAILS for w in words)
    common = sum(w.lower() in FUNCTION_WORDS for w in distinct)
    return np.array([n, (size - n) / n, signs / size, len(_DIGITS.findall(data)) / size, caps / size, various, 1 - len(set(lines)) / len(lines), ends / n, data.count(b"|") / n, doubled / n, common / (len(distinct) ** 0.5), tails / n]), words


def votes(m: np.ndarray) -> tuple[int, ...]:
    """One vote a labeller: 1 good, 0 bad, -1 nothing."""
    words, length, signs, digits, caps, distinct, lines, ends, pipes, doubled, common, tails = m
    pick = lambda bad, good: 0 if bad else 1 if good else -1
    return (
        pick(False, words >= 60),
        pick(signs > 0.08 and words >= 8, signs < 0.04),
        pick(caps > 0.2 and words >= 8, caps < 0.06),
        pick(distinct < 0.3, distinct > 0.45),
        pick(pipes > 0.1, False),
        pick(lines > 0.3, lines < 0.05),
        pick(tails > 0.3, tails < 0.05),
        pick((ends > 0.6 and words >= 8) or (words > 40 and ends < 0.01), 0.02 < ends < 0.3),
        pick(common < 0.1 and words > 30, common > 0.5),
        pick((digits > 0.15 or length > 15) and words >= 8, False),
        pick(doubled > 0.2, doubled < 0.05),
    )


LABELLERS = 11


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, belief: float = 20) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each pattern, accuracy of each labeller on bad and good texts, share of good texts).

    The accuracies start where bad texts are bad in few ways each: a labeller is right on most good texts, but on a
    fifth of the bad ones. These values weigh as much as ``belief`` documents, whatever the size of the corpus.
    """
    cast, good = patterns >= 0, patterns == 1
    right = np.repeat([[0.2], [0.99]], patterns.shape[1], axis=1)
    prior, post = 0.8, np.full(len(patterns), 0.5)
    for _ in range(rounds):
        log1 = np.log(prior) + np.where(cast, np.where(good, np.log(right[1]), np.log1p(-right[1])), 0).sum(1)
        log0 = np.log1p(-prior) + np.where(cast, np.where(good, np.log1p(-right[0]), np.log(right[0])), 0).sum(1)
        new = 1 / (1 + np.exp(np.clip(log0 - log1, -500, 500)))
        w1, w0 = new * counts, (1 - new) * counts
        right[1] = ((w1[:, None] * (cast & good)).sum(0) + 0.99 * belief) / ((w1[:, None] * cast).sum(0) + belief)
        right[0] = ((w0[:, None] * (cast & ~good)).sum(0) + 0.2 * belief) / ((w0[:, None] * cast).sum(0) + belief)
        right = np.clip(right, 0.001, 0.999)
        prior = float(np.clip(w1.sum() / counts.sum(), 0.02, 0.98))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, right, prior


def features(m: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Hashed features: shapes of the distinct words as shares, and the measures in steps."""
    x = np.zeros(1 << BITS)
    shapes: dict[int, int] = {}
    for w in set(words):
        shape = zlib.crc32(b"%d%d%d%d%s" % (min(len(w), 12), w[:1].isupper(), w.isupper(), w.isalnum(), w[-1:] if not w[-1:].isalpha() else b"")) % (1 << BITS)
        shapes[shape] = shapes.get(shape, 0) + 1
    total = max(1, sum(shapes.values()))
    for k, c in shapes.items():
        x[k] += c / total
    for name, v in zip(MEASURES, m, strict=True):
        step = int(np.log1p(v) * 2) if name == "words" else int(min(v, 20) * 20)
        x[zlib.crc32(f"{name}:{step}".encode()) % (1 << BITS)] += 1
    return x


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray
    prior: float

    def score(self, m: np.ndarray, words: list[bytes]) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(m, words) @ self.weights + self.bias, -30, 30))))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full gradients with Adam steps; deterministic."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    w, b = np.zeros(x.shape[1]), 0.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-(x @ w.astype(np.float32) + np.float32(b)))) - y
        g = np.r_[x.T @ error / len(y) + decay * w, error.mean()]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = rate * 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _voted(batches):
    for b in batches:
        out = ["".join("x01"[v + 1] for v in votes(measures(t)[0])) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["pattern"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000) -> Scorer:
    """A scorer from the votes on all documents; the linear part learns on the documents of at most ``sample`` ids.

    A null text is an empty one; a repeated row counts each time; rows with a null id vote but train nothing; an empty
    table gives a scorer of 0.5 for every text.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    counted = text.select("t").mapInArrow(_voted, "pattern string").groupBy("pattern").count().collect()
    if not counted:
        return Scorer(np.zeros(1 << BITS), 0.0, np.full((2, LABELLERS), 0.75), 0.5)
    patterns = np.array([["x01".index(c) - 1 for c in r["pattern"]] for r in counted])
    post, right, prior = expectation_maximisation(patterns, np.array([r["count"] for r in counted], float))
    known = {r["pattern"]: float(p) for r, p in zip(counted, post, strict=True)}

    def examples(batches):
        for b in batches:
            rows, label = [], []
            for t in b.column(1).to_pylist():
                m, words = measures(t)
                x = features(m, words)
                at = np.flatnonzero(x)
                rows.append((at.astype(np.int32), x[at]))
                label.append(known["".join("x01"[v + 1] for v in votes(m))])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array(label, pa.float64())], names=["at", "x", "y"])

    ids = text.select("id").filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    taken = text.join(F.broadcast(ids), "id").select("id", "t").mapInArrow(examples, "at array<int>, x array<double>, y double").collect()
    x = np.zeros((len(taken), 1 << BITS), np.float32)
    for i, r in enumerate(taken):
        x[i, r["at"]] = r["x"]
    weights, bias = train(x, np.array([r["y"] for r in taken])) if taken else (np.zeros(1 << BITS), 0.0)
    return Scorer(weights, bias, right, prior)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) per row: 1 if score >= ``limit``. A null text is an empty one; repeated rows and null ids stay."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score(*measures(t)) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    out = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= limit).cast("int"))
