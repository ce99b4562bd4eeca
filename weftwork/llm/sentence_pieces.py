"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

The distinct units of a batch (spaces and the letters after them; no piece reaches across) are joined to one text. A
suffix array of it, cut at the longest piece, is searched for every piece at once; the ranges are the pieces'
occurrences, which are edges of the text. Edges are sorted by position into a table by (position, length), and the
table is relaxed: in every unit the best-scored edge over two neighbouring symbols is taken, leftmost first, until no
edge joins two symbols. That is the order in which the model's own merges run, so ids equal the model's. Characters
that no piece holds become byte pieces.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
FAR = np.int32(2**30)


class Pieces:
    """A model's pieces; texts to ids and back."""

    def __init__(self, path: str, most: int = 800_000, chars: int = 400_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of, self.byte_id = [b""] * n, np.zeros(256, np.uint32)
        usual = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_of[i], self.byte_id[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                usual.append((i, piece, model.get_score(i)))
        self.id_of = {p: i for i, p, _ in usual}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            raise ValueError("a piece reaches across a space")
        self.width = max(len(p) for p in self.id_of)
        self.ids = np.array([i for i, _, _ in usual], np.int64)
        self.lengths = np.array([len(p) for _, p, _ in usual], np.int64)
        scores = np.array([s for _, _, s in usual])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # equal scores share a rank: leftmost wins
        self.rank_of = {p: int(r) for (_, p, _), r in zip(usual, self.rank, strict=True)}
        codes = np.zeros((len(usual), self.width + 1), np.uint32)
        for k, (_, p, _) in enumerate(usual):
            codes[k, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32) + 2
        self.low = np.ascontiguousarray(codes).view(f"U{self.width + 1}").ravel()
        high = codes.copy()
        high[np.arange(len(usual)), self.lengths] = 0x110010
        self.high = np.ascontiguousarray(high).view(f"U{self.width + 1}").ravel()
        self.most, self.chars, self.known = most, chars, {}

    def suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling, up to the longest piece."""
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        depth = 1
        while depth <= self.width:
            after = np.zeros_like(rank)
            after[:-depth] = rank[depth:] + 1
            rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)[1].astype(np.int64)
            depth *= 2
        return np.argsort(rank, kind="stable")

    def encode_units(self, units: list[str]) -> None:
        """Put the ids of each unit, as little-endian unsigned 32-bit bytes, into ``known``."""
        codes = np.frombuffer("\x00".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        size = np.array([len(u) for u in units])
        begin = np.cumsum(size + 1) - size - 1
        codes += 2
        codes[(begin + size)[:-1]] = 1
        n, w = len(codes), self.width + 1
        order = self.suffixes(codes)
        padded = np.r_[codes, np.zeros(w, np.uint32)]
        windows = np.lib.stride_tricks.sliding_window_view(padded, w)[order]
        heads = np.ascontiguousarray(windows).view(f"U{w}").ravel()
        first, last = np.searchsorted(heads, self.low), np.searchsorted(heads, self.high)
        count = last - first
        piece = np.repeat(np.arange(len(count)), count)
        at = order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(piece))]
        by_place = np.argsort(at, kind="stable")
        at, piece = at[by_place], piece[by_place]
        edge = np.full((n, w), FAR, np.int32)
        edge_id = np.full((n, w), -1, np.int32)
        edge[at, self.lengths[piece]] = self.rank[piece]
        edge_id[at, self.lengths[piece]] = self.ids[piece]

        start = np.concatenate([np.arange(b, b + s) for b, s in zip(begin, size, strict=True)])
        end, unit = start + 1, np.repeat(np.arange(len(units)), size)
        done: list[tuple] = []
        while len(start):
            length = np.r_[end[1:] - start[:-1], w]
            joins = np.r_[unit[1:] == unit[:-1], False] & (length < w)
            rank = np.where(joins, edge[start, np.minimum(length, w - 1)], FAR).astype(np.int64)
            heads = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            best = np.minimum.reduceat(rank * len(start) + np.arange(len(start)), heads)
            more = best // len(start) < FAR
            live = np.repeat(more, np.diff(np.r_[heads, len(start)]))
            done.append((unit[~live], start[~live], end[~live]))
            i = best[more] % len(start)
            end = end.copy()
            end[i] = end[i + 1]
            live[i + 1] = False
            start, end, unit = start[live], end[live], unit[live]
        unit, start, end = (np.concatenate(x) for x in zip(*done, strict=True))
        back = np.argsort(unit, kind="stable")
        unit, start, end = unit[back], start[back], end[back]
        ids = edge_id[start, end - start]
        cut = np.searchsorted(unit, np.arange(len(units) + 1))
        missing = np.add.reduceat(ids < 0, cut[:-1]) > 0
        data = ids.astype("<u4").tobytes()
        for u, text in enumerate(units):
            if not missing[u]:
                self.known[text] = data[4 * cut[u] : 4 * cut[u + 1]]
            else:
                parts = [np.array([i], "<u4") if i >= 0 else self.byte_id[list(text[s - begin[u] : e - begin[u]].encode("utf-8", "surrogatepass"))] for i, s, e in zip(ids[cut[u] : cut[u + 1]].tolist(), start[cut[u] : cut[u + 1]].tolist(), end[cut[u] : cut[u + 1]].tolist(), strict=True)]
                self.known[text] = np.concatenate(parts).astype("<u4").tobytes()

    def encode_long(self, unit: str) -> bytes:
        """The same order of joins for one long unit, by a queue instead of rounds."""
        import heapq

        n = len(unit)
        stop, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue: list[tuple[int, int, int]] = []

        def offer(i):
            j = stop[i]
            if j < n and stop[j] - i <= self.width and (r := self.rank_of.get(unit[i : stop[j]])) is not None:
                heapq.heappush(queue, (r, i, stop[j]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, e = heapq.heappop(queue)
            j = stop[i] if alive[i] else n
            if j >= n or stop[j] != e:
                continue
            alive[j], stop[i] = False, e
            if e < n:
                prev[e] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out: list[int] = []
        i = 0
        while i < n:
            part = unit[i : stop[i]]
            out += [self.id_of[part]] if part in self.id_of else self.byte_id[list(part.encode("utf-8", "surrogatepass"))].tolist()
            i = stop[i]
        return np.array(out, "<u4").tobytes()

    def units(self, text: str) -> list[str]:
        whole = SPACE + text.replace(" ", SPACE)
        if SPACE + SPACE not in whole:
            return [SPACE + w for w in whole.split(SPACE)[1:]]
        return _UNIT.findall(whole)

    def encode(self, texts: list[str | None], long: int = 256) -> list[bytes]:
        """Ids of each text as bytes; a null or empty text has none."""
        split = [self.units(t) if t else [] for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new, size = [], 0
        for u in {u for units in split for u in units}.difference(self.known):
            if len(u) > long:
                self.known[u] = self.encode_long(u)
                continue
            new.append(u)
            size += len(u) + 1
            if size > self.chars:
                self.encode_units(new)
                new, size = [], 0
        if new:
            self.encode_units(new)
        known = self.known.__getitem__
        return [b"".join(map(known, units)) for units in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) per row; null and empty texts have no ids; repeated rows and null ids stay as they are."""

    def run(batches):
        p = pieces(model)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                found = [np.frombuffer(x, "<u4").astype(np.int32) for x in p.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) per row of ids; a null list is an empty text."""

    def run(batches):
        p = pieces(model)
        for b in batches:
            texts = [p.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")


def encoding_report(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip) per row: whether decoding the ids gives the text again."""

    def run(batches):
        p = pieces(model)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                texts = part.column(1).to_pylist()
                found = p.encode(texts)
                same = [p.decode(x) == (t or "").replace(SPACE, " ") for x, t in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
