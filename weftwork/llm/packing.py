"""Vector bin packing of token sequences.

Examples go into sequences (bins) under three limits at once: tokens, segments and loss-bearing tokens. The
dot-product heuristic fills one bin at a time: of the waiting pieces that fit under every limit it takes the one
whose demand vector has the largest dot product with the bin's remaining capacities (both as shares of the limits).
Where nothing fits whole, the longest waiting piece is cut at the bin's remainder.

Each task packs what it reads, in windows of bounded size, and carries the pool over; there is no shuffle. Whole
bins are cut off long documents first. The last bin of a task is split into powers of two, which need no padding.
"""

from __future__ import annotations

import array
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048


class Chunks:
    """Token ids of a text as little-endian unsigned 32-bit bytes, by a cache of space-led chunks.

    The byte-level pattern never joins across a single space that stands before another visible character, so a text
    without runs of spaces is the sum of its chunks. Other texts are encoded whole. The cache is emptied when full.
    """

    def __init__(self, path: str, most: int = 250_000) -> None:
        import json

        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        units = _byte_units()
        self.path, self.library = path, None
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(units[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in set(self.added)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.most, self.known = most, {}

    def whole(self, text: str) -> bytes:
        return array.array("I", self.encoding.encode_ordinary(text)).tobytes()

    def tokens(self, text: str) -> bytes:
        """The ids as the tokenizer file has them: a text that holds an added token's content goes to the library."""
        if not any(t in text for t in self.added):
            return self.ids(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of ``text`` as plain text, added tokens' contents too."""
        if "  " in text:
            return self.whole(text)
        known = self.known
        first, *rest = text.split(" ")
        try:
            return self.whole(first) + b"".join([known[w] for w in rest])
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in set(rest):
                if w not in known:
                    known[w] = self.whole(" " + w)
            return self.whole(first) + b"".join([known[w] for w in rest])


def _byte_units() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


class Packer:
    """Pieces in, placed pieces out: rows (key, start, length, sequence, offset, padded_to)."""

    def __init__(self, limits: Limits, window: int = 2048) -> None:
        self.limits, self.window = limits, window
        self.caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.pool: list[tuple[int, int, int, int]] = []  # key, start, tokens, loss-bearing tokens (the last ones)
        self.sequence = 0

    def add(self, key: int, tokens: int, loss: int) -> Iterator[tuple]:
        most = min(self.limits.tokens, self.limits.loss_tokens) if loss else self.limits.tokens
        start = 0
        while tokens - start >= most:
            yield key, start, most, self.sequence, 0, self.padded(most)
            self.sequence += 1
            start += most
        if tokens > start:
            self.pool.append((key, start, tokens - start, min(loss, tokens - start)))
        if len(self.pool) >= 2 * self.window:
            yield from self.fill(self.window)

    def padded(self, n: int) -> int:
        return n if n & (n - 1) == 0 else self.limits.tokens

    def fill(self, keep: int) -> Iterator[tuple]:
        """Close bins until at most ``keep`` pieces wait; with keep 0 the last bin is split at powers of two."""
        d = np.array([(t, 1, x) for _, _, t, x in self.pool], float).reshape(-1, 3)
        alive = np.ones(len(d), bool)
        items, left = list(self.pool), len(self.pool)
        while left > keep:
            room, used, placed = self.caps.copy(), 0, []
            while left and room.min() > 0:
                fits = alive & (d <= room).all(1)
                if fits.any():
                    gain = np.where(fits, (d / self.caps) @ (room / self.caps), -1)
                    k = int(gain.argmax())
                    key, start, n, loss = items[k]
                    alive[k] = False
                    left -= 1
                else:
                    k = int(np.where(alive, d[:, 0], -1).argmax())
                    key, start, whole, had = items[k]
                    n = int(min(room[0], room[2], whole))
                    loss = min(n, max(0, had - (whole - n)))
                    if n == whole:
                        break
                    loss = max(0, n - (whole - had))  # the loss-bearing tokens stand last
                    items[k] = (key, start + n, whole - n, had - loss)
                    d[k] = (whole - n, 1, had - loss)
                placed.append((key, start, n))
                room -= (n, 1, loss)
                used += n
            if left or used == self.limits.tokens:
                yield from self.emit(placed, used)
            else:
                yield from self.split(placed, used)
        self.pool = [x for x, ok in zip(items, alive, strict=True) if ok]

    def emit(self, placed, used) -> Iterator[tuple]:
        offset, full = 0, self.padded(used)
        for key, start, n in placed:
            yield key, start, n, self.sequence, offset, full
            offset += n
        self.sequence += 1

    def split(self, placed, used) -> Iterator[tuple]:
        placed = placed[::-1]
        for size in (1 << k for k in range(used.bit_length() - 1, -1, -1) if used >> k & 1):
            part, room = [], size
            while room:
                key, start, n = placed.pop()
                take = min(n, room)
                part.append((key, start, take))
                if take < n:
                    placed.append((key, start + take, n - take))
                room -= take
            yield from self.emit(part, size)


def _placed(limits: Limits, tokenizer: str, end_id: int):
    end = array.array("I", [end_id]).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = chunks(tokenizer), Packer(limits)
        base = TaskContext.get().partitionId() << 40
        ids: dict[int, tuple[int | None, bytes]] = {}  # of documents with waiting pieces
        rows: list[tuple] = []

        def place(pieces):
            for key, start, n, sequence, offset, full in pieces:
                doc, data = ids[key]
                rows.append((doc, start, n, zlib.crc32(memoryview(data)[4 * start : 4 * (start + n)]), len(data) // 4, base + sequence, offset, full))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 8, names=[c.split()[0] for c in PIECES.split(", ")])
            rows.clear()
            return out

        key = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = encoder.tokens(text or "") + end
                ids[key] = (doc, data)
                place(packer.add(key, len(data) // 4, len(data) // 4))
                key += 1
                if len(ids) > 4 * packer.window:
                    waiting = {p[0] for p in packer.pool}
                    for k in [k for k in ids if k not in waiting]:
                        del ids[k]
            yield flush()
        place(packer.fill(0))
        yield flush()
        encoder.known.clear()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), end_id: int = 1) -> DataFrame:  # noqa: B008
    """One row per placed piece (``PIECES``): every token of every document lies in exactly one piece.

    A document's tokens are its text's ids and then ``end_id``; a null or empty text has that id alone. All tokens are
    loss-bearing. ``padded_to`` is the sequence's length with padding. Repeated rows are packed as often as they
    occur; a null id stays null; an empty table gives no rows; columns besides id and text are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(_placed(limits, tokenizer, end_id)), PIECES)


def _packed_examples(limits: Limits):
    def run(batches):
        packer, base, names = Packer(limits), TaskContext.get().partitionId() << 40, ["id", "start", "length", "sequence_id", "offset", "padded_to"]
        keys: dict[int, int | None] = {}  # of the pieces that wait

        def batch(pieces):
            rows = [(keys[k], s, n, base + q, o, p) for k, s, n, q, o, p in pieces]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, names=names)

        at = 0
        for b in batches:
            pieces = []
            for key, tokens, loss in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                keys[at] = key
                pieces += packer.add(at, max(0, tokens or 0), max(0, loss or 0))
                at += 1
            yield batch(pieces)
            waiting = {p[0] for p in packer.pool}
            for k in [k for k in keys if k not in waiting]:
                del keys[k]
        yield batch(packer.fill(0))

    return run


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Pieces of examples that are already counted: (id, start, length, sequence_id, offset, padded_to).

    For instruction data: ``loss_col`` holds each example's loss-bearing tokens, which stand at its end. Null or
    negative counts are taken as zero, and an example without tokens has no piece.
    """
    return examples.select(F.col(id_col).cast("long"), F.col(tokens_col).cast("long"), F.col(loss_col).cast("long")).mapInArrow(_packed_examples(limits), "id long, start long, length long, sequence_id long, offset long, padded_to long")
