"""Vector bin packing of examples into training sequences.

A sequence has three limits: tokens, segments (pieces) and loss-bearing tokens. Examples may be cut. What fills a
sequence by itself becomes one; the rest of each example waits in a pool, and one sequence at a time is filled from it
by the dot-product heuristic: of the pieces that fit, the one whose demand has the largest dot product with what the
sequence has left, both as shares of the limits. When none fits, the largest is cut to fill it. So padding is left only
where the segment or loss limit binds, and at the end of a partition, whose last sequence is split into lengths that
are powers of two and need no padding.

Each partition of the input packs itself in one pass with a pool of bounded size: no shuffle, nothing grows with the
input, and a rerun of a task gives the same pieces. sequence_id is the partition's number times 2**33 plus a counter.

Null text: an example of the end id alone. Repeated rows and ties: each row is packed on its own; equal scores take the
piece that came first. Empty table: no pieces. Further columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, long_binary, small_batches
from .tokens import Encoder, with_end

PIECES = "doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, padded_length long, ids binary"


class Packer:
    """Packs examples that come one by one; pieces leave through `out`."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int, first_id: int):
        self.cap = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss, self.pool = tokens, segments, loss, pool
        self.next = first_id
        self.items: list[list] = []  # doc_id, ids, start, where its loss begins
        self.demand = np.zeros((2 * pool, 3))
        self.out: list[tuple] = []
        self.bytes = 0

    def _lost(self, item, length: int) -> int:
        return max(0, item[2] + length - max(item[2], item[3]))

    def _most(self, item, tokens: int, loss: int) -> int:
        """The longest piece at the head of what is left of an example within both limits."""
        return max(0, min(len(item[1]) - item[2], tokens, max(item[3] - item[2], 0) + loss))

    def _emit(self, pieces: list[tuple]) -> None:
        used, at = sum(p[2] for p in pieces), 0
        padded = used if used & (used - 1) == 0 else self.tokens
        for item, start, length, loss in pieces:
            self.out.append((item[0], start, length, len(item[1]), loss, self.next, at, padded, item[1][start : start + length]))
            at += length
            self.bytes += 4 * length
        self.next += 1

    def _cut(self, item, length: int) -> tuple:
        piece = (item, item[2], length, self._lost(item, length))
        item[2] += length
        return piece

    def add(self, doc_id, ids: np.ndarray, loss: int) -> None:
        item = [doc_id, ids, 0, len(ids) - min(max(loss, 0), len(ids))]
        while (n := self._most(item, self.tokens, self.loss)) == self.tokens:
            self._emit([self._cut(item, n)])
        if item[2] < len(ids):
            self.items.append(item)
            self._note(len(self.items) - 1)
        while len(self.items) >= self.pool:
            self._emit(self._fill())

    def _note(self, i: int) -> None:
        item = self.items[i]
        n = len(item[1]) - item[2]
        if i >= len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.demand[i] = (n, 1, self._lost(item, n))

    def _fill(self) -> list[tuple]:
        left, pieces = self.cap.copy(), []
        gone = np.zeros(len(self.items), bool)
        while left[0] >= 1 and left[1] >= 1 and not gone.all():
            d = self.demand[: len(self.items)]
            fits = ~gone & (d <= left).all(1)
            if fits.any():
                score = np.where(fits, d @ (left / self.cap**2), -1.0)
                i = int(score.argmax())
                n = int(d[i, 0])
            else:
                i = int(np.where(gone, -1.0, d[:, 0]).argmax())
                n = self._most(self.items[i], int(left[0]), int(left[2]))
                if n == 0:
                    break
            item = self.items[i]
            lost = self._lost(item, n)
            pieces.append(self._cut(item, n))
            left -= (n, 1, lost)
            if item[2] == len(item[1]):
                gone[i] = True
            else:
                self._note(i)
        if gone.any():
            keep = np.flatnonzero(~gone)
            self.demand[: len(keep)] = self.demand[keep]
            self.items = [self.items[i] for i in keep]
        return pieces

    def flush(self) -> None:
        while self.items:
            pieces = self._fill()
            used = sum(p[2] for p in pieces)
            if self.items or used == self.tokens:
                self._emit(pieces)
                continue
            for bit in reversed(range(used.bit_length())):  # the last sequence, as powers of two
                room, part = used & (1 << bit), []
                while room:
                    item, start, length, loss = pieces[0]
                    n = min(room, length)
                    head = min(loss, max(0, start + n - max(start, item[3])))
                    part.append((item, start, n, head))
                    room -= n
                    if n == length:
                        pieces.pop(0)
                    else:
                        pieces[0] = (item, start + n, length - n, loss - head)
                if part:
                    self._emit(part)

    def take(self) -> pa.RecordBatch | None:
        if not self.out:
            return None
        doc, start, length, total, loss, seq, at, padded, ids = zip(*self.out, strict=True)
        self.out, self.bytes = [], 0
        flat = np.concatenate(ids).astype("<u4", copy=False)
        return batch(doc_id=pa.array(doc, pa.int64()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), doc_tokens=pa.array(total, pa.int64()), loss_tokens=pa.array(loss, pa.int64()), sequence_id=pa.array(seq, pa.int64()), offset=pa.array(at, pa.int64()), padded_length=pa.array(padded, pa.int64()), ids=long_binary(flat, np.array(length, np.int64)))


def pack(docs: DataFrame, tokenizer: str, end_id: int, tokens: int = 2048, segments: int = 256, loss: int | None = None, loss_column: str | None = None, pool: int = 256) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers.

    loss_column holds how many of an example's last tokens bear loss; without it, or where it is null, all do.
    """
    small_batches(docs.sparkSession)
    most = tokens if loss is None else loss
    if min(tokens, segments, most, pool) < 1:
        raise ValueError("limits must be positive")
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    cols.append(F.col(loss_column).cast("long").alias("loss") if loss_column else F.lit(None).cast("long").alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(tokenizer)
        packer = Packer(tokens, segments, most, pool, TaskContext.get().partitionId() << 33)
        for b in batches:
            ids, counts = with_end(*encoder.encode(b.column("text")), end_id)
            ends = np.cumsum(counts)
            for doc, lost, lo, hi in zip(b.column("doc_id").to_pylist(), b.column("loss").to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                packer.add(doc, ids[lo:hi].copy() if hi - lo < tokens else ids[lo:hi], hi - lo if lost is None else lost)
                if packer.bytes > 4 << 20:
                    yield packer.take()
        packer.flush()
        if packer.out:
            yield packer.take()

    return docs.select(*cols).mapInArrow(run, PIECES)
