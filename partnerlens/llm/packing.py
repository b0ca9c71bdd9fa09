"""Op 5: sum-of-squares online packing.

N(h) counts the open windows filled to level h.  Each arriving piece goes to
the level (or to a new window) for which the sum of N(h)**2 over all levels
grows least, fuller levels first on ties; counts and windows are kept in
arrays by level.  A document longer than a window is first cut into whole
windows and a rest.  When the stream of a task ends, the pieces of its still
open windows are laid end to end and cut at window bounds, so a task leaves at
most one unfilled window.  Tasks take at least BLOCK_BYTES of text each, if the
table has as much, so that few windows are open when they end."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from partnerlens.llm.encoder import chunks, encoder

BLOCK_BYTES = 48 << 20  # text a task packs at least (one task for a smaller table)
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class SumOfSquares:
    """Online choice of a fill level for pieces of 1 .. size-1 ids."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)  # by level; levels 0 and size are never counted
        self.open: list[list] = [[] for _ in range(size + 1)]  # by level: open windows, each a list of pieces

    def choose(self, n: int) -> int:
        """Level whose window gets a piece of n ids; 0 is a new window."""
        c, last = self.count, self.size - n
        # what the sum of squares changes by, for a move from level h to h + n
        grow = 2 * (c[n:n + last + 1] - c[:last + 1]) + 2
        grow[0] = 2 * c[n] + 1
        grow[last] = 1 - 2 * c[last] if last else 1
        grow[1:][c[1:last + 1] == 0] = np.iinfo(np.int64).max
        return int(last - np.argmin(grow[::-1]))

    def put(self, piece, n: int) -> list | None:
        """Places a piece; returns the window's pieces if that fills it."""
        h = self.choose(n)
        window = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
        window.append(piece)
        if h + n == self.size:
            return window
        self.count[h + n] += 1
        self.open[h + n].append(window)
        return None

    def rest(self) -> Iterator[list]:
        for level in range(self.size, 0, -1):
            yield from self.open[level]


def _packer(tokenizer: str, end_id: int, size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, state, rows = encoder(tokenizer), SumOfSquares(size), []
        sequence = TaskContext.get().partitionId() << 33

        def emit(window) -> None:
            nonlocal sequence
            at = 0
            for doc, start, ids, whole in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, sequence, at))
                at += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 7
            rows.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols],
                                   names=[f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            for a, texts in chunks(batch.column(1)):
                for doc, ids in zip(batch.column(0).slice(a, len(texts)).to_pylist(), enc.encode(texts, end_id)):
                    n = len(ids)
                    cut = n // size * size
                    for s in range(0, cut, size):
                        emit([(doc, s, ids[s:s + size], n)])
                    if cut < n and (full := state.put((doc, cut, ids[cut:].copy(), n), n - cut)):
                        emit(full)
                if rows:
                    yield flush()
        window, room = [], size
        for piece in (p for w in state.rest() for p in w):
            doc, start, ids, n = piece
            while len(ids):
                window.append((doc, start, ids[:room], n))
                start, taken = start + min(room, len(ids)), min(room, len(ids))
                ids, room = ids[taken:], room - taken
                if not room:
                    emit(window)
                    window, room = [], size
        if window:
            emit(window)
        if rows:
            yield flush()
    return pack


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, order: str | None = None,
         key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  Every task packs the rows of its partitions as they
    arrive; with ``order`` rows arrive by that column (range partitions).  A
    null text counts as empty and gives its end id only; a text of any length
    is cut into whole windows and a rest, of which alone a copy is held; rows
    that repeat a key are packed one by one; other columns are not looked at;
    an empty table gives no pieces."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       *([F.col(order).alias("at")] if order else []))
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    tasks = max(1, total // block_bytes)
    # without an order partitions are read several to a task, nothing is shuffled
    rows = rows.repartitionByRange(tasks, "at").sortWithinPartitions("at") if order else rows.coalesce(tasks)
    return rows.select("key", "text").mapInArrow(_packer(tokenizer, end_id, size), PIECES)
