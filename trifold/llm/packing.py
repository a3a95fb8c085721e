"""Harmonic packing of token sequences.

The capacity CAPACITY is split into classes of reciprocals: a piece belongs to
class k if k of it, but not k + 1, fit into a sequence, and a sequence of class k
takes exactly k pieces.  Documents may be cut, so each is cut into pieces that
are exactly CAPACITY, CAPACITY / 2, CAPACITY / 4 ... down to LEAST tokens, whose
classes leave no padding, and one last piece below LEAST, whose class k >=
CAPACITY / LEAST pads by one part in k + 1 at most.

Each task fills its own sequences, with at most one open per class, so nothing
is shuffled.  What is open at the end of a task is strung together, cut into
full sequences and a rest of powers of two, which needs no padding.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed as often as they occur, equal doc_ids and all; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, table
from .tokens import default_path, ids

CAPACITY, LEAST, END = 2048, 64, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of a task begin at its number times this.
PER_TASK = 1 << 40


class Packer:
    """The sequences that one task fills; ``done`` gets the pieces of finished ones."""

    def __init__(self, first: int, capacity: int = CAPACITY, least: int = LEAST):
        self.next, self.capacity, self.least = first, capacity, least
        self.open: dict[int, list] = {}
        self.done: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at, size = 0, self.capacity
        while len(ids) - at >= self.least:
            while len(ids) - at < size:
                size //= 2
            self._put(size, (doc_id, at, ids[at : at + size], len(ids)))
            at += size
        if at < len(ids):
            self._put(len(ids) - at, (doc_id, at, ids[at:], len(ids)))

    def _put(self, size: int, piece: tuple) -> None:
        k = self.capacity // size
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            self._close(self.open.pop(k))

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        while left:
            room = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= room
            taken = []
            while room:
                doc_id, start, ids, total = rest.pop(0)
                taken.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc_id, start + room, ids[room:], total))
                room -= len(taken[-1][2])
            self._close(taken)

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)


def _pack(path):
    def run(batches):
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) * PER_TASK)
        end = np.array([END], np.uint32)
        for batch in chunks(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc_id, np.concatenate([ids(text.as_py(), path), end]))
            yield packer.take()
        packer.finish()
        yield packer.take()

    return run


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of the documents' tokens and where each lies."""
    return docs.select("doc_id", "text").mapInArrow(_pack(path or default_path()), PIECES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
