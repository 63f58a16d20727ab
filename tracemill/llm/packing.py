"""Sum-of-squares online packing of documents into sequences of at most `capacity` tokens.

A document that is longer than a sequence fills whole ones first. What is left of it goes, whole, to the fill level that leaves the
sum of squared counts of partially filled windows least; the counts are held in an array by level. Windows that are still partially
filled when a task ends, or when too many are open, are settled: what the emptiest hold is cut to fill the fullest, and the last
window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import segments
from .kernels import entered, holds, released, text_of

#: Tokens of a sequence, and the windows that may be open in a task; beyond that, they are settled.
CAPACITY, OPEN = 1024, 4096
#: Sequences of a task begin at its number times this.
TASK = 1 << 40

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    """The path of the public byte-level vocabulary that is installed beside the engine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Piece:
    """Part of a document's ids; doc: (doc_id, its number of ids)."""

    __slots__ = ("doc", "start", "ids")

    def __init__(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        self.doc, self.start, self.ids = doc, start, ids

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:at]), Piece(self.doc, self.start + at, self.ids[at:])


class Packer:
    """The state of one task: windows by level, and the squares' bookkeeping."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN) -> None:
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.capacity, self.most = capacity, most
        #: Number of windows by level; level 0 stands for a new window, level `capacity` for those that are full.
        self.count = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def level(self, size: int) -> int:
        """The level at which a piece of `size` leaves the least sum of squares; of equal ones the highest.

        A window that moves from level h to h + size changes the sum by 1 - 2 count[h], for a partially filled one, and by
        1 + 2 count[h + size], unless it is full then.
        """
        top = self.capacity - size
        change = np.empty(top + 1, np.int64)
        np.subtract(self.count[size:], self.count[: top + 1], out=change)
        change *= 2
        change += 2
        change[0] -= 1 + 2 * self.count[0]
        change[top] -= 1
        change[1:][self.count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Takes a document's ids and yields the sequences that are full then."""
        whole = len(ids) - len(ids) % self.capacity
        for at in range(0, whole, self.capacity):
            yield [Piece(doc, at, ids[at : at + self.capacity])]
        if whole == len(ids):
            return
        piece = Piece(doc, whole, ids[whole:].copy())
        size = len(piece.ids)
        h = self.level(size)
        window = self.windows[h].pop() if h else []
        window.append(piece)
        if h:
            self.count[h] -= 1
            self.open -= 1
        if h + size == self.capacity:
            yield window
        else:
            self.count[h + size] += 1
            self.windows[h + size].append(window)
            self.open += 1
            if self.open > self.most:
                yield from self.settle()

    def settle(self) -> Iterator[list[Piece]]:
        """Empties all open windows into sequences without padding: full ones, and powers of two at the end."""
        windows = [w for level in self.windows for w in level]
        self.count[:] = 0
        self.windows = [[] for _ in range(self.capacity + 1)]
        self.open, low, high = 0, 0, len(windows) - 1
        while low <= high:
            window = windows[high]
            gap = self.capacity - sum(len(p.ids) for p in window)
            while gap and low < high:
                piece = windows[low].pop()
                if len(piece.ids) > gap:
                    rest, piece = piece.cut(len(piece.ids) - gap)
                    windows[low].append(rest)
                gap -= len(piece.ids)
                window.append(piece)
                low += not windows[low]
            if gap:
                yield from self._powers(window)
            else:
                yield window
            high -= 1

    def _powers(self, window: list[Piece]) -> Iterator[list[Piece]]:
        left = sum(len(p.ids) for p in window)
        rest = window[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            out = []
            while size:
                piece = rest.pop()
                if len(piece.ids) > size:
                    piece, more = piece.cut(size)
                    rest.append(more)
                size -= len(piece.ids)
                out.append(piece)
            yield out


@functools.lru_cache(maxsize=1)
def _encoded(path: str) -> segments.Memory:
    """A worker's memory of segments, kept from task to task."""
    holds(__name__, _encoded.cache_clear)
    encode = segments.byte_level(path, True)
    return segments.Memory(lambda new: {"ids": encode(new)}, {"ids": np.uint32})


def ids_of(texts: pa.Array, memory: segments.Memory, last: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each text's followed by the id `last`, and where each text's end."""
    run, row = segments.of_texts(texts, memory)
    ids = memory.runs["ids"]
    ends = np.cumsum(np.bincount(row, ids.counts(run), len(texts)).astype(np.int64))
    return np.insert(ids.take(run), ends, last), ends + np.arange(1, len(texts) + 1)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, last: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the vocabulary's for its whole text (null: empty) and the id `last`; every id lies in one piece, a
    sequence's pieces follow each other without gaps from offset 0 on, and no sequence is longer than `capacity`, a power of two.
    Every sequence is full or a power of two long. Each task packs the documents that it reads, in their order, and numbers its
    sequences from its own number on, so nothing is shuffled and a task that is run again gives the same rows. Repeated rows and
    null doc_ids are documents of their own; an empty table has no pieces; other columns are not read.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered(__name__)
        memory, packer = _encoded(path), Packer(capacity)
        number = TaskContext.get().partitionId() * TASK

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for window in sequences:
                offset = 0
                for p in window:
                    out.append((p.doc[0], p.start, len(p.ids), zlib.crc32(p.ids), p.doc[1], number, offset))
                    offset += len(p.ids)
                number += 1
            columns = list(zip(*out)) if out else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for part in segments.by_bytes(batch):
                ids, ends = ids_of(text_of(part), memory, last)
                full: list[list[Piece]] = []
                begin = 0
                for doc_id, end in zip(part.column(0).to_pylist(), ends.tolist()):
                    full.extend(packer.add((doc_id, end - begin), ids[begin:end]))
                    begin = end
                yield rows(full)
            released()
        yield rows(list(packer.settle()))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
