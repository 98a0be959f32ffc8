"""Sum-of-squares online packing of documents into windows of bounded token length.

Each task packs its documents as they come. A level array counts the open
windows by fill; a document goes to the fill level where the sum of squared
counts is least afterwards (of equals the fullest), so that no level piles up
and later documents find gaps of every size. Levels that need no padding weigh
nothing: 0, a full window, and powers of two from an eighth of a window on. A
document longer than a window fills whole windows first; the rest of it is
placed. When over most_open windows stand open, and at the end, open windows
are settled: the least filled give pieces, cut where needed, to the fullest.
The last one of a task is cut into powers of two. So a task keeps most_open
windows at most, nothing is padded, and a document that fits a window is cut
only where open windows are settled.

Cases: a null text counts as empty and becomes a piece of the end id alone; an
empty table gives no rows; a null id stays null; rows with equal ids are packed
each on its own; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

_NEVER = np.int64(-(1 << 60))


def unpadded(size: int) -> list[int]:
    """Fills under size at which a window may stay as it is."""
    return [f for f in (1 << k for k in range(size.bit_length())) if size // 8 <= f < size]


class Windows:
    """The windows of one task; rows of closed ones wait in .rows: (document, start, ids, document's tokens, sequence, offset).

    ids are bytes, four a token. A window is a list of pieces (document, start, ids, document's tokens).
    """

    def __init__(self, size: int, first: int = 0, most_open: int = 4096):
        self.size, self.next, self.most_open = size, first, most_open
        self.weight = np.ones(size + 1, np.int64)
        self.weight[[0, size, *unpadded(size)]] = 0
        self.counts = np.zeros(size + 1, np.int64)
        self.enter = self.weight.copy()  # what one window more at a level adds to the sum
        self.leave = np.full(size + 1, _NEVER)  # what one window less takes from it
        self.leave[0] = 0  # a new window leaves no level
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.n_open, self.rows = 0, []

    def level(self, n: int) -> int:
        """The fill of the window, 0 for a new one, that takes n tokens best."""
        change = self.enter[n:] - self.leave[: self.size + 1 - n]
        return len(change) - 1 - int(change[::-1].argmin())

    def _count(self, level: int, by: int) -> None:
        self.n_open += by
        n = self.counts[level] = self.counts[level] + by
        self.enter[level] = self.weight[level] * (2 * n + 1)
        self.leave[level] = self.weight[level] * (2 * n - 1) if n else _NEVER

    def _close(self, window: list) -> None:
        at = 0
        for document, start, ids, n in window:
            self.rows.append((document, start, ids, n, self.next, at))
            at += len(ids) // 4
        self.next += 1

    def add(self, document, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.size
        for start in range(0, whole, self.size):
            self._close([(document, start, ids[4 * start : 4 * (start + self.size)], n)])
        if whole < n:
            self._place((document, whole, ids[4 * whole :], n), n - whole)
        if self.n_open > self.most_open:
            self.settle()

    def _place(self, piece: tuple, n: int) -> None:
        level = self.level(n)
        window = self.open[level].pop() if level else []
        if level:
            self._count(level, -1)
        window.append(piece)
        if level + n == self.size:
            self._close(window)
        else:
            self.open[level + n].append(window)
            self._count(level + n, 1)

    def settle(self) -> None:
        """Close every open window without padding."""
        free, waiting = set(unpadded(self.size)), []
        for level in range(1, self.size):
            for window in self.open[level]:
                if level in free:
                    self._close(window)
                else:
                    waiting.append(window)
            if self.open[level]:
                self.open[level] = []
                self._count(level, -int(self.counts[level]))
        low, high = 0, len(waiting) - 1  # by fill, the least first
        while low < high:
            gap = self.size - sum(len(p[2]) for p in waiting[high]) // 4
            while gap and low < high:
                gap -= self._give(waiting[low], waiting[high], gap)
                low += not waiting[low]
            if gap:
                break  # the window at high is the last one
            self._close(waiting[high])
            high -= 1
        if low == high:
            self._halve(waiting[low])

    def _give(self, giver: list, taker: list, most: int) -> int:
        """Move the giver's last piece, or as many of its last tokens as there is room for."""
        document, start, ids, n = giver.pop()
        here = len(ids) // 4
        if here > most:
            giver.append((document, start, ids[: 4 * (here - most)], n))
            start, ids, here = start + here - most, ids[4 * (here - most) :], most
        taker.append((document, start, ids, n))
        return here

    def _halve(self, window: list) -> None:
        """Cut one window into windows of powers of two, the longest first."""
        window = window[::-1]  # given from the end, so that parts keep their order
        left = sum(len(p[2]) for p in window) // 4
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            part: list = []
            while room:
                document, start, ids, n = window.pop()
                here = min(room, len(ids) // 4)
                part.append((document, start, ids[: 4 * here], n))
                if ids[4 * here :]:
                    window.append((document, start + here, ids[4 * here :], n))
                room -= here
            self._close(part)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, size: int = 1024, most_open: int = 4096, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    There is no shuffle: a task of the scan is a stream of its own, whose number
    leads the numbers of its sequences, so a task that runs again gives the same rows.
    """
    path = tokenizer or tokens.default_path()

    def run(batches):
        enc, stream = tokens.encoder(path), Windows(size, TaskContext.get().partitionId() << 32, most_open)

        def closed():
            rows, stream.rows = stream.rows, []
            if rows:
                names, starts, ids, totals, sequences, offsets = map(list, zip(*rows, strict=True))
                yield common.batch(_SCHEMA, names, starts, [len(x) // 4 for x in ids], ids, totals, sequences, offsets)

        for b in batches:
            names, texts = b.column(0).to_pylist(), common.text_list(b.column(1))
            for lo, hi in tokens.groups_of_chars(texts):
                ids, sizes = enc.encode(texts[lo:hi])
                raw, at = ids.astype("<u4").tobytes(), 0
                for name, n in zip(names[lo:hi], sizes.tolist(), strict=True):
                    stream.add(name, raw[4 * at : 4 * (at + n)])
                    at += n
                yield from closed()
        stream.settle()
        yield from closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of them."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
