"""Length-limited canonical Huffman codes over integer symbols, in numpy.

A stream is cut into blocks that decode on their own. A block carries the bit
offset of every STEP-th symbol, so that all its runs of STEP symbols are
decoded side by side with one table look-up per symbol.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 64
_HEAD = struct.Struct("<4sIQI")
_MAGIC = b"HUF1"


def code_lengths(counts: np.ndarray, max_bits: int = 16) -> np.ndarray:
    """Optimal lengths of at most max_bits for counts > 0 (package-merge); 0 elsewhere.

    One used symbol gets one bit. max_bits grows where the symbols need it.
    """
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    merged_by_level = []
    previous = np.zeros(0)
    for _ in range(max_bits):
        both = np.concatenate([weight, previous])
        rank = np.argsort(both, kind="stable")
        merged_by_level.append(rank)
        row = both[rank]
        even = len(row) // 2 * 2
        previous = row[0:even:2] + row[1:even:2]
    take = 2 * n - 2
    depth = np.zeros(n, np.int64)
    for rank in reversed(merged_by_level):
        chosen = rank[:take]
        leaves = chosen[chosen < n]
        depth[leaves] += 1
        take = 2 * int((chosen >= n).sum())
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = 0
    last = 0
    sizes = lengths[order].astype(int)
    for size in np.unique(sizes):
        own = order[sizes == size]
        code <<= int(size) - last
        last = int(size)
        codes[own] = code + np.arange(len(own))
        code += len(own)
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.codes = canonical(self.lengths)
        self.bits = int(self.lengths.max(initial=1)) or 1
        self._table = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for each value of the next self.bits bits."""
        if self._table is None:
            symbol, size = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.uint8)
            used = np.flatnonzero(self.lengths)
            used = used[np.argsort(self.codes[used].astype(np.uint64) << (self.bits - self.lengths[used]).astype(np.uint64), kind="stable")]
            spans = (1 << (self.bits - self.lengths[used].astype(np.int64)))
            total = int(spans.sum())
            symbol[:total], size[:total] = np.repeat(used, spans), np.repeat(self.lengths[used], spans)
            self._table = symbol, size
        return self._table

    def encode(self, ids: np.ndarray) -> bytes:
        """A block: magic, symbols, bits, checkpoints, bit offsets, code words."""
        ids = np.asarray(ids)
        n = len(ids)
        sizes = self.lengths[ids].astype(np.int64)
        if n and not sizes.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(sizes)
        offsets = ends - sizes
        bits = int(ends[-1]) if n else 0
        words = np.zeros(bits // 32 + 2, np.uint64)
        if n:
            word = offsets >> 5
            value = self.codes[ids].astype(np.uint64) << (64 - (offsets & 31) - sizes).astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sums = np.add.reduceat(value, first)
            at = word[first]
            words[at] += sums >> np.uint64(32)
            words[at + 1] += sums & np.uint64(0xFFFFFFFF)
        marks = offsets[::STEP]
        return _HEAD.pack(_MAGIC, n, bits, len(marks)) + marks.astype("<u8").tobytes() + words.astype(">u4").tobytes()

    def decode(self, block: bytes) -> np.ndarray:
        magic, n, bits, n_marks = _HEAD.unpack_from(block)
        if magic != _MAGIC:
            raise ValueError("no Huffman block")
        out = np.zeros(n_marks * STEP, np.uint32)
        if not n:
            return out[:0]
        at = np.frombuffer(block, "<u8", n_marks, _HEAD.size).astype(np.int64)
        words = np.frombuffer(block, ">u4", bits // 32 + 2, _HEAD.size + 8 * n_marks).astype(np.uint64)
        words = np.concatenate([words, np.zeros(2, np.uint64)])
        pairs = words[:-1] << np.uint64(32) | words[1:]
        symbol, size = self.table()
        top, mask = np.int64(64 - self.bits), np.uint64((1 << self.bits) - 1)
        rows = out.reshape(n_marks, STEP)
        for k in range(STEP):
            live = n_marks if k < (n - 1) % STEP + 1 else n_marks - 1
            here = at[:live]
            code = (pairs[here >> 5] >> (top - (here & 31)).astype(np.uint64)) & mask
            rows[:live, k] = symbol[code]
            at[:live] = here + size[code]
        return out[:n]
