"""Packing of documents into sequences of bounded token length.

Documents are cut only if they are longer than a sequence. Pieces of equal
length are alike for packing, so the plan is made on the histogram of lengths,
which has as many rows as a sequence has tokens at most, however large the
corpus is: best-fit decreasing, then a local search that moves and exchanges
pieces (one for one, two for one) between underfull bins wherever the sum of
squared fills grows, until no exchange helps. A bin pattern with a multiplicity
stands for all bins filled alike. Pieces then find their places by their rank
among pieces of their length.

Cases: a null text counts as empty and becomes a piece of the end id alone; an
empty table gives an empty result; a null id stays null; rows with equal ids
are packed each on its own; other columns are left out.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, k long"


def best_fit(histogram: dict[int, int], size: int) -> dict[tuple[int, ...], int]:
    """Bin patterns (lengths, descending) and their multiplicities by best-fit decreasing."""
    room: dict[int, list[list]] = defaultdict(list)  # free space -> [pattern, bins]

    def put(pattern: tuple, bins: int) -> None:
        room[size - sum(x * n for x, n in pattern)].append([pattern, bins])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for free in range(length, size + 1):
            if not left:
                break
            if free not in room:
                continue
            each = free // length
            for group in room.pop(free):
                pattern, bins = group
                full = min(bins, left // each)
                if full:
                    put((*pattern, (length, each)), full)
                    left -= full * each
                    bins -= full
                if bins and left:
                    some = min(left, each)
                    put((*pattern, (length, some)), 1)
                    left -= some
                    bins -= 1
                if bins:
                    put(pattern, bins)
        each = size // length
        if left >= each:
            put(((length, each),), left // each)
            left %= each
        if left:
            put(((length, left),), 1)
    plan: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in room.values():
        for pattern, bins in groups:
            plan[tuple(x for x, n in pattern for _ in range(n))] += bins
    return dict(plan)


def _pairs(pattern: tuple) -> dict[int, tuple[int, int]]:
    """Two pieces of a bin for every sum that two of them have."""
    ones = sorted(set(pattern))
    out = {x + y: (y, x) for k, y in enumerate(ones) for x in ones[:k]}
    return out | {2 * x: (x, x) for x in ones if pattern.count(x) > 1}


def _bits(sums) -> int:
    out = 0
    for x in sums:
        out |= 1 << x
    return out


def _above(sums: int, slack: int) -> int:
    """The sums that exceed one of these by 1 to slack."""
    out, reach = sums << 1, 1
    while reach < slack:
        step = min(reach, slack - reach)
        out, reach = out | out << step, reach + step
    return out


class _Bin:
    """A pattern as sets of bits: what it can give, singly or in twos, and what it can take in exchange."""

    def __init__(self, pattern: tuple, size: int):
        self.fill = sum(pattern)
        self.slack = size - self.fill
        self.pairs = _pairs(pattern)
        self.give, self.give_two = _bits(set(pattern)), _bits(self.pairs)
        self.take, self.take_two = _above(self.give | self.give_two | 1, self.slack), _above(self.give, self.slack)

    def helped_by(self, b: _Bin) -> bool:
        """Some exchange with b, which is no fuller, makes this bin fuller."""
        return bool(self.take & b.give or self.take_two & b.give_two)


def _exchange(a: tuple, b: tuple, slack: int) -> tuple[tuple, tuple] | None:
    """The exchange that fills the fuller bin a most, taking from b; None if none does."""
    best, found = 0, None
    ones, pairs_a, pairs_b = set(a), _pairs(a), _pairs(b)
    one_for = {0: (), **pairs_a, **{x: (x,) for x in ones}}
    two_for = {x: (x,) for x in ones}
    for outs, intos in ((one_for, {y: (y,) for y in set(b)}), (two_for, pairs_b)):
        bits = _bits(outs)
        for y, into in intos.items():
            low = max(0, y - slack)
            rest = bits >> low
            out = low + (rest & -rest).bit_length() - 1  # the least that leaves room
            if rest and best < y - out:
                best, found = y - out, (outs[out], into)
    if not found:
        return None
    new_a, new_b = list(a), list(b)
    for x in found[0]:
        new_a.remove(x)
        new_b.append(x)
    for y in found[1]:
        new_b.remove(y)
        new_a.append(y)
    return tuple(sorted(new_a, reverse=True)), tuple(sorted(new_b, reverse=True))


def local_search(plan: dict[tuple[int, ...], int], size: int) -> dict[tuple[int, ...], int]:
    """Empty the least-filled bins into fuller ones, exchange by exchange.

    Each exchange raises the sum of squared fills, is applied to as many bins of
    the two patterns as both have (to half of the bins, within one pattern), and
    drops bins that it leaves empty. A pattern is settled when no exchange with
    any settled one or within itself helps; patterns that an exchange makes are
    tried with all settled ones. The search ends at the lower bound or when all
    are settled, so that no exchange helps; it changes how full the bins are and
    never which pieces there are.
    """
    plan = dict(plan)
    total = sum(sum(p) * n for p, n in plan.items())
    bound, bins = -(-total // size), sum(plan.values())
    settled: dict[tuple, _Bin] = {}
    open_ = [(sum(p), p) for p in plan if sum(p) < size] if bins > bound else []
    heapq.heapify(open_)
    while open_ and bins > bound:
        _, p = heapq.heappop(open_)
        if p not in plan or p in settled:
            continue
        own, pair = _Bin(p, size), None
        if plan[p] > 1 and own.helped_by(own):
            pair = (p, p)
        fuller = [(x.fill, a) for a, x in settled.items() if x.fill >= own.fill and x.helped_by(own)]
        if fuller:
            pair = (max(fuller)[1], p)
        if not pair:
            emptier = [(x.fill, b) for b, x in settled.items() if x.fill <= own.fill and own.helped_by(x)]
            if emptier:
                pair = (p, min(emptier)[1])
        if not pair:
            settled[p] = own
            continue
        a, b = pair
        n = plan[a] // 2 if a == b else min(plan[a], plan[b])
        new = _exchange(a, b, size - sum(a))
        for old in pair:
            plan[old] -= n
        for old in {a, b}:
            if not plan[old]:
                del plan[old]
                settled.pop(old, None)
        for made in new:
            if made:
                plan[made] = plan.get(made, 0) + n
                if plan[made] > n:
                    settled.pop(made, None)  # now a bin of it may help another
            else:
                bins -= n
        for made in {p, *new}:
            if made in plan and sum(made) < size:
                heapq.heappush(open_, (sum(made), made))
    return plan


def slots(plan: dict[tuple[int, ...], int]) -> dict[int, np.ndarray]:
    """Per length rows (first rank, pieces in a bin, first bin, first offset), ordered by rank."""
    table, ranks, bin_at = defaultdict(list), defaultdict(int), 0
    for pattern in sorted(plan):
        offset, n = 0, plan[pattern]
        for length in sorted(set(pattern), reverse=True):
            m = pattern.count(length)
            table[length].append((ranks[length], m, bin_at, offset))
            ranks[length] += m * n
            offset += m * length
        bin_at += n
    return {k: np.array(v, np.int64) for k, v in table.items()}


def _cut(path: str, size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("chunk", pa.int64()), ("k", pa.int64())])

    def run(batches):
        enc, chunk, seen = tokens.encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            names, texts = b.column(0).to_pylist(), common.text_list(b.column(1))
            for lo, hi in tokens.groups_of_chars(texts):
                ids, sizes = enc.encode(texts[lo:hi])
                raw, at, rows = ids.astype("<u4").tobytes(), 0, []
                for name, n in zip(names[lo:hi], sizes.tolist(), strict=True):
                    start, piece = 0, 0
                    while start < n:
                        length = size if (n - start) % size == 0 else (n - start) % size
                        seen[length] += 1
                        crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + start + length)])
                        rows.append((name, piece, start, length, crc, chunk, int(seen[length]) - 1))
                        start, piece = start + length, piece + 1
                    at += n
                yield common.batch(schema, *map(list, zip(*rows, strict=True)))

    return run


def pack(docs: DataFrame, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The first piece of a cut document takes what is left over by whole sequences.
    """
    path = tokenizer or tokens.default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = common.written(rows.mapInArrow(_cut(path, size), _PIECES))
    counts = pieces.groupBy("chunk", "length").agg((F.max("k") + 1).alias("n"))
    counts = common.written(counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    table = slots(local_search(best_fit(histogram, size), size))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                n = int(length[own[0]])
                t = table[n]
                s = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                local = rank[own] - s[:, 0]
                sequence[own], offset[own] = s[:, 2] + local // s[:, 1], s[:, 3] + local % s[:, 1] * n
            yield common.batch(schema, *(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), sequence, offset)

    ranked = pieces.join(counts.select("chunk", "length", "base"), ["chunk", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
