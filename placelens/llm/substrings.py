"""Exact removal of repeated byte strings with difference-cover samples, a suffix bucket at a time.

A string of `length` bytes is removed wherever it also starts earlier. With a
difference cover D modulo v, two equal strings at places i and j have a distance
d < v at which both i + d and j + d are sample places (their remainder is in D),
and the samples agree in the length - v + 1 bytes that follow. So suffixes at
sample places are ranked first, by that prefix; only strings that hold a sample
of a repeated rank can be repeated. Long ties are resolved by samples too: a
sample whose whole neighbourhood (every string that holds it) occurs earlier
settles all these strings at once. The strings that are left are sorted by their
bytes' hashes and all but the first of each class are removed.

Each of the three passes deals suffixes into buckets by hash, and a task sorts
one bucket at a time, about bucket_rows rows; equal suffixes of one group of
texts are sent once, so that a bucket gets a hot suffix once per group and not
once per document. Keys are 64 bits within a bucket that another hash chooses.

Cases: a null text counts as empty; a text shorter than length loses nothing; a
row with a null id neither loses bytes nor makes others lose any; rows equal in
id and text are one document and each gets its result; rows with an equal id and
other texts are ordered by their texts' hash; empty tables give empty results;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

_U = np.uint64
_SENT = "bucket int, ids binary, hs binary, counts binary, keys binary, pos binary"
_FLAGS = "doc_id long, h long, pos binary"
_SENT_SCHEMA = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("ids", "hs", "counts", "keys", "pos"))])
_FLAGS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("pos", pa.binary())])
_DEALT = "slice int, ids binary, hs binary, counts binary, pos binary"
_DEALT_SCHEMA = pa.schema([("slice", pa.int32()), *((k, pa.binary()) for k in ("ids", "hs", "counts", "pos"))])


def cover(length: int) -> tuple[int, np.ndarray]:
    """v and a difference cover modulo v: the powers of two modulo 73 or 7, perfect difference sets."""
    v = 73 if length >= 89 else 7
    if length < 15:
        raise ValueError("length must be 15 or more")
    return v, np.array(sorted({pow(2, k, v) for k in range(v)}), np.int64)


class Texts:
    """A group of texts as one buffer, ordered by (id, h)."""

    def __init__(self, ids: np.ndarray, hs: np.ndarray, raws: list[bytes]):
        order = np.lexsort((hs, ids))
        self.ids, self.hs, self.raws = ids[order], hs[order], [raws[k] for k in order]
        self.n = np.fromiter(map(len, self.raws), np.int64, len(raws))
        self.base = np.cumsum(self.n) - self.n
        buffer = b"".join(self.raws) + bytes(8)
        self.view = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))

    def hashes(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the size bytes at each place of the buffer."""
        a, b = np.full(len(at), 0x9E3779B97F4A7C15, _U), np.zeros(len(at), _U)
        for k, off in enumerate([*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]):
            x = self.view[at + off]
            a ^= x
            a *= _U(0xD6E8FEB86659FD93)
            a ^= a >> _U(32)
            b += (x ^ x >> _U(31)) * _U((0xC2B2AE3D27D4EB4F * (2 * k + 1) | 1) % 2**64)
            b ^= b << _U(21)
        a *= _U(0xC2B2AE3D27D4EB4F)
        b *= _U(0x9E3779B97F4A7C15)
        return a ^ a >> _U(29), b ^ b >> _U(32)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def sample_places(t: Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    v, d = cover(length)
    longest = int(t.n.max(initial=0))
    places = (np.arange(longest // v + 1)[:, None] * v + d).reshape(-1)
    counts = np.searchsorted(places, t.n - (length - v + 1), side="right")
    return np.repeat(np.arange(len(t.n)), counts), places[_spread(counts)]


def _union(rows: list, dtype="<u4") -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(x, dtype) for x in rows])).astype(np.int64) if rows else np.zeros(0, np.int64)


def _grouped(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of ascending doc."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], np.diff(np.concatenate([first, [len(doc)]]))


def _send(t: Texts, doc: np.ndarray, pos: np.ndarray, size: int, shift: int, buckets: int, every: bool, block: tuple[int, int] = (0, 1)) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets; what this group alone decides goes past them under a bucket below zero.

    block: (k, n) leaves out buckets whose number is not k modulo n.
    every: all members of a repeated class are flagged, else all but the first.
    """
    if not len(doc):
        return
    key, other = t.hashes(t.base[doc] + pos + shift, size)
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    later = np.zeros(len(key), bool)
    later[order] = same
    decided = later.copy()
    if every:
        decided[order[np.flatnonzero(same) - 1]] = True
    rows = []
    if decided.any() and not block[0]:
        own, counts = _grouped(doc[decided])
        rows.append((-1 - int(other[0] % _U(buckets)), t.ids[own].tobytes(), t.hs[own].tobytes(), counts.astype("<u4").tobytes(), b"", pos[decided].astype("<u4").tobytes()))
    sent = np.flatnonzero(~later)
    bucket = (other[sent] % _U(buckets)).astype(np.int32)
    if block[1] > 1:
        own = bucket % block[1] == block[0]
        sent, bucket = sent[own], bucket[own]
    by = np.argsort(bucket, kind="stable")
    sent, bucket = sent[by], bucket[by]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part in np.split(np.arange(len(sent)), cuts) if len(sent) else []:
        rest = sent[part]
        own, counts = _grouped(doc[rest])
        rows.append((int(bucket[part[0]]), t.ids[own].tobytes(), t.hs[own].tobytes(), counts.astype("<u4").tobytes(), key[rest].tobytes() if not every else np.ascontiguousarray(key[rest].view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes(), pos[rest].astype("<u4").tobytes() if pos[rest].max() > 0xFFFF else pos[rest].astype("<u2").tobytes()))
    if rows:
        yield common.batch(_SENT_SCHEMA, *map(list, zip(*rows, strict=True)))


def _groups(batches, most: int = 3_000_000):
    """Texts and the other columns of a group of rows with ids."""
    for b in batches:
        ids, hs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        texts = common.text_list(b.column(2))
        for lo, hi in tokens.groups_of_chars(texts, most):
            yield ids[lo:hi].astype(np.int64), hs[lo:hi].astype(np.int64), [x.encode("utf-8", "replace") for x in texts[lo:hi]], b, lo


def _samples(length: int, buckets: int):
    v, _ = cover(length)

    def run(batches):
        for ids, hs, raws, _, _ in _groups(batches):
            t = Texts(ids, hs, raws)
            yield from _send(t, *sample_places(t, length), length - v + 1, 0, buckets, every=True)

    return run


def _flagged(t: Texts, ids, hs, b: pa.RecordBatch, lo: int, column: int) -> list[np.ndarray]:
    order = np.lexsort((hs, ids))
    rows = b.column(column)
    return [_union(rows[int(lo + k)].as_py() or []) for k in order]


def _neighbourhoods(length: int, buckets: int):
    v, _ = cover(length)

    def run(batches):
        for ids, hs, raws, b, lo in _groups(batches):
            t = Texts(ids, hs, raws)
            places = _flagged(t, ids, hs, b, lo, 3)
            places = [p[(p >= v - 1) & (p + length <= n)] for p, n in zip(places, t.n, strict=True)]
            doc = np.repeat(np.arange(len(places)), [len(p) for p in places])
            yield from _send(t, doc, np.concatenate(places), length + v - 1, 1 - v, buckets, every=False)

    return run


def _covered(starts: np.ndarray, ahead: int, behind: int, n: int) -> np.ndarray:
    """Which of n places lie within ahead before or behind after one of starts (both ends included)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.maximum(starts - ahead, 0), 1)
    np.add.at(steps, np.minimum(starts + behind + 1, n), -1)
    return np.cumsum(steps[:n]) > 0


def _strings(length: int, buckets: int, block: tuple[int, int]):
    v, _ = cover(length)

    def run(batches):
        for ids, hs, raws, b, lo in _groups(batches):
            t = Texts(ids, hs, raws)
            found = []
            for p, q, n in zip(_flagged(t, ids, hs, b, lo, 3), _flagged(t, ids, hs, b, lo, 4), t.n, strict=True):
                m = int(n) - length + 1
                p, q = p[p < m + v - 1], q[q < m + v - 1]
                found.append(np.flatnonzero(_covered(p, v - 1, 0, m + v)[:m] & ~_covered(q, v - 1, 0, m + v)[:m]) if m > 0 else np.zeros(0, np.int64))
            doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield from _send(t, doc, np.concatenate(found), length, 0, buckets, every=False, block=block)

    return run


def _decide(every: bool, slices: int):
    """Sort one bucket at a time and flag repeated keys, all or all but the first of each; flags go out packed by slices of the documents."""
    width = 5 if every else 8

    def bucket(rows):
        ids, hs, doc, key, pos = [], [], [], [], []
        for i, h, c, k, p in rows:
            c = np.frombuffer(c, "<u4")
            n = int(c.sum())
            at = sum(map(len, ids))
            ids.append(np.frombuffer(i, "<i8"))
            hs.append(np.frombuffer(h, "<i8"))
            doc.append((at + np.repeat(np.arange(len(c)), c)).astype(np.int32))
            raw = np.zeros((n, 8), np.uint8)
            raw[:, 8 - width :] = np.frombuffer(k, np.uint8).reshape(n, width)
            key.append(raw.view("<u8").reshape(-1))
            pos.append(np.frombuffer(p, "<u4" if len(p) == 4 * n else "<u2").astype(np.uint32))
        ids, hs, doc, key, pos = map(np.concatenate, (ids, hs, doc, key, pos))
        ordered = np.sort(key)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        if not len(again):
            return None
        at = np.searchsorted(again, key)
        at[at == len(again)] = 0
        members = np.flatnonzero(again[at] == key)
        if not every:
            doc_m, key_m, pos_m = doc[members], key[members], pos[members]
            order = np.lexsort((pos_m, hs[doc_m], ids[doc_m], key_m))
            members = members[order[np.concatenate([[False], key_m[order][1:] == key_m[order][:-1]])]]
        doc, pos = doc[members], pos[members]
        order = np.argsort(doc, kind="stable")
        own, counts = _grouped(doc[order])
        return ids[own], hs[own], counts, pos[order]

    def out(ids, hs, counts, pos):
        name = ((ids.view(_U) ^ hs.view(_U)) * _U(0x9E3779B97F4A7C15) >> _U(33)) % _U(slices)
        order = np.argsort(name, kind="stable")
        pos = pos[np.repeat((np.cumsum(counts) - counts)[order], counts[order]) + _spread(counts[order])]
        ids, hs, counts, name = ids[order], hs[order], counts[order], name[order]
        ends = np.concatenate([[0], np.cumsum(counts)])
        own, n = _grouped(name)
        cuts = np.concatenate([[0], np.cumsum(n)])
        rows = [(int(x), ids[a:b].tobytes(), hs[a:b].tobytes(), counts[a:b].astype("<u4").tobytes(), pos[ends[a] : ends[b]].astype("<u4").tobytes()) for x, a, b in zip(own, cuts, cuts[1:], strict=False)]
        return common.batch(_DEALT_SCHEMA, *map(list, zip(*rows, strict=True)))

    def run(batches):
        held, name, past, size = [], None, [], 0
        for b in batches:
            names = b.column(0).to_pylist()
            columns = [b.column(k) for k in range(1, 6)]
            for k, x in enumerate(names):
                row = [c[k].as_py() for c in columns]
                if x < 0:
                    past.append(_unpacked(row[0], row[1], row[2], row[4]))
                    size += len(past[-1][3])
                    if size > 2_000_000:
                        yield out(*map(np.concatenate, zip(*past, strict=True)))
                        past, size = [], 0
                    continue
                if x != name and held:
                    if found := bucket(held):
                        yield out(*found)
                    held = []
                name = x
                held.append(row)
        if past:
            yield out(*map(np.concatenate, zip(*past, strict=True)))
        if held and (found := bucket(held)):
            yield out(*found)

    return run


def _unpacked(ids: bytes, hs: bytes, counts: bytes, pos: bytes) -> tuple[np.ndarray, ...]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(hs, "<i8"), np.frombuffer(counts, "<u4").astype(np.int64), np.frombuffer(pos, "<u4")


def _by_document(batches):
    """A row for each document of a slice; slices come whole, one after the other."""

    def rows(held):
        ids, hs, counts, pos = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((hs, ids))
        pos = pos[np.repeat((np.cumsum(counts) - counts)[order], counts[order]) + _spread(counts[order])].tobytes()
        ids, hs = ids[order], hs[order]
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hs[1:] != hs[:-1])]))
        ends = np.concatenate([[0], np.cumsum(counts[order])])[np.concatenate([first, [len(ids)]])].tolist()
        return common.batch(_FLAGS_SCHEMA, ids[first], hs[first], [pos[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)])

    held, name = [], None
    for b in batches:
        for k in range(b.num_rows):
            x, *row = (c[k].as_py() for c in b.columns)
            if x != name and held:
                yield rows(held)
                held = []
            name = x
            held.append(_unpacked(*row))
    if held:
        yield rows(held)


def _pass(rows: DataFrame, send: Callable, buckets: int, every: bool) -> DataFrame:
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(send, _SENT).repartition("bucket").sortWithinPartitions("bucket")
    dealt = sent.mapInArrow(_decide(every, slices), _DEALT).repartition("slice").sortWithinPartitions("slice")
    out = common.written(dealt.mapInArrow(_by_document, _FLAGS))
    del sent, dealt
    common.release(rows.sparkSession)
    return out


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 3_000_000, blocks: int = 2) -> DataFrame:
    """The last pass, which has the most suffixes, takes its buckets in `blocks` parts, one after the other.

    Returns (doc_id, text, covers, strings): covers: samples whose neighbourhood occurs earlier; strings: places of later strings."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    v, d = cover(length)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total * len(d) // v // bucket_rows))
    known = rows.where("doc_id is not null")
    by_doc = lambda flags, name: flags.groupBy("doc_id", "h").agg(F.collect_list("pos").alias(name))
    ranks = _pass(known, _samples(length, buckets), buckets, every=True)
    flagged = by_doc(ranks, "ranks")
    settled = _pass(known.join(flagged, ["doc_id", "h"]), _neighbourhoods(length, buckets), buckets, every=False)
    covers = by_doc(settled, "covers")
    left = known.join(flagged.join(covers, ["doc_id", "h"], "left"), ["doc_id", "h"])
    later = [_pass(left, _strings(length, buckets, (k, blocks)), buckets, every=False) for k in range(blocks)]
    strings = by_doc(reduce(DataFrame.union, later), "strings")
    both = covers.join(strings, ["doc_id", "h"], "full")
    return rows.join(both, ["doc_id", "h"], "left").select("doc_id", "text", "covers", "strings")


def removed_mask(n: int, length: int, covers: np.ndarray, strings: np.ndarray) -> np.ndarray:
    v, _ = cover(length)
    return _covered(covers, v - 1, length - 1, n) | _covered(strings, 0, length - 1, n)


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text, covers, strings in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                raw = text.encode("utf-8", "replace")
                gone = removed_mask(len(raw), length, _union(covers or []), _union(strings or [])) if covers or strings else np.zeros(len(raw), bool)
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((doc_id, len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw))
            if rows:
                yield common.batch(schema, *map(list, zip(*rows, strict=True)))

    return repeated_spans(docs, length, id_col, text_col, **options).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 200 <= length(x) THEN md5(substr(x, 2 * i + 1, 200)) END AS w FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS i FROM t)
), f AS (
  SELECT doc_id, i, byte, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS later FROM b
), g AS (
  SELECT doc_id, i, byte, coalesce(max(CASE WHEN later THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 100, false) AS gone FROM f
), r AS (
  SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS first FROM g
), s AS (
  SELECT doc_id, count(*) AS n_bytes, count_if(gone) AS n_removed, count_if(first) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY 1
)
SELECT doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents LEFT JOIN s USING (doc_id)
"""
