"""Near-duplicates by SimHash with a byte-position inverted index and a count filter.

Two 64-bit fingerprints that differ in at most four bits agree in at least four
of their eight bytes: that is the guaranteed minimum of shared positional bytes.
The index lists fingerprints under groups of (position, byte) keys. Lists of
single keys would hold 1/256 of all fingerprints each, and tallying them would
emit all pairs of such lists; so a list's name is three keys together, and the
groups of positions are a covering: any four of the eight positions include one
of the twenty groups, hence no pair with four shared bytes is missed. For each
pair that meets in a list the shared positional bytes are tallied, pairs with
fewer than the minimum are dropped, and the rest is verified by its bits. With
over wide_index distinct fingerprints lists are named by four keys (all seventy
groups), so that lists stay short; the links are the same.

Equal fingerprints count once. Within a list only links to the least member of a
local component are kept, never all pairs. A list longer than max_list is left
to an exact way that emits no pairs: each member is put under all points within
half the distance, and links to the least member at the same point.

Cases: a null or empty text, or one without words, has fingerprint zero and
links like any other; fewer words than a shingle give one shingle; a null id
gets a fingerprint and a null component and takes no part in the search; equal
ids count as one row each; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

_U = np.uint64


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned; a bit is set if it is in over half of the shingles' XXH64 (seed 42)."""
    import xxhash

    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, 42)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], _U)
    bits = np.add.reduce(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            yield common.batch(schema, b.column(0), np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], _U).view(np.int64))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


def _groups(shared: int, wide: bool) -> list[tuple[int, ...]]:
    """Groups of byte positions such that any `shared` of the eight include one.

    For four: positions are dealt into three classes, and a group is three of one
    class, or two of one and one of the next. Of four positions three are in one
    class, or two are and the next or the one before it holds another.
    """
    if shared != 4 or wide:
        return list(combinations(range(8), shared))
    return [c for c in combinations(range(8), 3) if (kinds := Counter(p % 3 for p in c)) and (len(kinds) == 1 or any(n == 2 and kinds[(k + 1) % 3] == 1 for k, n in kinds.items()))]


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Per difference x = a ^ b the tally of positional bytes that a and b share."""
    low = _U(0x7F7F7F7F7F7F7F7F)
    return 8 - np.bitwise_count(((x & low) + low | x) & ~low)


def _listed(groups: list[tuple[int, ...]]):
    """(list, fp, id) under every group of positions; the list's name holds the group and a hash of its bytes."""
    masks = np.array([sum(0xFF << (8 * p) for p in chosen) for chosen in groups], _U)
    schema = pa.schema([("list", pa.int64()), ("fp", pa.int64()), ("id", pa.int64())])

    def run(batches):
        for b in batches:
            fp, own = b.column("fp").to_numpy().view(_U), b.column("id").to_numpy()
            for c, mask in enumerate(masks):
                key = (fp & mask) * _U(0x9E3779B97F4A7C15) + _U((c + 1) * 0xD6E8FEB86659FD93 % 2**64)
                key = (key ^ key >> _U(32)) * _U(0xC2B2AE3D27D4EB4F)  # one to one for a group
                yield common.batch(schema, (key ^ key >> _U(29)).view(np.int64), fp.view(np.int64), own)

    return run


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each index's component under the edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _link(distance: int, max_list: int):
    """Links within lists, which come sorted: tally, count filter, verification. kind 0: u links to v; kind 1: a member (list u, fp v) of a long list."""
    schema = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("id", pa.int64())])

    def links(key, fp, own):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        several = np.repeat(size, size) > 1
        key, fp, own = key[several], fp[several], own[several]
        if not len(key):
            return None
        left = np.repeat(size[size > 1], size[size > 1]) - 1 - np.concatenate([np.arange(s) for s in size[size > 1]])
        a, b, at = [], [], np.arange(len(key))
        for lag in range(1, int(size.max())):
            at = at[left[at] >= lag]
            x = fp[at] ^ fp[at + lag]
            enough = shared_bytes(x) >= 8 - distance
            near = at[enough][np.bitwise_count(x[enough]) <= distance]
            a.append(near)
            b.append(near + lag)
        root = _local_roots(len(key), np.concatenate(a), np.concatenate(b))
        moved = np.flatnonzero(root != np.arange(len(key)))
        return own[moved], own[root[moved]]

    def run(batches):
        held, long_list = [np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)], None
        batches = iter(batches)
        while True:
            b = next(batches, None)
            if b is not None:
                held = [np.concatenate([h, x]) for h, x in zip(held, (b.column(0).to_numpy(), b.column(1).to_numpy().view(_U), b.column(2).to_numpy()), strict=True)]
            if long_list is not None:  # the rest of a list whose start has gone out
                n = int(np.searchsorted(held[0] != long_list, True))
                if n:
                    yield common.batch(schema, np.ones(n), held[0][:n], held[1][:n].view(np.int64), held[2][:n])
                    held = [h[n:] for h in held]
            if not len(held[0]):
                if b is None:
                    return
                continue
            last = int(np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))[-1]) if b is not None else len(held[0])
            ready, held = [h[:last] for h in held], [h[last:] for h in held]
            if len(ready[0]):
                long_list = None
                key = ready[0]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.concatenate([first, [len(key)]]))
                much = np.repeat(size, size) > max_list
                if much.any():
                    yield common.batch(schema, np.ones(int(much.sum())), key[much], ready[1][much].view(np.int64), ready[2][much])
                found = links(*(r[~much] for r in ready)) if not much.all() else None
                if found and len(found[0]):
                    yield common.batch(schema, np.zeros(len(found[0])), found[0], found[1], found[0])
            if len(held[0]) > max_list:
                long_list = held[0][0]
                yield common.batch(schema, np.ones(len(held[0])), held[0], held[1].view(np.int64), held[2])
                held = [h[:0] for h in held]

    return run


def _points(radius: int):
    """Every 64-bit point within radius bits of a member."""
    flips = np.array([sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(64), n)], _U)
    schema = pa.schema([("point", pa.int64()), ("id", pa.int64())])

    def run(batches):
        for b in batches:
            fp, own = b.column(0).to_numpy().view(_U), b.column(1).to_numpy()
            for lo in range(0, len(fp), 64):
                yield common.batch(schema, (fp[lo : lo + 64, None] ^ flips).reshape(-1).view(np.int64), np.repeat(own[lo : lo + 64], len(flips)))

    return run


def near_links(fps: DataFrame, distance: int = 4, max_list: int = 4096, wide_index: int = 1 << 27) -> DataFrame:
    """Links u-v between ids of fps(fp, id), fp distinct, that span each component under `distance` bits.

    distance is 2 to 6 and even, as a long list uses points half way.
    """
    shared = 8 - distance
    if not 2 <= shared <= 6 or distance % 2:
        raise ValueError("distance must be 2, 4 or 6")
    groups = _groups(shared, fps.count() > wide_index)
    listed = fps.select("fp", "id").mapInArrow(_listed(groups), "list long, fp long, id long").repartition("list").sortWithinPartitions("list", "fp")
    found = common.written(listed.mapInArrow(_link(distance, max_list), "kind int, u long, v long, id long"))
    links = found.where("kind = 0").select("u", "v").distinct()
    if found.where("kind = 1").take(1):
        many = found.where("kind = 1").select(F.col("v").alias("fp"), "id").distinct()
        points = many.mapInArrow(_points(distance // 2), "point long, id long")
        least = points.groupBy("point").agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1")
        links = links.union(points.join(least, "point").select(F.col("id").alias("u"), "v").where("u <> v").distinct())
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, **index) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least id reachable)."""
    fps = common.written(fingerprints(docs, id_col, text_col, words))
    distinct = common.written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = graph.components(near_links(distinct, distance, **index))
    classes = distinct.join(roots, distinct.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(classes, "fp", "left").select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with its columns, whose id is the least of its component; null ids stay.

    A document is its id: rows with equal ids stay or go together.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    name = common.hidden(docs, "gone")["gone"]
    gone = common.written(found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
