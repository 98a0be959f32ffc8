"""Near copies by SimHash and the Jaccard similarity of word shingles, exact, completed by prefix filtering.

Op4's operator goes first: fingerprints of the shingles, the index of positional
bytes, its count filter and its bound on bits (simhash.py). Each link that it
gives is decided by the whole sets. Copies at the share differ in more bits than
any count of shared bytes is sure to find, so what fingerprints leave apart is
completed: pairs that already hang together are not decided again.

Under any one order of all shingles, two sets whose similarity reaches the share
have their first common shingle among the first n - ceil(share * n) + 1 of each.
Only these prefixes are listed, by shingle, and what follows the shingle in both
sets bounds how many they can share; pairs that stay are decided by the whole
sets. No pair is missed and no width or distance is guessed. The order is by
hash, with frequent shingles last: which ones count as frequent changes how
long lists are, never what is found.

A list of more than `frequent` texts emits no pairs: its members are one cluster,
with those of other such lists that share a text, and clusters are cut into
blocks of about block_chars characters. A task gets two blocks and tallies the
shingles that their texts share from an index of them, so that a large group of
near copies costs rows in proportion to its size times its blocks, and emits no
more links than it has texts.

Rows of equal text meet once: a task lists a text once, and equal entries of a
list count once. Texts move only where a pair is decided by them. Shingles are
compared by their XXH64.

Cases: texts without words, null or empty, are alike; fewer words than a shingle
give one shingle; a null id takes no part and stays; rows with equal ids are one
document; columns of docs stay, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, simhash

_U = np.uint64


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words, letters of ASCII lowered."""
    import xxhash

    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, _U)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line)], _U)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], _U))


def _prefix(n: int, share: Fraction) -> int:
    return n + (-n * share.numerator // share.denominator) + 1 if n else 0


def _early(words: int, share: Fraction):
    """Shingles by hash as far as a prefix and half of one more, for counting."""
    schema = pa.schema([("s", pa.int64())])

    def run(batches):
        for b in batches:
            own = [x[: _prefix(len(x), share) * 3 // 2] for x in (shingles(t, words) for t in b.column(0).to_pylist())]
            if own:
                yield common.batch(schema, np.concatenate(own).view(np.int64))

    return run


def _listed(words: int, share: Fraction, late: np.ndarray):
    """(s, key, n, i): the prefix of each text's set of n shingles with places i, shingles in late last."""
    schema = pa.schema([("s", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("i", pa.int32())])

    def run(batches):
        seen: set[int] = set()  # keys of this task
        for b in batches:
            held, size, place, names = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k in seen:
                    continue
                seen.add(k)
                names.append(k)
                x = shingles(t, words)
                p = _prefix(len(x), share)
                if len(late):
                    last = late[np.minimum(np.searchsorted(late, x), len(late) - 1)] == x
                    held.append(np.concatenate([x[~last], x[last]])[:p])
                else:
                    held.append(x[:p])
                size.append(len(x))
                place.append(np.arange(p, dtype=np.int32))
            if held:
                count = np.array([len(x) for x in held])
                yield common.batch(schema, np.concatenate(held).view(np.int64), np.repeat(np.array(names, np.int64), count), np.repeat(np.array(size, np.int32), count), np.concatenate(place))

    return run


def _meet(share: Fraction, frequent: int):
    """Pairs within lists that may reach the share (kind 0), and each member of a longer list with its least (kind 1); rows come sorted by list and size."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    up, down = share.numerator, share.denominator

    def pairs(s, key, n, i):
        once = np.concatenate([[True], (s[1:] != s[:-1]) | (key[1:] != key[:-1])])
        s, key, n, i = s[once], key[once], n[once], i[once]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.concatenate([first, [len(s)]]))
        many = size > frequent
        if many.any():
            least = np.repeat(np.minimum.reduceat(key, first), size)
            own = np.repeat(many, size)
            yield common.batch(schema, np.ones(int(own.sum()), np.int32), key[own], least[own])
            s, key, n, i = s[~own], key[~own], n[~own], i[~own]
            if not len(s):
                return
            size = size[~many]
            first = np.cumsum(size) - size
        left = np.repeat(first + size, size) - 1 - np.arange(len(s))
        at, lag = np.flatnonzero(left), 1
        while len(at):
            to = at + lag
            close = down * n[at] >= up * n[to]  # sizes grow: too large now is too large from here on
            at, to = at[close], to[close]
            may = (up + down) * np.minimum(n[at] - i[at], n[to] - i[to]) >= up * (n[at] + n[to])
            a, b = key[at[may]], key[to[may]]
            if len(a):
                yield common.batch(schema, np.zeros(len(a), np.int32), np.minimum(a, b), np.maximum(a, b))
            lag += 1
            at = at[left[at] >= lag]

    def run(batches):
        held = []
        for b in batches:
            held.append([b.column(k).to_numpy().astype(np.int64) for k in range(4)])
            s = held[-1][0]
            if not len(s) or s[0] == s[-1] and len(held) > 1 and held[-2][0][-1:] == s[:1]:
                continue  # all of it is of the list that is still open
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))[-1])
            if last:
                yield from pairs(*(x[:last] for x in rows))
            held = [[x[last:] for x in rows]]
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _decided(words: int, share: Fraction):
    """The pairs (a, b, text a, text b) that reach the share."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        name, own = None, None
        for batch in batches:
            a, b, texts, others = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for u, v, t, o in zip(a, b, texts, others, strict=True):
                if u != name:
                    name, own = u, shingles(t, words)
                other = shingles(o, words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both * share.denominator >= share.numerator * (len(own) + len(other) - both):
                    found.append((u, v))
            if found:
                yield common.batch(schema, *map(list, zip(*found, strict=True)))

    return run


def tallied(sets: list[np.ndarray], low: np.ndarray, high: np.ndarray, share: Fraction) -> tuple[list[int], list[int]]:
    """Links that span the components of texts of two blocks, low and high (places in sets), under the share."""
    sizes = np.array([len(x) for x in sets])
    own = np.concatenate([sets[k] for k in high]) if len(high) else np.zeros(0, _U)
    order = np.argsort(own, kind="stable")
    listed, owner = own[order], np.repeat(high, sizes[high])[order]
    root, a, b = list(range(len(sets))), [], []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in low.tolist():
        lo, hi = np.searchsorted(listed, sets[k]), np.searchsorted(listed, sets[k], side="right")
        n = hi - lo
        met = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        both = np.bincount(met, minlength=len(sets))
        near = np.flatnonzero((both > 0) & (both * share.denominator >= share.numerator * (sizes + sizes[k] - both)))
        for j in near.tolist():
            x, y = top(k), top(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(k)
                b.append(j)
    return a, b


def _tally(words: int, share: Fraction):
    """Links of each pair of blocks; rows (cluster, lo, hi, block, key, text) come whole and sorted by the first three."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(held):
        block, key, texts = zip(*held, strict=True)
        block, key = np.array(block), np.array(key, np.int64)
        a, b = tallied([shingles(t, words) for t in texts], np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max()), share)
        return common.batch(schema, key[a], key[b])

    def run(batches):
        held, name = [], None
        for batch in batches:
            *names, block, key, text = (batch.column(k).to_pylist() for k in range(6))
            for own, row in zip(zip(*names, strict=True), zip(block, key, text, strict=True), strict=True):
                if own != name and held:
                    yield linked(held)
                    held = []
                name = own
                held.append(row)
        if held:
            yield linked(held)

    return run


def fingerprint_links(rows: DataFrame, words: int) -> DataFrame:
    """Pairs a < b of keys of rows(text, key) that op4's index links, those with equal fingerprints included; not yet decided by their sets."""
    fps = common.written(simhash.fingerprints(rows.where("text <> ''"), "key", "text", words).distinct())
    distinct = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    equal = fps.join(distinct, "fp").where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    return common.written(simhash.near_links(distinct).union(equal).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())


def _decide(pairs: DataFrame, held: DataFrame, words: int, share: Fraction) -> DataFrame:
    """The pairs(a, b) whose texts, in held(key, text), reach the share."""
    both = pairs.join(held.toDF("a", "text_a"), "a").join(held.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return both.sortWithinPartitions("a").mapInArrow(_decided(words, share), "a long, b long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs(a, b) whose ends have not one root in roots(node, root)."""
    for end in "ab":
        pairs = pairs.join(roots.toDF(end, f"root_{end}"), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _cluster_links(held: DataFrame, edges: DataFrame, words: int, share: Fraction, block_chars: int) -> DataFrame:
    """Links within the clusters that edges(u, v) make of texts held(key, text)."""
    members = common.written(held.join(graph.components(edges), F.col("key") == F.col("node")).select(F.col("root").alias("cluster"), "key", "text"))
    sizes = members.groupBy("cluster").agg((F.floor(F.sum(F.length("text")) / block_chars) + 1).cast("int").alias("blocks"))
    dealt = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "text")
    return dealt.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(_tally(words, share), "a long, b long")


def links(rows: DataFrame, first: DataFrame, words: int = 5, share: Fraction = Fraction(4, 5), frequent: int = 64, max_late: int = 200_000, block_chars: int = 4_000_000) -> DataFrame:
    """Pairs a-b of keys of rows(doc_id, text, key) whose similarity is share or more, as many as span their components.

    Texts without words link to none.

    key is the text's; first(key, id) names one row of each key.
    """
    close = fingerprint_links(rows, words)
    common.release(rows.sparkSession)  # the index's shuffle files
    counts = rows.select("text").mapInArrow(_early(words, share), "s long").groupBy("s").count().where(F.col("count") > frequent)
    late = counts.orderBy(F.desc("count"), "s").limit(max_late).select("s").toPandas()["s"].to_numpy(np.int64).view(_U)
    listed = rows.select("key", "text").mapInArrow(_listed(words, share, np.sort(late)), "s long, key long, n int, i int")
    found = listed.repartition("s").sortWithinPartitions("s", "n", "key").mapInArrow(_meet(share, frequent), "kind int, a long, b long")
    found = common.written(found.where("a <> b or kind = 1").distinct())
    met, edges = found.where("kind = 0").select("a", "b"), found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
    named = found.select("a", "b").union(close).select(F.explode(F.array("a", "b")).alias("key")).distinct().join(first, "key").select(F.col("id").alias("doc_id"), "key")
    held = common.written(rows.join(named, ["doc_id", "key"]).dropDuplicates(["key"]).select("key", "text"))
    linked = common.written(_decide(close, held, words, share))
    linked = linked.union(_decide(_apart(met, graph.components(linked.toDF("u", "v"))), held, words, share))
    if edges.take(1):
        linked = linked.union(_cluster_links(held, edges, words, share, block_chars))
    return common.written(linked)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with its columns, whose id is the least of its component under links(); null ids stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise("")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    keys = common.written(rows.select("doc_id", "key").distinct())
    first = common.written(keys.groupBy("key").agg(F.min("doc_id").alias("id")))
    copies = keys.join(first, "key").where("doc_id <> id").select("doc_id", "id")
    near = links(rows, first, **options)
    near = near.join(first.toDF("a", "u"), "a").join(first.toDF("b", "v"), "b").select("u", "v")
    roots = graph.components(near.union(copies.select("doc_id", "id")))
    name = common.hidden(docs, "gone")["gone"]
    gone = common.written(roots.where("root <> node").select(F.col("node").alias(name)).distinct())
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
