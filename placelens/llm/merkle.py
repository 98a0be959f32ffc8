"""Merkle manifest of a dataset: leaves, authentication paths, subroots and a root.

The leaves of a tree are placed by range partitions and counts of them, then
dealt to aligned blocks of 2^height leaves. A block's root is made by a
treehash stack; block roots are the leaves of the next level, until each tree
has one node, its subroot. Subroots make the last tree in the same way. Then
paths go down: in each block treehash stacks, as many as it is high, advance
the authentication path from leaf to leaf (Szydlo's schedule: the stack with
the lowest tail works next), and the path of the block's root, shared by its
leaves, is appended. A task holds one block; no row meets more than its block.

Two consecutive nodes become the hash of both; a last node alone becomes its
own hash. Digests are lower-case hex SHA-256, concatenated as text.

Cases: a null field counts as "-", an empty one as "0:"; a null tree is a tree,
before all others; null order values come first and equal ones go by leaf, so
that repeated rows have places of their own (which of them has which is
arbitrary); an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def join(a: str | None, b: str | None) -> str | None:
    """The parent of two nodes; either may be missing, the left one only together with the right one."""
    return a and sha256((a + (b or "")).encode()).hexdigest()


class Treehash:
    """Computes one node of a given height over leaves from start on, a step (a leaf or a parent) at a time."""

    def __init__(self, leaves: list[str], start: int, height: int):
        self.leaves, self.next, self.height = leaves, start, height
        self.stack: list[tuple[int, str | None]] = []

    @property
    def done(self) -> bool:
        return len(self.stack) == 1 and self.stack[0][0] == self.height

    @property
    def tail(self) -> int:
        return self.stack[-1][0] if self.stack else self.height

    def step(self) -> None:
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            (h, right), (_, left) = s.pop(), s.pop()
            s.append((h + 1, join(left, right)))
        else:
            s.append((0, self.leaves[self.next] if self.next < len(self.leaves) else None))
            self.next += 1

    def node(self) -> str | None:
        while not self.done:
            self.step()
        return self.stack[0][1]


def height_of(n: int, most: int) -> int:
    """Levels between the nodes of a tree of n, or of a block of 2^most of them, and their root."""
    return min(most, (n - 1).bit_length())


def block_root(leaves: list[str], height: int) -> str:
    return Treehash(leaves, 0, height).node()


def paths(leaves: list[str], height: int):
    """The authentication path of each leaf in turn, from below: l or r with the left or right sibling, "" for none.

    At any time there are height treehash stacks, which hold a node per level at most.
    """
    path = [Treehash(leaves, 1 << h, h).node() for h in range(height)]
    stacks = [Treehash(leaves, 0, h) for h in range(height)]
    for s in stacks:
        s.node()
    for at in range(len(leaves)):
        yield [f"l{x}" if at >> h & 1 else f"r{x}" if x else "" for h, x in enumerate(path)]
        after, h = at + 1, 0
        while h < height and after & ((1 << h) - 1) == 0:
            path[h] = stacks[h].stack[0][1]
            stacks[h] = Treehash(leaves, (after + (1 << h)) ^ (1 << h), h)
            h += 1
        busy = [s for s in stacks if not s.done]
        for _ in range(2 * height - 1):
            if not busy:
                break
            low = min(busy, key=lambda s: s.tail)  # of equals the least high, as they are in order
            low.step()
            if low.done:
                busy.remove(low)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """tree, leaf, keep -> tree, pos (place in its tree), n (leaves of the tree), leaf, keep. order: fields of keep."""
    keys = [F.col("tree").asc_nulls_first(), *(F.col(f"keep.{c}").asc_nulls_first() for c in order), F.col("leaf"), F.col("mix")]
    rows = common.written(rows.withColumn("mix", F.xxhash64(F.monotonically_increasing_id())))  # so that equal rows can be dealt to many tasks
    dealt = common.written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("mix"))
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    w = Window.partitionBy("tree")
    counts = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))  # a row per tree and part at most
    counts = common.written(counts.withColumn("before", F.sum("here").over(w.orderBy("part")) - F.col("here")).withColumn("n", F.sum("here").over(w)))
    c = counts.select(F.col("tree").alias("c_tree"), F.col("part").alias("c_part"), "first", "before", "n")
    pos = F.col("at") - F.col("first") + F.col("before")
    return dealt.join(c, F.col("tree").eqNullSafe(F.col("c_tree")) & (F.col("part") == F.col("c_part"))).select("tree", pos.alias("pos"), "n", "leaf", "keep")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """One row for each aligned block: tree, block, n (nodes of the tree at this level), items in order."""
    items = F.sort_array(F.collect_list(F.struct("pos", "leaf", "keep")))
    return common.written(nodes.groupBy("tree", F.shiftright("pos", height).alias("block")).agg(F.max("n").alias("n"), items.alias("items")))


def _roots(blocks: DataFrame, height: int) -> DataFrame:
    """The nodes of the next level."""
    kind = blocks.schema["tree"].dataType.simpleString()

    def run(batches):
        for b in batches:
            roots = [block_root(x, height_of(n, height)) for x, n in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
            n = [(m + (1 << height) - 1) >> height for m in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(roots, pa.string())], ["tree", "pos", "n", "leaf"])

    return blocks.select("tree", "block", "n", "items.leaf").mapInArrow(run, f"tree {kind}, pos long, n long, leaf string")


def _climb(placed: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each level, and one node for each tree."""
    levels = [_blocks(placed, height)]
    while True:
        nodes = common.written(_roots(levels[-1], height))
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return levels, nodes
        levels.append(_blocks(nodes.withColumn("keep", F.lit(None).cast("struct<x:int>")), height))


def _descend(levels: list[DataFrame], upper: DataFrame, height: int) -> DataFrame:
    """upper: tree, pos, path, subroot, root of the nodes over the last level. The same of the leaves, with leaf and keep."""
    for blocks in reversed(levels):
        u = upper.select(F.col("tree").alias("u_tree"), F.col("pos").alias("u_pos"), F.col("path").alias("above"), "subroot", "root")
        joined = blocks.join(u, F.col("tree").eqNullSafe(F.col("u_tree")) & (F.col("block") == F.col("u_pos"))).select("tree", "n", "items", "above", "subroot", "root", F.col("items.leaf").alias("leaves"))

        def run(batches):
            for b in batches:
                for k in range(b.num_rows):
                    row = b.slice(k, 1)
                    n, above, leaves = (row.column(i)[0].as_py() for i in (1, 3, 6))
                    own = [p + above for p in paths(leaves, height_of(n, height))]
                    columns = [row.column(i) for i in (0, 2, 4, 5)] + [pa.array([own], pa.list_(pa.list_(pa.string())))]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "items", "subroot", "root", "paths"])

        kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
        made = joined.mapInArrow(run, f"tree {kinds['tree']}, items {kinds['items']}, subroot string, root string, paths array<array<string>>")
        each = made.select("tree", "subroot", "root", F.explode(F.arrays_zip("items", "paths")).alias("x"))
        upper = each.select("tree", F.col("x.items.pos").alias("pos"), F.col("x.items.leaf").alias("leaf"), F.col("x.items.keep").alias("keep"), F.col("x.paths").alias("path"), "subroot", "root")
    return upper


def authenticate(rows: DataFrame, tree: str, order: list[str], leaf: str = "leaf", height: int = 10) -> DataFrame:
    """The rows with position (in their tree), path, subroot and root.

    path has, from the leaf to the root, "l" or "r" and the sibling on that side, or "" where a node is alone.
    A tree's leaves ascend by order; trees ascend by their value.
    """
    placed = _placed(rows.select(F.col(tree).alias("tree"), F.col(leaf).alias("leaf"), F.struct(*rows.columns).alias("keep")), order)
    levels, subroots = _climb(placed, height)
    one = F.lit(0).alias("tree")
    top_levels, top = _climb(_placed(subroots.select(one, "leaf", F.struct("tree").alias("keep")), ["tree"]), height)
    no_path = F.array().cast("array<string>").alias("path")
    top = _descend(top_levels, top.select("tree", "pos", no_path, F.lit(None).cast("string").alias("subroot"), F.col("leaf").alias("root")), height)
    upper = top.select(F.col("keep.tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("leaf").alias("subroot"), "root")
    return _descend(levels, upper, height).select("keep.*", F.col("pos").alias("position"), "path", "subroot", "root")


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields, each "-" if null, else its UTF-8 byte count, ":" and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def fold(claimed: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    side, sibling = lambda x: F.substring(x, 1, 1), lambda x: F.substr(x, F.lit(2))
    return F.aggregate(path, claimed, lambda a, x: F.sha2(F.when(side(x) == "l", F.concat(sibling(x), a)).when(side(x) == "r", F.concat(a, sibling(x))).otherwise(a), 256))


def siblings(path: Column) -> Column:
    """The siblings of a path, concatenated."""
    return F.array_join(F.transform(path, lambda x: F.substr(x, F.lit(2))), "")


def digest(docs: DataFrame, height: int = 10) -> DataFrame:
    """Each document's leaf and proof, and what its proof says of the row after tampering.

    Tampering adds 1 to n_chars where 7 divides the unsigned crc32 of the decimal doc_id; a null stays.
    """
    c = F.col
    fields = lambda n_chars: leaf(c("doc_id"), c("source"), c("lang"), n_chars, c("text"))
    tampered = (F.crc32(c("doc_id").cast("string").cast("binary")) % 7 == 0) & c("n_chars").isNotNull()
    rows = docs.select("doc_id", "lang", fields(c("n_chars")).alias("leaf"), F.when(tampered, fields(c("n_chars").cast("long") + 1)).alias("other"))
    out = authenticate(rows, "lang", ["doc_id"], height=height)
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(c("path")), 256).alias("proof_sha256"), fold(F.coalesce("other", "leaf"), c("path")).alias("folded_root"))
    return out.withColumn("verified", c("folded_root") == c("root"))


ORACLE_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))
), marked AS (
  SELECT doc_id, source, lang, n_chars, text,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc_table
), sized AS (
  SELECT doc_id, lang,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS n,
         CASE WHEN tampered AND doc_id IS NOT NULL AND n_chars IS NOT NULL THEN strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR) END AS m,
         coalesce(strlen(text) || ':' || text, '-') AS z
  FROM marked
), leaves AS (
  SELECT doc_id, lang, sha256(a || n || z) AS leaf, sha256(a || coalesce(m, n) || z) AS claimed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(a || n || z)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM sized
), low AS (
  SELECT lang, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lang, lvl, n, i // 2
), subs AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM subs
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, n, i // 2
), steps AS (
  SELECT l.lang, l.i AS node, l.lvl, s.h, l.i % 2 = 1 AS on_left FROM low l LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = l.lvl AND s.i = xor(l.i, 1) WHERE l.n > 1
), top_steps AS (
  SELECT l.i AS node, l.lvl, s.h, l.i % 2 = 1 AS on_left FROM high l LEFT JOIN high s ON s.lvl = l.lvl AND s.i = xor(l.i, 1) WHERE l.n > 1
), walked AS (
  SELECT doc_id, lang, leaf, i, i AS node, 0 AS lvl, claimed AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.i, w.node // 2, w.lvl + 1, sha256(CASE WHEN s.h IS NULL THEN w.h WHEN s.on_left THEN s.h || w.h ELSE w.h || s.h END), w.proof || coalesce(s.h, '')
  FROM walked w JOIN steps s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl AND s.node = w.node
), below AS (
  SELECT doc_id, lang, leaf, i, h, proof FROM walked QUALIFY row_number() OVER (PARTITION BY lang, i ORDER BY lvl DESC) = 1
), climbed AS (
  SELECT doc_id, b.lang, leaf, b.i AS place, subroot, s.i AS node, 0 AS lvl, h, proof FROM below b JOIN subs s ON s.lang IS NOT DISTINCT FROM b.lang
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf, c.place, c.subroot, c.node // 2, c.lvl + 1, sha256(CASE WHEN s.h IS NULL THEN c.h WHEN s.on_left THEN s.h || c.h ELSE c.h || s.h END), c.proof || coalesce(s.h, '')
  FROM climbed c JOIN top_steps s ON s.lvl = c.lvl AND s.node = c.node
), done AS (
  SELECT * FROM climbed QUALIFY row_number() OVER (PARTITION BY lang, place ORDER BY lvl DESC) = 1
)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, d.h AS folded_root, d.h = r.h AS verified FROM done d, (SELECT h FROM high WHERE n = 1) r
"""
