"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact containment.

Items are cut into word shingles and partitioned by how many they have. If a
document holds a share t of an item's n shingles, it misses n - ceil(t * n) at
most, so of that many and one more least-hashed (MinHash) shingles it holds one
at least; these are the item's signature, and a partition's size is that of its
largest item. No hash of a partition's signatures is above the partition's
threshold, so a document's signature for that partition is its shingle hashes up
to there: the larger the items of a partition, the less of a long document is
looked up. A document and an item with a hash in common are a candidate: none is
missed. Candidates are verified by the exact share of the item's shingles.

Words are runs of lower-cased letters and digits, in other scripts too, so that
case and punctuation do not hide a passage. Items with fewer words than a
shingle are one shingle of all their words. Items stay distributed: tasks index
them in blocks of about max_block_chars characters and write the indexes into
the shared folder; tasks over documents load them one after the other, so that
one is in memory at a time, and search without a shuffle. The driver gets the
blocks' names.

Cases: a null or empty text holds nothing; items without words or id match
nothing; equal items are each reported; rows with equal ids are searched each on
its own; columns of docs with clashing names are left alone.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

_U = np.uint64
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_POWERS = np.ones(64, _U)
for _k in range(1, 64):
    _POWERS[_k] = _U(int(_POWERS[_k - 1]) * 0x9E3779B97F4A7C15 % 2**64)


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode("utf-8", "replace"))


def _word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in a lower-cased buffer."""
    raw = np.frombuffer(buffer, np.uint8)
    edge = np.diff(np.concatenate([[False], _IS_WORD[raw], [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, _U)
    owner = np.repeat(starts, np.diff(np.concatenate([starts, [len(raw)]])))
    place = np.arange(starts[0], len(raw)) - owner
    part = (raw[starts[0] :].astype(_U) + _U(1)) * _POWERS[place & 63]
    part ^= (place >> 6).astype(_U) * _U(0xD6E8FEB86659FD93)
    part[~_IS_WORD[raw[starts[0] :]]] = 0
    h = np.add.reduceat(part, starts - starts[0])
    h = (h ^ h >> _U(32)) * _U(0xC2B2AE3D27D4EB4F)
    return starts, ends, h ^ h >> _U(29)


def _shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(words) - n + 1), _U)
    for k in range(n):
        h = h * _U(0x9E3779B97F4A7C15) + words[k : k + len(h)]
        h ^= h >> _U(31)
    return h


class Items:
    """A block of items: their shingles, and by partition the signatures' hashes and threshold."""

    def __init__(self, items: list[tuple[int, str]], words: int, share: float):
        self.share, self.sets, self.size = share, {}, {}
        self.owners: dict[int, dict[bytes, list[int]]] = {}
        by_size: dict[tuple[int, int], list[int]] = {}
        for k, (item_id, text) in enumerate(items):
            own = words_of(text)
            if item_id is None or not own:
                continue
            n = min(words, len(own))
            shingles = {b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)}
            self.sets[k], self.size[k] = (item_id, n, shingles), len(shingles)
            by_size.setdefault((n, len(shingles).bit_length()), []).append(k)
            for s in shingles:
                self.owners.setdefault(n, {}).setdefault(s, []).append(k)
        hashes = {}
        for n, owners in self.owners.items():
            _, _, h = _word_hashes(b"\n".join(owners))
            hashes[n] = dict(zip(owners, _shingle_hashes(h, n)[::n].tolist(), strict=True))
        self.known = {n: np.array(sorted(h.values()), _U) for n, h in hashes.items()}
        self.partitions: dict[int, list[np.ndarray]] = {}  # signatures of a partition, ascending: the last is its threshold
        for (n, _), members in sorted(by_size.items()):
            need = max(self.size[k] - int(np.ceil(share * self.size[k] - 1e-9)) + 1 for k in members)
            signatures = {h for k in members for h in sorted(hashes[n][s] for s in self.sets[k][2])[:need]}
            self.partitions.setdefault(n, []).append(np.array(sorted(signatures), _U))

    def candidates(self, n: int, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles (hashes) that are in a signature of some partition."""
        hit = [np.zeros(0, np.int64)]
        for signatures in self.partitions[n]:
            low = np.flatnonzero(shingles <= signatures[-1])
            at = np.searchsorted(signatures, shingles[low])
            hit.append(low[signatures[at] == shingles[low]])
        return np.unique(np.concatenate(hit))

    def search(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """Per text the items that it holds and their containment."""
        raws = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        buffer = b"\n".join(raws)
        starts, ends, h = _word_hashes(buffer)
        bounds = np.cumsum([len(r) + 1 for r in raws])
        doc = np.searchsorted(bounds, starts, side="right")
        first = np.searchsorted(doc, np.arange(len(raws) + 1))
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        for n in self.partitions:
            shingles = _shingle_hashes(h, n)
            maybe = self.candidates(n, shingles)
            for d in np.unique(doc[maybe[doc[maybe] == doc[maybe + n - 1]]]):
                lo, hi = int(first[d]), int(first[d + 1]) - n + 1
                at = lo + np.flatnonzero(np.isin(shingles[lo:hi], self.known[n]))
                found: dict[int, int] = {}
                seen = set()
                for k in at.tolist():
                    s = b" ".join(buffer[a:b] for a, b in zip(starts[k : k + n].tolist(), ends[k : k + n].tolist(), strict=True))
                    if s not in seen:
                        seen.add(s)
                        for item in self.owners[n].get(s, ()):
                            found[item] = found.get(item, 0) + 1
                out[d] += [(self.sets[k][0], c / self.size[k]) for k, c in found.items() if c >= self.share * self.size[k] - 1e-9]
        return out


def index_items(benchmark: DataFrame, item_id: str, item_text: str, words: int, share: float, max_block_chars: int) -> list[str]:
    """Write the items' indexes into the shared folder; the names of the blocks, as many as there are max_block_chars in the items."""
    where = common.shared_dir(benchmark.sparkSession)
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    blocks = -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // max_block_chars) or 1
    schema = pa.schema([("file", pa.string())])

    def write(batches):
        part, held, size, seq = TaskContext.get().partitionId(), [], 0, 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((i, t))
                size += len(t)
                if size >= 2 * max_block_chars:
                    yield out(held, part, seq)
                    held, size, seq = [], 0, seq + 1
        if held:
            yield out(held, part, seq)

    def out(held, part, seq):
        file = f"{where}/{part:06d}-{seq:04d}.items"
        common.put_file(file, pickle.dumps(Items(held, words, share), pickle.HIGHEST_PROTOCOL))
        return common.batch(schema, [file])

    named = items.repartition(blocks, F.xxhash64("i", "t")).mapInArrow(write, "file string")
    return sorted(r.file for r in named.collect())


_LOADED: dict[str, Items] = {}


def _loaded(file: str) -> Items:
    """A block's index; a worker holds the last one."""
    if file not in _LOADED:
        _LOADED.clear()
        _LOADED[file] = pickle.loads(common.get_range(file, 0))
    return _LOADED[file]


def _search(docs: DataFrame, text_col: str, benchmark: DataFrame, into: str, words: int, share: float, max_block_chars: int, item_id: str, item_text: str, chars_at_once: int = 8_000_000) -> DataFrame:
    """docs with an array column of (item_id, containment)."""
    at, names = docs.columns.index(text_col), docs.columns
    item = pa.struct([("item_id", pa.int64()), ("containment", pa.float64())])
    files = index_items(benchmark, item_id, item_text, words, share, max_block_chars)

    def run(batches):
        for b in batches:
            texts = ["" if t is None else t for t in b.column(at).to_pylist()]
            for lo, hi in tokens.groups_of_chars(texts, chars_at_once):
                rows: list[list] = [[] for _ in range(hi - lo)]
                for file in files:
                    index = _loaded(file)
                    for a, z in tokens.groups_of_chars(texts[lo:hi]):
                        for k, hits in enumerate(index.search(texts[lo + a : lo + z]), a):
                            rows[k] += [{"item_id": i, "containment": c} for i, c in hits]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(rows, pa.list_(item))], names=[*names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{into}` array<struct<item_id:bigint,containment:double>>")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, share: float = 0.8, max_block_chars: int = 20_000_000) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, items (ascending ids, comma-joined), containment (the largest; 0 if none)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _search(own, "text", benchmark, "hits", words, share, max_block_chars, item_id, item_text)
    hits = F.array_join(F.transform(F.array_sort(F.col("hits.item_id")), lambda x: x.cast("string")), ",")
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), hits.alias("items"), F.coalesce(F.round(F.array_max("hits.containment"), 6), F.lit(0.0)).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, share: float = 0.8, max_block_chars: int = 20_000_000) -> DataFrame:
    """The rows of docs that hold no item, with docs's columns."""
    into = common.hidden(docs, "hits")["hits"]
    found = _search(docs, text_col, benchmark, into, words, share, max_block_chars, item_id, item_text)
    return found.where(F.size(F.col(into)) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)
), bw AS (
  SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw)
), size AS (
  SELECT item_id, count(*) AS n FROM bs GROUP BY 1
), hit AS (
  SELECT doc_id, bs.item_id, count(*) / n AS c FROM ds JOIN bs ON ds.s = bs.s JOIN size ON bs.item_id = size.item_id GROUP BY doc_id, bs.item_id, n HAVING count(*) >= 0.8 * n - 1e-9
), per AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, round(max(c), 6) AS containment FROM hit GROUP BY 1
)
SELECT d.doc_id, n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items, coalesce(containment, 0.0) AS containment
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id
"""
