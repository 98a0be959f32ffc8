"""Removal of repeated runs of lines by winnowing over line hashes.

The lines of a text that hold a word are hashed. Of each window of `window`
lines the least hash is selected (the rightmost of equals); neighbouring windows
mostly share it, and a selected line is listed once with all its windows. Texts
that share a run of that many lines select the same lines of it, so no run is
missed if only fingerprints that are listed more than once go on. There a match
is verified and extended both ways: around a selected line each window, as far
before and behind it as the window reaches, is compared by a digest of all its
lines. Of equal windows the first (by id, then place) stays, and the union of a
text's later windows, which is the whole of every repeated run, is deleted.

Runs of fewer lines count if they hold long_line words: one such line, or two
neighbours together and so on; their windows are selected and met alike.

Positions meet in sums by key, never in pairs.

Cases: a null text stays null and an empty one empty; lines without a word are
no part of a run and go with the line before them if it goes; a row with a null
id neither loses lines nor makes others lose any; rows equal in id and text are
one document and each gets its result; rows with an equal id and other texts are
ordered by their texts' hash; columns of docs stay, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_POSITIONS = "doc_id long, h long, fingerprint long, place int, windows array<struct<before:int,size:int,lines:binary>>"


def _held_lines(text: str) -> tuple[list[bytes], list[int]]:
    """All lines, and the indices of those with a word."""
    lines = text.encode("utf-8", "replace").split(b"\n")
    return lines, [k for k, x in enumerate(lines) if x.strip()]


def winnow(text: str, window: int, long_line: int, passages: bool = True) -> dict[int, tuple[int, list[tuple[int, int, bytes]]]]:
    """By selected line (counted over lines with a word): its hash, and its windows as (lines before it, lines, digest of the lines)."""
    import xxhash

    lines, held = _held_lines(text)
    digests = [xxhash.xxh3_128_digest(lines[k]) for k in held]
    heads = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
    starts = [(s, window) for s in range(len(held) - window + 1)]
    if len(text) >= 2 * long_line - 1:
        words = [0, *accumulate(len(lines[k].split()) if len(lines[k]) > 1 else 1 for k in held)]
        for size in range(1, window if passages else 2):
            starts += [(s, size) for s in range(len(held) - size + 1) if words[s + size] - words[s] >= long_line]
    out: dict[int, tuple[int, list]] = {}
    for s, size in starts:
        least = s
        for k in range(s + 1, s + size):
            if heads[k] <= heads[least]:
                least = k
        out.setdefault(least, (heads[least], []))[1].append((least - s, size, xxhash.xxh3_128_digest(b"".join(digests[s : s + size]))))
    return out


def _positions(window: int, long_line: int, passages: bool):
    part = pa.struct([("before", pa.int32()), ("size", pa.int32()), ("lines", pa.binary())])
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fingerprint", pa.int64()), ("place", pa.int32()), ("windows", pa.list_(part))])

    def run(batches):
        for b in batches:
            ids, hs, heads, places, cuts, own = [], [], [], [], [0], []
            for i, h, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for place, (head, windows) in winnow(t, window, long_line, passages).items():
                    ids.append(i)
                    hs.append(h)
                    heads.append(head)
                    places.append(place)
                    own += windows
                    cuts.append(len(own))
            if own:
                before, size, lines = map(list, zip(*own, strict=True))
                windows = pa.StructArray.from_arrays([pa.array(before, pa.int32()), pa.array(size, pa.int32()), pa.array(lines, pa.binary())], fields=list(part))
                yield common.batch(schema, ids, hs, heads, places, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), windows))

    return run


def delete_runs(text: str, later: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """The text without the lines of later windows; lines with a word, how many went, and in how many runs."""
    lines, held = _held_lines(text)
    gone = np.zeros(len(held), bool)
    for start, size in later:
        gone[start : start + size] = True
    runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    if not runs:
        return text, len(held), 0, 0
    drop, last, at = [False] * len(lines), False, 0
    for k in range(len(lines)):
        if at < len(held) and held[at] == k:
            last, at = bool(gone[at]), at + 1
        drop[k] = last
    return b"\n".join(x for x, d in zip(lines, drop, strict=True) if not d).decode("utf-8", "replace"), len(held), int(gone.sum()), runs


def _joined(docs: DataFrame, id_col: str, text_col: str, window: int, long_line: int, passages: bool) -> tuple[DataFrame, str, str]:
    """docs with a helper column of later windows (starts and sizes in turn), and that column's name."""
    names = common.hidden(docs, "h", "later", "id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    listed = common.written(rows.where("doc_id is not null and text is not null").mapInArrow(_positions(window, long_line, passages), _POSITIONS))
    # Sums are written, so that a join after them shuffles both sides for itself and a hot key's rows can be split.
    repeated = common.written(listed.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"))
    met = listed.join(repeated, "fingerprint", "left_semi").select("doc_id", "h", "fingerprint", "place", F.explode("windows").alias("w"))
    met = common.written(met.select("doc_id", "h", "fingerprint", "w.before", "w.size", "w.lines", (F.col("place") - F.col("w.before")).alias("start")))
    place, alike = F.struct("doc_id", "h", "start"), ["fingerprint", "before", "size", "lines"]
    first = common.written(met.groupBy(*alike).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last"))
    later = met.join(first, alike).where(place > F.col("first"))
    by_doc = later.groupBy("doc_id", "h").agg(F.flatten(F.collect_list(F.array("start", "size"))).alias(names["later"]))
    by_doc = by_doc.withColumnsRenamed({"doc_id": names["id"], "h": names["h"]})
    keyed = docs.join(by_doc, (docs[id_col].cast("long") == F.col(names["id"])) & (F.xxhash64(docs[text_col]) == F.col(names["h"])), "left")
    return keyed.select(*(docs[f"`{c}`"] for c in docs.columns), names["later"]), names["later"], text_col


def _pairs(flat: list[int] | None) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True)) if flat else []


def remove_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, long_line: int = 50, passages: bool = True) -> DataFrame:
    """docs, with its columns, whose texts have lost the later repeated runs."""
    rows, later, _ = _joined(docs, id_col, text_col, window, long_line, passages)
    at, extra, names = docs.columns.index(text_col), len(docs.columns), docs.columns

    def run(batches):
        for b in batches:
            texts = [t if t is None or not x else delete_runs(t, _pairs(x))[0] for t, x in zip(b.column(at).to_pylist(), b.column(extra).to_pylist(), strict=True)]
            columns = b.columns[:extra]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, docs.schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, long_line: int = 50, passages: bool = True) -> DataFrame:
    """Per document: doc_id, n_lines (with a word), n_removed, n_runs, kept_sha256 (of the text that stays; null as empty)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, _, _ = _joined(own, "doc_id", "text", window, long_line, passages)
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64()), ("kept", pa.string())])

    def run(batches):
        for b in batches:
            done = [delete_runs(t or "", _pairs(x)) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            if done:
                kept, n, gone, runs = zip(*done, strict=True)
                yield common.batch(schema, b.column(0), list(n), list(gone), list(runs), list(kept))

    return rows.mapInArrow(run, "doc_id long, n_lines long, n_removed long, n_runs long, kept string").select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i, part[i] AS line, regexp_matches(part[i], '[^\x20\x09-\x0D]') AS held
  FROM (SELECT doc_id, part, unnest(range(1, len(part) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS part FROM documents))
), n AS (
  SELECT *, CAST(count_if(held) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS p, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l
), h AS (
  SELECT doc_id, p, line, words, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(words, 1) OVER w AS words2 FROM n WHERE held WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), pos AS (
  SELECT doc_id, p, 3 AS size, line || chr(10) || l2 || chr(10) || l3 AS k FROM h WHERE l3 IS NOT NULL
  UNION ALL
  SELECT doc_id, p, 2, line || chr(10) || l2 FROM h WHERE words + words2 >= 50
  UNION ALL
  SELECT doc_id, p, 1, line FROM h WHERE words >= 50
), later AS (
  SELECT doc_id, p, size FROM (SELECT *, row_number() OVER (PARTITION BY size, k ORDER BY doc_id, p) AS r FROM pos) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS p FROM later
), flags AS (
  SELECT n.doc_id, i, line, held, gone.p IS NOT NULL AS gone FROM n LEFT JOIN gone ON n.doc_id = gone.doc_id AND n.p = gone.p
), held AS (
  SELECT doc_id, gone, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM flags WHERE held
), c AS (
  SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_removed, count_if(gone AND NOT before) AS n_runs FROM held GROUP BY 1
), t AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM flags GROUP BY 1
)
SELECT t.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, sha256(kept) AS kept_sha256
FROM t LEFT JOIN c ON t.doc_id = c.doc_id
"""
