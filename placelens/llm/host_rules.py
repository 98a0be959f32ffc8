"""Quality rules with host-level verdicts.

Rules of a document: short, repetitive (these two are its base and always
reject), symbols, duplicate lines, odd word lengths. Failures of each rule are
summed by host; a beta prior is fitted to the hosts' rates by moments, and a
host's rate is shrunk towards it: (failures + a) / (documents + a + b). A host
is distrusted if in any rule its shrunk rate is over host_limit or lies more
than `spread` standard deviations of the prior above the prior's mean. The
verdict is joined back: a document may fail `tolerance` of the rules beyond the base on a
trusted host and none on a distrusted one. A document that fails no rule is
kept wherever it is from.

Cases: a null text has no words, so it fails the base; a null host is a host of
its own; empty tables give empty results; rows with equal ids are judged each
on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
RULES = ("short", "repetitive", "symbols", "lines", "lengths")
_MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are in the text twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) > 2_000_000:  # three would not fit into 63 bits
        ids = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        keys = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    else:
        keys = (ids[:-2] * len(seen) + ids[1:-1]) * len(seen) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(len(words), bool)
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    for k in range(3):
        hit[k : k + len(keys)] |= again
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    white = sum(text.count(chr(c)) for c in common.WHITE)
    return len(words), len(text) - white, sum(text.count(c) for c in SYMBOLS), len(lines), len(lines) - len(set(lines)), _repeat_words(words)


def measured(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """docs with a struct column of measures."""
    names = [f.split()[0] for f in _MEASURES.split(", ")]
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            rows = [measure(t) for t in b.column(at).to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(columns, names)], names=[*b.schema.names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{into}` struct<{', '.join(x.replace(' ', ':') for x in _MEASURES.split(', '))}>")


def failures(m: str) -> dict[str, str]:
    """A SQL condition for each rule over the struct column m."""
    return {
        "short": f"{m}.n_words < 50",
        "repetitive": f"100 * {m}.n_repeat_words > 50 * {m}.n_words",
        "symbols": f"10 * {m}.n_symbols > {m}.n_words",
        "lines": f"10 * {m}.n_dup_lines > 3 * {m}.n_lines",
        "lengths": f"{m}.word_chars < 2 * {m}.n_words or {m}.word_chars > 12 * {m}.n_words",
    }


def host_verdicts(measures: DataFrame, host_limit: float = 0.5, spread: float = 1.0) -> DataFrame:
    """(host, trusted, and the shrunk rate of each rule) from measures(host, m)."""
    fails = failures("m")
    hosts = measures.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(F.expr(fails[r])).alias(r) for r in RULES))
    hosts = common.written(hosts)
    prior = hosts.agg(*(f(F.col(r) / F.col("n")).alias(f"{k}_{r}") for r in RULES for k, f in (("mean", F.avg), ("var", F.var_pop)))).first()
    rates, trusted = {}, F.lit(True)
    for r in RULES:
        mean, var = prior[f"mean_{r}"] or 0.0, prior[f"var_{r}"] or 0.0
        strength = 1e6 if var <= 0 else min(1e6, max(1e-6, mean * (1 - mean) / var - 1))
        rates[r] = (F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        trusted &= rates[r] <= min(host_limit, mean + spread * (mean * (1 - mean) / (strength + 1)) ** 0.5) + 1e-9
    return hosts.select("host", *(x.alias(f"rate_{r}") for r, x in rates.items()), trusted.alias("trusted"))


def _kept(m: str, trusted: str, tolerance: int) -> tuple[Column, Column, Column]:
    """Base failure, failures beyond it, and the verdict, over the struct column m and the column trusted."""
    fails = failures(f"`{m}`")
    base = F.expr(f"({fails['short']}) or ({fails['repetitive']})")
    soft = sum((F.expr(fails[r]).cast("int") for r in RULES[2:]), F.lit(0))
    return base, soft, ~base & (soft <= F.when(F.col(trusted), tolerance).otherwise(0))


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", tolerance: int = 1, max_broadcast_hosts: int = 100_000, **limits) -> tuple[DataFrame, str, str]:
    """docs with two helper columns, whose names are returned: the measures (struct) and kept (boolean).

    Texts are measured once: rows are written with their measures, from which
    the hosts' sums and then the verdicts are read.
    """
    names = common.hidden(docs, "measures", "kept", "host", "trusted")
    m, host = names["measures"], names["host"]
    rows = common.written(measured(docs, text_col, m))
    verdicts = host_verdicts(rows.select(F.col(host_col).alias("host"), F.col(m).alias("m")), **limits)
    verdicts = common.written(verdicts.select(F.col("host").alias(host), F.col("trusted").alias(names["trusted"])))
    if verdicts.limit(max_broadcast_hosts + 1).count() <= max_broadcast_hosts:
        verdicts = F.broadcast(verdicts)
    joined = rows.join(verdicts, rows[host_col].eqNullSafe(F.col(host)), "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), m, _kept(m, names["trusted"], tolerance)[2].alias(names["kept"])), m, names["kept"]


def passing(docs: DataFrame, host_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are kept, with docs's columns."""
    rows, _, kept = judge(docs, host_col, text_col, **options)
    return rows.where(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", tolerance: int = 1, **limits) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, trusted, n_soft_failed."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    small = common.written(measured(own, "text", "m").select("doc_id", "host", "m"))
    verdicts = host_verdicts(small.select("host", "m"), **limits).select(F.col("host").alias("h"), "trusted")
    rows = small.join(verdicts, small.host.eqNullSafe(F.col("h")), "left")
    measures = [F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    base, soft, kept = _kept("m", "trusted", tolerance)
    return rows.select("doc_id", *measures, base.alias("base_failed"), kept.alias("kept"), "trusted", soft.alias("n_soft_failed"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1
), m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id
), f AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > n_words AS f3,
         10 * n_dup_lines > 3 * n_lines AS f4, word_chars < 2 * n_words OR word_chars > 12 * n_words AS f5 FROM m
), h AS (
  SELECT source, count(*) AS n, count_if(f1) AS c1, count_if(f2) AS c2, count_if(f3) AS c3, count_if(f4) AS c4, count_if(f5) AS c5 FROM f GROUP BY 1
), r AS (
  SELECT source, n, unnest([c1, c2, c3, c4, c5]) AS c, unnest([1, 2, 3, 4, 5]) AS k FROM h
), p AS (
  SELECT k, avg(c / n) AS mean, var_pop(c / n) AS var FROM r GROUP BY 1
), s AS (
  SELECT k, mean, CASE WHEN var <= 0 THEN 1e6 ELSE least(1e6, greatest(1e-6, mean * (1 - mean) / var - 1)) END AS strength FROM p
), v AS (
  SELECT source, bool_and((c + mean * strength) / (n + strength) <= least(0.5, mean + sqrt(mean * (1 - mean) / (strength + 1))) + 1e-9) AS trusted FROM r JOIN s ON r.k = s.k GROUP BY 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND CAST(f3 AS INT) + CAST(f4 AS INT) + CAST(f5 AS INT) <= CASE WHEN trusted THEN 1 ELSE 0 END AS kept,
       trusted, CAST(f3 AS INT) + CAST(f4 AS INT) + CAST(f5 AS INT) AS n_soft_failed
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
