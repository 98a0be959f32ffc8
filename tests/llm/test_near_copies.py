"""The pipeline's near-dedup stage against all pairs of exact shingle sets."""

import random

import corpus_pipeline
import pytest
from placelens.llm import near_copies
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, gone string"


def _set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _stay(rows):
    sets = [_set(t) for _, t, _ in rows]
    root = {i: i for i, _, _ in rows}
    for a in range(len(rows)):
        for b in range(a):
            x, y = root[rows[a][0]], root[rows[b][0]]
            if x != y and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return {k for k, r in root.items() if k == r}


def _made():
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 3000)}"
    texts = [None, "", " \n", "one", "One", "a b c d e", "a b c d e f"]
    shared = [word() for _ in range(60)]  # in many texts
    for _ in range(12):
        own = shared + [word() for _ in range(rng.randint(10, 300))]
        texts.append(" ".join(own))
        for edits in (1, 2, 3, 5, 8):
            new = list(own)
            for at in rng.sample(range(len(own)), edits):
                new[at] = word()
            texts.append(" ".join(new[: len(new) - rng.randint(0, 12)]))
    texts += [texts[20], texts[21].upper(), " ".join(shared)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, t, "x") for i, t in zip(order, texts, strict=True)]


@pytest.mark.parametrize("options", [{}, {"frequent": 3}, {"frequent": 3, "max_late": 20}, {"frequent": 2, "block_chars": 3000}])
def test_all_pairs(spark, options):
    rows = _made()
    df = spark.createDataFrame([*rows, (None, rows[30][1], "x")], SCHEMA)
    left = near_copies.distinct_documents(df, **options)
    assert left.columns == df.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(None) == 1 and len(ids) == len(set(ids))
    assert set(ids) - {None} == _stay(rows)
    assert near_copies.distinct_documents(df.limit(0)).count() == 0


def test_stage_finds_copies_of_far_fingerprints(spark):
    """Copies at 0.8 to 0.9, which differ in more than four bits of a SimHash."""
    from placelens.llm import simhash

    rng = random.Random(1)
    rows = []
    for k in range(20):
        own = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
        new = list(own)
        for at in (30, 90, 150, 210, 270):
            new[at] = "changed"
        rows += [(2 * k, " ".join(own), ""), (2 * k + 1, " ".join(new), "")]
    far = [(simhash.fingerprint(a[1]) ^ simhash.fingerprint(b[1])).bit_count() > 4 for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert any(far)
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r.doc_id for r in left.collect()} == set(range(0, 40, 2)) == _stay(rows)


def test_lists_over_many_batches():
    import numpy as np
    import pyarrow as pa
    from fractions import Fraction

    rng = np.random.default_rng(2)
    s = np.sort(rng.integers(0, 8, 200)).astype(np.int64)
    n = rng.integers(5, 9, 200).astype(np.int32)
    at = np.lexsort((n, s))
    table = pa.table({"s": s[at], "key": np.arange(200), "n": n[at], "i": np.zeros(200, np.int32)})
    meet = near_copies._meet(Fraction(4, 5), 100)
    pairs = lambda size: sorted((a, b) for x in meet(table.to_batches(size)) for _, a, b in zip(*(c.to_pylist() for c in x.columns)))
    want = sorted((a, b) for b in range(200) for a in range(b) if s[at][a] == s[at][b] and 9 * min(n[at][a], n[at][b]) >= 4 * (n[at][a] + n[at][b]) and 5 * n[at][a] >= 4 * n[at][b])
    assert pairs(200) == pairs(7) == pairs(1) == want
    long = near_copies._meet(Fraction(4, 5), 1)
    rows = [r for x in long(table.to_batches(7)) for r in zip(*(c.to_pylist() for c in x.columns))]
    least = {int(x): int(np.arange(200)[s[at] == x].min()) for x in np.unique(s)}
    assert sorted(rows) == sorted((1, k, least[int(s[at][k])]) for k in range(200))


def test_large_group_emits_no_pairs(spark, monkeypatch):
    """Copies of one base, of which some lie under the share: the components are those of all pairs, and links no more than texts."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = []
    for k in range(150):
        new = list(base)
        for at in rng.sample(range(120), rng.randint(1, 5)):
            new[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(new), ""))
    df = spark.createDataFrame(rows, SCHEMA)
    left = near_copies.distinct_documents(df, frequent=8, block_chars=20_000)
    assert {r.doc_id for r in left.collect()} == _stay(rows)
    keyed = df.select("doc_id", "text", F.xxhash64("text").alias("key"))
    assert near_copies.links(keyed, keyed.select("key", F.col("doc_id").alias("id")), frequent=8).count() < 400


def test_fingerprints_link_first_and_prefixes_complete(spark, monkeypatch):
    rows = _made()
    df = spark.createDataFrame(rows, SCHEMA)
    keyed = df.selectExpr("doc_id", "CASE WHEN trim(text) <> '' THEN text ELSE '' END AS text").withColumn("key", F.xxhash64("text"))
    key, sets = {r.doc_id: r.key for r in keyed.collect()}, {i: _set(t) for i, t, _ in rows}
    close = {(r.a, r.b) for r in near_copies.fingerprint_links(keyed, 5).collect()}
    alike = {tuple(sorted((key[a], key[b]))) for a in sets for b in sets if sets[a] and sets[a] == sets[b] and key[a] != key[b]}
    assert alike and alike <= close
    seen, decide = [], near_copies._decide
    monkeypatch.setattr(near_copies, "_decide", lambda pairs, *rest: seen.append({(r.a, r.b) for r in pairs.collect()}) or decide(pairs, *rest))
    assert {r.doc_id for r in near_copies.distinct_documents(df).collect()} == _stay(rows)
    assert len(seen) == 2 and seen[0] == close and not seen[1] & alike and seen[1] - close
