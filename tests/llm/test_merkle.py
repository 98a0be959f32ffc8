"""Merkle manifests against plain trees."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from placelens.llm import merkle


def _h(x):
    return sha256(x.encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def _siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        out.append(nodes[at ^ 1] if at ^ 1 < len(nodes) else "")
        at //= 2
    return out


@pytest.mark.parametrize("height", range(6))
def test_scheduled_paths(height):
    for n in range(1, (1 << height) + 1):
        leaves = [_h(str(k)) for k in range(n)]
        levels = _levels(leaves)
        while len(levels) <= height:  # as in the last block of a longer tree
            levels.append([_h(levels[-1][0])])
        assert merkle.block_root(leaves, height) == levels[-1][0]
        for at, path in enumerate(merkle.paths(leaves, height)):
            assert [x[1:] for x in path] == _siblings(levels, at)
            assert all(x == "" or (x[0] == "l") == bool(at >> h & 1) for h, x in enumerate(path))


def _leaf(r, n_chars):
    return _h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], n_chars, r[1])))


def _plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(r, r[4]), r))
    trees = {k: _levels([x[2] for x in (own.sort(key=lambda x: x[:3]) or own)]) + [own] for k, own in sorted(trees.items(), key=lambda x: (x[0] is not None, (x[0] or "").encode()))}
    top, out = _levels([t[-2][0] for t in trees.values()]), []
    for k, t in enumerate(trees.values()):
        for at, (_, _, leaf, r) in enumerate(t[-1]):
            path, i, j = _siblings(t[:-1], at) + _siblings(top, k), at, k
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            h = _leaf(r, r[4] + 1) if tampered else leaf
            for lvl, s in enumerate(path):
                low = lvl < len(t) - 2
                h, i, j = _h(s + h if (i if low else j) % 2 else h + s), i // 2 if low else i, j if low else j // 2
            out.append((r[0], leaf, t[-2][0], top[-1][0], _h("".join(path)), h, h == top[-1][0]))
    return out


def _rows(seed):
    rng, rows = random.Random(seed), []
    for k in range(230):
        rows.append((k, rng.choice(("", None, "été", "x" * rng.randint(1, 50))), rng.choice(("en", "en", "en", "en", "fr", None, "", "é", "Z")), rng.choice(("a", None)), rng.choice((None, 9, 99, -1, 10**12)), "clash"))
    return rows + [rows[0], rows[0], rows[5], (None, "a", "en", "b", 3, ""), (None, None, None, None, None, None), (None, "a", "en", "b", 3, ""), (-4, "t", "one", None, 1, "")]


_KIND = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


@pytest.mark.parametrize("height", [1, 2, 10])
def test_digest(spark, height):
    rows = _rows(height)
    got = merkle.digest(spark.createDataFrame(rows, _KIND).repartition(3), height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(_plain(rows), key=str)


def test_one_row_and_none(spark):
    row = (7, "t", "en", "s", 1, "")
    (got,) = merkle.digest(spark.createDataFrame([row], _KIND)).collect()
    assert tuple(got) == _plain([row])[0] and got.root == got.leaf
    assert merkle.digest(spark.createDataFrame([], _KIND)).collect() == []


def test_sql(spark):
    rows = _rows(9)
    db = duckdb.connect()
    db.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint, leaf varchar)")
    db.executemany("insert into documents values (?, ?, ?, ?, ?, ?)", rows)
    assert sorted(db.sql(merkle.ORACLE_SQL).fetchall(), key=str) == sorted(_plain(rows), key=str)
