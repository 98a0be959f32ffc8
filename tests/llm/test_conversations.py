"""Repair of conversations against a plain search by cost and letters."""

import heapq
import random
import re
import zlib
from hashlib import sha256

import duckdb
import pytest
from placelens.llm import conversations

_KIND = "conv_id long, turn long, role string, text string, audit string"


def _damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (1 + (how == 3))
    return out


def _faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


_NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def _best(rows, faults):
    """By (cost, audit) the first way that ends well."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, given = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, given
        if (at, state) in done:
            continue
        done.add((at, state))
        made = [(x, f) for x, f in (("u", "user"), ("a", "assistant")) if (state, x) in _NEXT]
        for x, role in made:
            heapq.heappush(heap, (cost + 3, audit + "I", at, x, (*given, role + ":")))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, given))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 if faults[at] == "truncated" else 0
                if (state, role[:1]) in _NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], (*given, f"{role}:{text}")))
                for x, name in made:
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, x, (*given, f"{name}:{text}")))


def _plain(rows):
    out = []
    kept = _damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, turns = _faults(own), [r[1] for r in own if r[1] is not None]
        cost, audit, given = _best(own, faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha256("\n".join(given).encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(seed, convs, most):
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        turn = 0
        for k in range(rng.randint(1, most)):
            role = rng.choice(("user", "assistant")) if rng.random() < 0.3 else ("user", "assistant")[k % 2]
            if k == 0 and rng.random() < 0.5 or rng.random() < 0.03:
                role = "system"
            if rng.random() < 0.05:
                role = rng.choice(("tool", None, "S", "éx"))
            text = rng.choice(("Yes.", "No!\n", "Why?\t ", "cut off", "  ", None, f"Own {k}. ", f"é {conv} {k}?", " ", "x" * 3000 + "."))
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text, "clash"))
            turn += rng.choice((1, 1, 1, 1, 2, 5, 0))
    return rows


def _odd():
    alone = next(k for k in range(900, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)  # dropped, so nothing is left
    return [(alone, 0, "user", "gone.", ""), (None, 1, "user", "A.", ""), (None, None, None, None, ""), (None, 2, "assistant", "B.", ""), (5000, 0, "assistant", "only.", "")]


@pytest.mark.parametrize("most_rows", [1, 2, 3, 7, 4096])
def test_digest(spark, most_rows):
    rows = _rows(most_rows, 25, 14) + _rows(50, 1, 120)[:60] + _odd()
    got = conversations.digest(spark.createDataFrame(rows, _KIND).repartition(3), most_rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == _plain(rows)
    assert {x for r in got for x in r[7]} == set("DIKR")


def test_rows_after_repair(spark):
    rows = [r[:4] for r in _rows(8, 40, 12)]
    _, parts = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most_rows=4)
    by = {}
    for r in sorted(conversations.repaired_rows(parts).collect(), key=lambda r: (r.at, r.place)):
        by.setdefault(r.conv_id, []).append(r.role[0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values())


def test_buckets_against_relaxation():
    rng = random.Random(4)
    for _ in range(200):
        codes, last = [rng.randrange(16) for _ in range(rng.randint(0, 12))], rng.random() < 0.5
        exits = [rng.choice((-1, 0, 3, 40)) for _ in range(4)]
        if max(exits) < 0:
            continue
        n = len(codes)
        dist = {(n, q): d for q, d in enumerate(exits) if d >= 0}
        for _ in range(40):
            for at in range(n, -1, -1):
                for q in range(4):
                    ways = [dist.get((at, q), 10**6)]
                    if at < n:
                        ways += [cost + dist.get((at + 1, to), 10**6) for _, to, cost in conversations.EDITS[codes[at]][q]]
                    if at < n or last:
                        ways.append(3 + dist.get((at, 3 if q == 2 else 2), 10**6))
                    if min(ways) < 10**6:
                        dist[at, q] = min(ways)
        assert conversations.to_go(codes, exits, last) == [dist.get((at, q), -1) for at in range(n + 1) for q in range(4)]


def test_sql():
    rows = _rows(2, 60, 9) + _odd()
    db = duckdb.connect()
    db.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar, audit varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?, ?)", rows)
    assert sorted(db.sql(conversations.ORACLE_SQL).fetchall(), key=str) == _plain(rows)


def test_empty_table(spark):
    assert conversations.digest(spark.createDataFrame([], _KIND)).collect() == []
