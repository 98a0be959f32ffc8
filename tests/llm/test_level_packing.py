"""Sum-of-squares packing against the library's ids and a plain sum of squares."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from placelens.llm import level_packing, tokens

SIZE = 64


def _sum(counts, free):
    return sum(n * n for f, n in counts.items() if f not in free)


@pytest.mark.parametrize("seed", range(3))
def test_each_document_goes_where_the_sum_of_squares_is_least(seed):
    rng, w = random.Random(seed), level_packing.Windows(SIZE, most_open=10**9)
    free = {0, SIZE, *level_packing.unpadded(SIZE)}
    for k in range(1500):
        n = rng.choice((rng.randint(1, SIZE - 1), rng.randint(20, 30)))
        before = {f: int(c) for f, c in enumerate(w.counts) if c}
        best = min((_sum({**before, f: before.get(f, 1) - 1} | ({f + n: before.get(f + n, 0) + 1}), free), -f) for f in (0, *before) if f + n <= SIZE)
        w.add(k, bytes(4 * n))
        after = {f: int(c) for f, c in enumerate(w.counts) if c}
        assert _sum(after, free) == best[0]
        assert after.get(-best[1] + n, 0) == before.get(-best[1] + n, 0) + 1 or n - best[1] == SIZE


@pytest.mark.parametrize(("low", "high", "most_open"), [(1, 200, 10), (40, 40, 50), (33, 50, 7), (1, 3, 5), (64, 128, 4), (1, 63, 1000)])
def test_nothing_is_padded_or_lost(low, high, most_open):
    rng, w, texts = random.Random(low + high), level_packing.Windows(SIZE, 7, most_open), {}
    for k in range(800):
        texts[k] = np.array([rng.randrange(1 << 31) for _ in range(rng.randint(low, high))], "<u4").tobytes()
        w.add(k, texts[k])
        assert w.n_open <= most_open
    w.settle()
    fills, back = defaultdict(int), {k: bytearray(len(t)) for k, t in texts.items()}
    for k, start, ids, n, seq, offset in w.rows:
        assert offset == fills[seq] and n == len(texts[k]) // 4 and ids
        fills[seq] += len(ids) // 4
        back[k][4 * start : 4 * start + len(ids)] = ids
    assert back == texts and sum(len(r[2]) for r in w.rows) == sum(map(len, texts.values()))
    assert all(f & (f - 1) == 0 and f <= SIZE for f in fills.values()) and min(fills) == 7


def test_documents_that_fit_are_rarely_cut():
    rng, w = random.Random(5), level_packing.Windows(1024)
    for k in range(20_000):
        w.add(k, bytes(4 * min(4000, 1 + int(rng.lognormvariate(5.5, 1)))))
    w.settle()
    pieces = defaultdict(int)
    for r in w.rows:
        if r[3] <= 1024:
            pieces[r[0]] += 1
    assert sum(n > 1 for n in pieces.values()) < 0.02 * len(pieces)


def test_pack_against_the_library(spark):
    from tokenizers import Tokenizer

    enc, rng = Tokenizer.from_file(tokens.default_path()), random.Random(3)
    texts = [None, "", "  ", "a b", "é" * 900, "x" * 20_000, "nul\0 <|endoftext|>"]
    texts += [" ".join(rng.choice(("stone", "river", "le", "été", "Haus")) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [(k, t, k, "clash") for k, t in enumerate(texts)] + [(None, "no id", 1, ""), (3, "again", 2, ""), (3, "again", 2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string").repartition(3)
    got = level_packing.digest(level_packing.pack(docs, size=256, most_open=8)).collect()
    assert set(got[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    fills, own = defaultdict(list), defaultdict(list)
    for r in got:
        fills[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append(r)
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0
    for k, t in enumerate(texts):
        if k == 3:
            continue
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.start == 0 for r in own[3]) == 3 and sum(r.length for r in own[None]) == own[None][0].doc_tokens


def test_empty_table(spark):
    assert level_packing.digest(level_packing.pack(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
