"""Passages of 50 words in fewer lines than a window, in the operator and in the pipeline's stage."""

import corpus_pipeline
from placelens.llm import lines


def _line(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def _later(texts, words=50):
    """Every run of lines that came before, of three lines or more or of 50 words, goes."""
    seen, out = set(), []
    for t in texts:
        rows = t.split("\n")
        held = [k for k, x in enumerate(rows) if x.strip()]
        gone = set()
        for size in range(1, len(held) + 1):
            for s in range(len(held) - size + 1):
                own = tuple(rows[k] for k in held[s : s + size])
                if size < 3 and sum(len(x.split()) for x in own) < words:
                    continue
                if own in seen:
                    gone |= set(range(s, s + size))
                seen.add(own)
        keep, last = [], False
        for k, x in enumerate(rows):
            last = held.index(k) in gone if k in held else last
            if not last:
                keep.append(x)
        out.append("\n".join(keep))
    return out


TEXTS = [
    "\n".join([_line("a", 9), _line("b", 43), _line("c", 49), _line("d", 5)]),
    "\n".join([_line("e", 9), _line("b", 43), "", _line("c", 49), _line("f", 5)]),  # 92 words in two lines
    "\n".join([_line("g", 60), _line("h", 4), _line("i", 3)]),
    "\n".join([_line("j", 2), _line("g", 60), _line("h", 4), _line("k", 3)]),  # the short line after a long one
    "\n".join([_line("l", 4), _line("m", 47), _line("n", 20)]),
    "\n".join([_line("o", 4), _line("l", 4), _line("m", 47), _line("p", 20)]),  # the short line before it
    "\n".join([_line("q", 20), _line("r", 29), _line("s", 3)]),
    "\n".join([_line("t", 20), _line("q", 20), _line("r", 29), _line("u", 3)]),  # 49 words stay
    "",
]


def test_passages(spark):
    df = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_chars long").repartition(3)
    want = dict(enumerate(_later(TEXTS)))
    assert [k for k, t in want.items() if t != TEXTS[k]] == [1, 3, 5]
    for got in (lines.remove_runs(df, passages=True), corpus_pipeline.line_dedup(spark, df, "")):
        assert {r.doc_id: r.text for r in got.collect()} == want
    assert {r.doc_id: r.n_removed for r in lines.report(df, passages=True).collect()} == {k: {1: 2, 3: 2, 5: 2}.get(k, 0) for k in want}
