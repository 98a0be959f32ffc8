"""Repair of the role structure of conversations by cheapest edits.

A conversation is well formed if the first letters of its roles read
(s?(ua)+)?. A node is a row border and what has been given out so far
(nothing, the system row, a user row, an assistant row); arcs are edits with
small integer costs, so distances to the end come from a bucket queue (Dial),
and the audit is the walk from the start along tight arcs that takes the least
letter each time.

Edits: K keeps a row (0), R gives it the role user or assistant (3), D deletes
it (4; blank and duplicate rows must go), I inserts an empty user or assistant
row (3). A truncated row that stays adds 3.

No task needs a whole conversation. Rows are dealt by ranges and cut into
blocks of most_rows rows or most_chars characters. Distances across a block are
a matrix of 4 by 4 numbers; these are joined from the end of a conversation,
which gives each block the distances at its far border. Each block then walks
from every state it may be entered in, and the walks are joined from the start.
Between blocks only such matrices, and one letter a row, are gathered.

Cases: a null role or text is one space; rows go by turn (nulls first), equal
turns by role and text; a role without a first letter s, u or a (an empty one
as well) can't be kept; a null conv_id is a conversation; an empty table gives
no rows; other columns are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing given out, system, user, assistant. A row's code is 4 * initial + fault.
_INITIALS = {"s": 1, "u": 2, "a": 3}
BLANK, DUPLICATE, CUT = 1, 2, 3
_KEPT = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (3, 2): 2, (2, 3): 3}  # (state, initial) -> state
_MADE = (2, 2, 3, 2)  # the state after a row whose role may be chosen
_ACCEPT = (0, -1, -1, 0)  # distances at the end, -1: none


def _edits(code: int) -> list[list[tuple[str, int, int]]]:
    """By state the edits of a row, in order of their letters: (letter, state after it, cost)."""
    initial, fault = divmod(code, 4)
    out = []
    for q in range(4):
        own = [("D", q, DELETE)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            if (q, initial) in _KEPT:
                own.append(("K", _KEPT[q, initial], more))
            own.append(("R", _MADE[q], REROLE + more))
        out.append(own)
    return out


EDITS = [_edits(code) for code in range(16)]
_INTO = [[[(p, cost) for p in range(4) for _, to, cost in EDITS[code][p] if to == q] for q in range(4)] for code in range(16)]
_INSERTED = [[p for p in range(4) if _MADE[p] == q] for q in range(4)]


def to_go(codes: list[int], exits: list[int] | tuple, last: bool) -> list[int]:
    """The least cost from each node (4 * border + state) to the exits, which have costs of their own.

    Rows may be inserted before each row, and after the last one where the block is the last.
    """
    n = len(codes)
    far = 4 * n + 64 + max(exits)
    dist, queue = [far] * (4 * n + 4), [[] for _ in range(max(exits) + 1)]

    def reach(node: int, d: int) -> None:
        if d < dist[node]:
            dist[node] = d
            while len(queue) <= d:
                queue.append([])
            queue[d].append(node)

    for q, d in enumerate(exits):
        if d >= 0:
            reach(4 * n + q, d)
    d = 0
    while d < len(queue):
        for node in queue[d]:  # arcs without cost add to it meanwhile
            if dist[node] == d:
                at, q = divmod(node, 4)
                if at:
                    for p, cost in _INTO[codes[at - 1]][q]:
                        reach(node - 4 - q + p, d + cost)
                if at < n or last:
                    for p in _INSERTED[q]:
                        reach(node - q + p, d + INSERT)
        queue[d] = []
        d += 1
    return [x if x < far else -1 for x in dist]


def walk(codes: list[int], dist: list[int], q: int, last: bool) -> tuple[int, str]:
    """From a state at the near border along tight arcs, the least letter first: the state at the far border, and the letters."""
    at, n, out = 0, len(codes), []
    while at < n or last and dist[4 * at + q]:
        here = dist[4 * at + q]
        arcs = [(letter, at + 1, to, cost) for letter, to, cost in EDITS[codes[at]][q]] if at < n else []
        arcs.insert(1, ("I", at, _MADE[q], INSERT))
        letter, at, q = next((letter, to_at, to) for letter, to_at, to, cost in arcs if dist[4 * to_at + to] >= 0 and dist[4 * to_at + to] + cost == here)
        out.append(letter)
    return q, "".join(out)


def applied(audit: str, roles: list[str], texts: list[str], q: int = 0) -> list[tuple[str, str]]:
    """The rows that the edits leave, where q has been given out before."""
    out, at = [], 0
    for letter in audit:
        role = "assistant" if q == 2 else "user"
        if letter in "KR":
            out.append((roles[at] if letter == "K" else role, texts[at]))
            q = _KEPT[q, _INITIALS[roles[at][0]]] if letter == "K" else _MADE[q]
        elif letter == "I":
            out.append((role, ""))
            q = _MADE[q]
        at += letter != "I"
    return out


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, code (duplicates are not known yet) and a digest of role and text."""
    c = F.col
    rows = rows.select("conv_id", c("turn").cast("long").alias("turn"), F.coalesce(c("role"), F.lit(" ")).alias("role"), F.coalesce(c("text"), F.lit(" ")).alias("text"))
    trimmed = F.rtrim(c("text"), F.lit(_WHITE))
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    fault = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), c("role"), c("text")), 256))
    return rows.withColumns({"code": 4 * first + fault, "digest": digest})


def _cut(most_rows: int, most_chars: int):
    names = ["at", "conv_id", "codes", "firsts", "roles", "texts", "low_turn", "high_turn", "n_turns"]
    firsts = pa.list_(pa.struct([("k", pa.int32()), ("digest", pa.binary())]))

    def run(batches):
        part, seen_rows, own, conv, chars = TaskContext.get().partitionId() << 33, 0, [], None, 0

        def block():
            digests, codes, new = set(), [], []
            for k, (_, _, _, code, digest) in enumerate(own):
                if code % 4 != BLANK:
                    if digest in digests:
                        code += DUPLICATE - code % 4
                    else:
                        digests.add(digest)
                        new.append({"k": k, "digest": digest})
                codes.append("%x" % code)
            turns = [t for t, *_ in own if t is not None]
            values = [part + seen_rows - len(own), conv, "".join(codes), new, [r[1] for r in own], [r[2] for r in own], min(turns, default=None), max(turns, default=None), len(set(turns))]
            kinds = [pa.int64(), conv_kind, pa.string(), firsts, pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        for b in batches:
            conv_kind = b.schema.field(0).type
            for c, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if own and (c != conv or len(own) >= most_rows or chars >= most_chars):
                    yield block()
                    own, chars = [], 0
                conv = c
                own.append(row)
                chars += len(row[2])
                seen_rows += 1
        if own:
            yield block()

    return run


def _rows_to(f, schema: pa.Schema):
    """A mapInArrow function that makes one row of each row."""

    def run(batches):
        for b in batches:
            out = [f(**r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _solve(at, conv_id, codes, later, last, low_turn, high_turn, n_turns) -> dict:
    codes = [int(x, 16) for x in codes]
    for k in later or ():
        codes[k] += DUPLICATE - codes[k] % 4
    if last:
        near = to_go(codes, _ACCEPT, True)[:4]
    else:
        across = [to_go(codes, [0 if p == q else -1 for p in range(4)], False)[:4] for q in range(4)]
        near = [across[to][q] for q in range(4) for to in range(4)]
    faults = [x % 4 for x in codes]
    illegal = sum(not _legal(a, b) for a, b in zip(codes, codes[1:], strict=False))
    counts = {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT), "illegal": illegal}
    return {"at": at, "conv_id": conv_id, "codes": "".join("%x" % x for x in codes), "last": last, "near": near, "low_turn": low_turn, "high_turn": high_turn, "n_turns": n_turns, **counts}


def _legal(a: int, b: int) -> bool:
    return (a // 4, b // 4) in ((1, 2), (2, 3), (3, 2))


def _backward(conv_id, blocks) -> dict:
    """Sums of a conversation and, for each block, the distances at its far border."""
    far, exits = list(_ACCEPT), []
    for b in reversed(blocks):
        low = min(x for x in far if x >= 0)
        exits.append({"at": b["at"], "exits": [x - low if x >= 0 else -1 for x in far] if len(b["near"]) == 16 else list(far)})
        if len(b["near"]) == 16:
            far = [min((x + far[k] for k, x in enumerate(b["near"][4 * q : 4 * q + 4]) if x >= 0), default=-1) for q in range(4)]
        else:
            far = b["near"]
    out = {k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(not _legal(int(a["codes"][-1], 16), int(b["codes"][0], 16)) for a, b in zip(blocks, blocks[1:], strict=False))
    dated = [b for b in blocks if b["n_turns"]]
    turns = sum(b["n_turns"] for b in dated) - sum(a["high_turn"] == b["low_turn"] for a, b in zip(dated, dated[1:], strict=False))
    gaps = dated[-1]["high_turn"] - dated[0]["low_turn"] + 1 - turns if dated else 0
    return {"conv_id": conv_id, "gaps": gaps, **out, "cost": far[0], "far": exits[::-1]}


def _walks(at, conv_id, codes, first, last, exits) -> dict:
    codes = [int(x, 16) for x in codes]
    dist = to_go(codes, exits, last)
    ends, audits = zip(*(walk(codes, dist, q, last) for q in ((0,) if first else range(4))), strict=True)
    return {"at": at, "conv_id": conv_id, "ends": list(ends), "audits": list(audits)}


def _forward(conv_id, blocks) -> dict:
    q, out = 0, []
    for b in blocks:
        out.append({"at": b["at"], "q": q})
        q = b["ends"][q]
    return {"entries": out}


def repair(rows: DataFrame, most_rows: int = 4096, most_chars: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """Conversations and their repaired parts.

    The first has a row per conv_id: gaps, blank, duplicate, truncated, illegal, cost. The second has a row
    per block: conv_id, at (ascending in a conversation), audit and rows (role and text after the edits).
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    coded = _coded(rows)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = coded.repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    blocks = common.written(
        dealt.mapInArrow(_cut(most_rows, most_chars), f"at long, conv_id {kind}, codes string, firsts array<struct<k: int, digest: binary>>, roles array<string>, texts array<string>, low_turn long, high_turn long, n_turns long")
    )
    w = Window.partitionBy("conv_id")
    marks = common.written(blocks.select("conv_id", "at").select("at", (F.col("at") == F.min("at").over(w)).alias("first"), (F.col("at") == F.max("at").over(w)).alias("last")))
    # a text of several blocks of a conversation: one row per block that has it
    met = blocks.join(marks.where("not (first and last)"), "at").select("conv_id", "at", F.explode("firsts").alias("f"))
    met = met.withColumn("lead", F.min("at").over(Window.partitionBy("conv_id", "f.digest")))
    later = met.where("at > lead").groupBy("at").agg(F.collect_list("f.k").alias("later"))

    conv = pa.field("conv_id", _arrow(kind))
    ints = [pa.field(k, pa.int64()) for k in ("low_turn", "high_turn", "n_turns", "blank", "duplicate", "truncated", "illegal")]
    schema = pa.schema([pa.field("at", pa.int64()), conv, pa.field("codes", pa.string()), pa.field("last", pa.bool_()), pa.field("near", pa.list_(pa.int64())), *ints])
    text = f"at long, conv_id {kind}, codes string, last boolean, near array<long>, " + ", ".join(f"{f.name} long" for f in ints)
    ready = blocks.select("at", "conv_id", "codes", "low_turn", "high_turn", "n_turns").join(marks, "at").join(later, "at", "left")
    solved = common.written(ready.select("at", "conv_id", "codes", "later", "last", "low_turn", "high_turn", "n_turns").mapInArrow(_rows_to(_solve, schema), text))

    ends = F.concat(F.left("codes", F.lit(1)), F.right("codes", F.lit(1))).alias("codes")
    together = F.sort_array(F.collect_list(F.struct("at", "near", ends, *(f.name for f in ints)))).alias("blocks")
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    far = pa.field("far", pa.list_(pa.struct([("at", pa.int64()), ("exits", pa.list_(pa.int64()))])))
    schema = pa.schema([conv, *(pa.field(k, pa.int64()) for k in sums), far])
    text = f"conv_id {kind}, " + ", ".join(f"{k} long" for k in sums) + ", far array<struct<at: long, exits: array<long>>>"
    summary = common.written(solved.groupBy("conv_id").agg(together).mapInArrow(_rows_to(_backward, schema), text))

    exits = summary.select(F.explode("far").alias("x")).select("x.at", "x.exits")
    schema = pa.schema([pa.field("at", pa.int64()), conv, pa.field("ends", pa.list_(pa.int32())), pa.field("audits", pa.list_(pa.string()))])
    walked = solved.join(marks.select("at", "first"), "at").join(exits, "at").select("at", "conv_id", "codes", "first", "last", "exits")
    walked = common.written(walked.mapInArrow(_rows_to(_walks, schema), f"at long, conv_id {kind}, ends array<int>, audits array<string>"))

    entered = pa.schema([("entries", pa.list_(pa.struct([("at", pa.int64()), ("q", pa.int32())])))])
    together = F.sort_array(F.collect_list(F.struct("at", "ends"))).alias("blocks")
    entries = walked.groupBy("conv_id").agg(together).mapInArrow(_rows_to(_forward, entered), "entries array<struct<at: long, q: int>>")
    entries = entries.select(F.explode("entries").alias("x")).select("x.at", "x.q")
    audits = walked.join(entries, "at").select("at", "q", F.get("audits", F.col("q")).alias("audit"))

    def edited(conv_id, at, q, audit, roles, texts):
        return {"conv_id": conv_id, "at": at, "audit": audit, "rows": [{"role": r, "text": t} for r, t in applied(audit, roles, texts, q)]}

    schema = pa.schema([conv, pa.field("at", pa.int64()), pa.field("audit", pa.string()), pa.field("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    parts = blocks.join(audits, "at").select("conv_id", "at", "q", "audit", "roles", "texts").mapInArrow(_rows_to(edited, schema), f"conv_id {kind}, at long, audit string, rows array<struct<role: string, text: string>>")
    return summary.drop("far"), parts


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def repaired_rows(parts: DataFrame) -> DataFrame:
    """conv_id, at, place (in the part), role and text of every row after repair."""
    return parts.select("conv_id", "at", F.posexplode("rows").alias("place", "r")).select("conv_id", "at", "place", "r.role", "r.text")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by the unsigned crc32 of `conv_id:turn`, modulo 20. A null counts as one space.

    0 drops a row, 1 empties its text, 2 takes the marks . ! ? out of it, 3 repeats it, 4 makes its role user.
    """
    c = F.col
    spaced = lambda x: F.coalesce(c(x).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text: Column = F.when(c("by") == 1, "").when(c("by") == 2, F.translate(c("text"), ".!?", "")).otherwise(c("text"))
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), by.alias("by")).where("by > 0")
    copies = F.explode(F.when(c("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(c("by") == 4, "user").otherwise(c("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def digest(conversations: DataFrame, most_rows: int = 4096) -> DataFrame:
    """A row for every conv_id of the table: what is wrong after damage, and the repair in short.

    The hash of a repaired conversation is of one text, so its parts, already repaired, meet in one row.
    """
    c = F.col
    summary, parts = repair(damaged(conversations), most_rows)
    piece = F.when(F.size("rows") > 0, F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"))
    whole = parts.select("conv_id", "at", "audit", piece.alias("piece")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "audit", "piece"))).alias("p"))
    whole = whole.select(c("conv_id").alias("w_id"), F.array_join("p.audit", "").alias("audit"), F.sha2(F.array_join("p.piece", "\n"), 256).alias("repaired_sha256"))
    s = summary.withColumnRenamed("conv_id", "s_id")
    out = conversations.select("conv_id").distinct().join(s, c("conv_id").eqNullSafe(c("s_id")), "left").join(whole, c("conv_id").eqNullSafe(c("w_id")), "left")
    numbers = [F.coalesce(c(k), F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLE_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations
), dealt AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(s) + 1), lambda k: CAST(ascii(substr(s, k, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % 20 AS how
  FROM named, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM dealt, range(2) copies(n) WHERE how <> 0 AND (n = 0 OR how = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last_char FROM damaged
), judged AS (
  SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed
), inserts(q, q2, cost, letters, rep) AS (
  VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']),
         (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])
), edits(letter, q, q2, needs, gives, cost) AS (
  VALUES ('D', 0, 0, NULL, NULL, 4), ('D', 1, 1, NULL, NULL, 4), ('D', 2, 2, NULL, NULL, 4), ('D', 3, 3, NULL, NULL, 4),
         ('K', 0, 1, 's', NULL, 0), ('K', 0, 2, 'u', NULL, 0), ('K', 1, 2, 'u', NULL, 0), ('K', 3, 2, 'u', NULL, 0), ('K', 2, 3, 'a', NULL, 0),
         ('R', 0, 2, NULL, 'user', 3), ('R', 1, 2, NULL, 'user', 3), ('R', 3, 2, NULL, 'user', 3), ('R', 2, 3, NULL, 'assistant', 3)
), ways AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': CAST(0 AS BIGINT), 'audit': '', 'rep': CAST([] AS VARCHAR[])} AS best FROM judged
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.q2,
         min({'cost': CAST(w.best.cost + n.cost + e.cost + CASE WHEN e.letter <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END AS BIGINT), 'audit': w.best.audit || n.letters || e.letter,
              'rep': list_concat(w.best.rep, n.rep, CASE WHEN e.letter = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(e.gives, j.role) || ':' || j.text] END)})
  FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i JOIN inserts n ON n.q = w.q
  JOIN edits e ON e.q = n.q2 AND (e.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate') AND (e.needs IS NULL OR e.needs = j.initial))
  GROUP BY w.conv_id, w.i, e.q2
), sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 0 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), ends AS (
  SELECT s.conv_id, min({'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.letters, 'rep': list_concat(w.best.rep, n.rep)}) AS best
  FROM sums s JOIN ways w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.n JOIN inserts n ON n.q = w.q AND n.q2 IN (0, 3) GROUP BY s.conv_id
)
SELECT c.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
       coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.rep, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
