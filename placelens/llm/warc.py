"""WARC archives: writing with revisit records, reading by boundary chains.

Writing: each page becomes one record; of pages with equal payloads of at least
min_revisit_bytes bytes the one with the largest id is the response, and the
others are revisits without a body that name its digest and its record.

Reading: an archive is cut into byte ranges. A task reports every place in its
range where a record's header parses, with the place where the next record must
start; a payload may hold the magic itself, so these are candidates. Chains
inside a range are resolved there; between ranges, pointer jumping from the
start of the file doubles the reach each round. Candidates that no chain from
the start reaches are dropped before any payload is read or digested.

A response's block is an HTTP head and the payload; payload_bytes and digests
are of the payload. Every record has the fields that the format demands.

Cases: a null payload counts as empty; a null URL leaves its header line out; a
null id is written as its own record without an id, keeps what it is, and never
is a response others refer to; empty tables give no archive and no rows; white
space in a URL is percent-encoded, so that it cannot end the header. Rows equal
in id and payload are alike: all are responses or all revisits; rows with an
equal id and another payload are pages of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"WARC/1.0\r\n"
_FIELDS = "payload_bytes long, payload_digest string, record_type string, page_id long, refers_to long"
_MANIFEST = "file string, size long, records long"
_HEAD_LIMIT = 1 << 16


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digest(column: str) -> Column:
    return F.unhex(F.sha1(F.encode(column, "UTF-8")))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A whole record; a page without an id is named by its URL and digest."""
    digest = digest32(payload)
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>"
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return MAGIC + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the record header at a place, and where its body starts; None if there is none."""
    if not data.startswith(MAGIC, at):
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in data[at + len(MAGIC) : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, end + 4


def revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, d, refers_to) of the revisit records, d the payload's digest; pages: (page_id, payload)."""
    keyed = pages.where("page_id is not null").select("page_id", _digest("payload").alias("d"), F.octet_length("payload").alias("n")).where(F.col("n") >= min_revisit_bytes)
    keyed = common.written(keyed.select("page_id", "d").distinct())
    largest = keyed.groupBy("d").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("d", "refers_to")
    return keyed.join(largest, "d").where("page_id <> refers_to").select("page_id", "d", "refers_to")


def write_archives(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, file_bytes: int = 64 << 20, max_broadcast_rows: int = 200_000) -> DataFrame:
    """Write archives of about file_bytes each into out_dir, which all executors must reach; return (file, size, records).

    Payloads are shuffled only if there are over max_broadcast_rows revisits;
    up to then their ids and digests, 50 bytes each, are broadcast.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    again = common.written(revisits(rows, min_revisit_bytes))
    if again.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        again = F.broadcast(again)
    schema = pa.schema([("file", pa.string()), ("size", pa.int64()), ("records", pa.int64())])

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            name = f"{part:06d}-{seq:06d}.warc"
            common.put_file(f"{out_dir}/{name}", b"".join(held))
            return common.batch(schema, [name], [size], [len(held)])

        for b in batches:
            for k in range(b.num_rows):
                page_id, url, payload, refers_to = (c[k].as_py() for c in b.columns)
                held.append(record(page_id, url, payload.encode("utf-8", "replace"), refers_to))
                size += len(held[-1])
                if size >= file_bytes:
                    yield out()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield out()

    ours = F.when(F.col("page_id").isNotNull(), _digest("payload")).alias("d")
    return common.written(rows.select("*", ours).join(again, ["page_id", "d"], "left").select("page_id", "url", "payload", "refers_to").mapInArrow(run, _MANIFEST))


def local_chain(offsets: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For candidates at ascending offsets: the index each leads to (-1: none here), and where its chain leaves."""
    at = np.searchsorted(offsets, following)
    at[at == len(offsets)] = -1
    inside = (at >= 0) & (offsets[at] == following)
    to = np.where(inside, at, -1)
    leaves = following.copy()
    for k in range(len(offsets) - 1, -1, -1):  # a successor lies behind
        if to[k] >= 0:
            leaves[k] = leaves[to[k]]
    return to, leaves


def _scan(out_dir: str, range_bytes: int):
    """Candidates of a range: where each starts, where the next record must start, and what the header says."""
    schema = pa.schema([("file", pa.string()), ("range", pa.int64()), ("at", pa.int64()), ("next", pa.int64()), ("leaves", pa.int64()), ("body", pa.int64()), ("said", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("refers_to", pa.int64())])
    number = re.compile(r"<urn:page:(-?\d+)>")
    whole = lambda x: int(x) if x and x.removeprefix("-").isdigit() else None

    def run(batches):
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                uri = f"{out_dir}/{file}"
                data = common.get_range(uri, start, range_bytes + _HEAD_LIMIT)
                rows, at = [], data.find(MAGIC)
                while 0 <= at < range_bytes:
                    more = _HEAD_LIMIT
                    while data.find(b"\r\n\r\n", at) < 0 and (next_part := common.get_range(uri, start + len(data), more)):
                        data, more = data + next_part, 2 * more
                    parsed = parse_header(data, at)
                    if parsed:
                        fields, body = parsed
                        n, refers = int(fields["content-length"]), number.search(fields.get("warc-refers-to", ""))
                        rows.append((start + at, start + body + n + 4, start + body, fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields["warc-type"], whole(fields.get("x-payload-length")), whole(fields.get("x-page-id")), int(refers[1]) if refers else None))
                    at = data.find(MAGIC, at + 1)
                if rows:
                    offsets, following, *rest = map(list, zip(*rows, strict=True))
                    _, leaves = local_chain(np.array(offsets, np.int64), np.array(following, np.int64))
                    yield common.batch(schema, [file] * len(rows), [start // range_bytes] * len(rows), offsets, following, leaves, *rest)

    return run


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head of a record's block, or all of it without one."""
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _mark(out_dir: str, range_bytes: int):
    """Of one range's candidates, those on the chain that enters it, with their payloads' sizes and digests. Ranges come whole and sorted."""
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64())])

    def marked(t):
        offsets, following = t["at"].to_numpy(), t["next"].to_numpy()
        to, _ = local_chain(offsets, following)
        k, chain = int(np.searchsorted(offsets, t["enter"][0].as_py())), []
        while k >= 0:
            chain.append(k)
            k = int(to[k])
        own = t.take(pa.array(chain)).to_pylist()
        uri, base = f"{out_dir}/{own[0]['file']}", own[0]["range"] * range_bytes
        data, rows = common.get_range(uri, base, range_bytes), []
        for r in own:
            size, digest = r["payload_bytes"], r["said"]
            if r["record_type"] != "revisit":
                lo, hi = r["body"] - base, r["next"] - 4 - base
                payload = payload_of(data[lo:hi] if hi <= len(data) else common.get_range(uri, r["body"], hi - lo))
                size, digest = len(payload), digest32(payload)
            rows.append((r["file"], r["at"], size, digest, r["record_type"], r["page_id"], r["refers_to"]))
        return common.batch(schema, *map(list, zip(*rows, strict=True)))

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            names, ranges = held["file"].to_pylist(), held["range"].to_numpy()
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1] or ranges[k] != ranges[k - 1])]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield marked(held.slice(lo, hi - lo).combine_chunks())
            held = held.slice(cuts[-1])
        if held is not None and len(held):
            yield marked(held.combine_chunks())

    return run


def read_archives(spark: SparkSession, out_dir: str, manifest: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """Records reachable from the start of their files: file, at, payload_bytes, payload_digest, record_type, page_id, refers_to."""
    ranges = manifest.select("file", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes))).alias("start")).repartition("file", "start")
    found = common.written(ranges.mapInArrow(_scan(out_dir, range_bytes), "file string, range long, at long, next long, leaves long, body long, said string, record_type string, payload_bytes long, page_id long, refers_to long"))
    # A place where a range may be entered, and where the chain from there leaves the range.
    jump = found.select("file", "at", F.col("leaves").alias("to"))
    reached = manifest.select("file", F.lit(0).cast("long").alias("at")).join(jump.select("file", "at"), ["file", "at"], "left_semi")
    reached = common.written(reached)
    count = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(found.select("file", "at"), ["file", "at"], "left_semi")
        reached = common.written(reached.union(ahead).distinct())
        if (n := reached.count()) == count:
            break
        count = n
        further = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = common.written(jump.join(further, ["file", "to"], "left").select("file", "at", F.coalesce("far", "to").alias("to")))
    enter = reached.withColumn("range", F.floor(F.col("at") / range_bytes)).groupBy("file", "range").agg(F.min("at").alias("enter"))
    inside = found.join(enter, ["file", "range"])
    return inside.repartition("file", "range").sortWithinPartitions("file", "range", "at").mapInArrow(_mark(out_dir, range_bytes), f"file string, at long, {_FIELDS}")


def digest(pages: DataFrame, out_dir: str) -> DataFrame:
    """Write pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest = write_archives(pages, out_dir)
    return read_archives(pages.sparkSession, out_dir, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, octet_length(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, k // 4 * 5 + 1, 5) AS BIGINT) >> (15 - k % 4 * 5)) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM d
"""
