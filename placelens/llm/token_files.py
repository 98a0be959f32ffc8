"""Token ids as Huffman-coded binary files.

write_token_files tokenizes whole texts in ascending id order, counts every id
of the corpus, builds one length-limited canonical Huffman code and writes
files of blocks; read_token_files decodes them with a table.

A file: magic, length of a JSON header, the header, the code lengths (zlib),
ids of its documents and their token counts (int64, zlib), then Huffman blocks
(huffman.py), each with its bit-offset checkpoints. File names are ordered as
their documents are.

Cases: a null text counts as empty and has the end id alone; empty tables give
no files and no rows; a null id sorts first and is kept; equal ids are ordered
by text; other columns are left out.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, huffman, tokens

_MAGIC = b"TOKF0001"
_NO_ID = -(2**63)
_GROUPS = "part int, seq int, n_docs long, n_tokens long, doc_ids binary, sizes binary, ids binary, counts binary"


def _planes(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _tokenize(path: str, file_tokens: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        enc, part, seq, held, size = tokens.encoder(path), TaskContext.get().partitionId(), 0, [], 0

        def out():
            names, sizes, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
            return common.batch(schema, [part], [seq], [len(names)], [len(ids)], [names.astype("<i8").tobytes()], [sizes.astype("<i8").tobytes()], [_planes(ids)], [np.bincount(ids).astype("<i8").tobytes()])

        for b in batches:
            names = np.array([_NO_ID if x is None else x for x in b.column(0).to_pylist()], np.int64)
            texts = common.text_list(b.column(1))
            for lo, hi in tokens.groups_of_chars(texts):
                ids, sizes = enc.encode(texts[lo:hi])
                held.append((names[lo:hi], sizes, ids))
                size += len(ids)
                if size >= file_tokens:
                    yield out()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield out()

    return run


def _count(batches):
    tokens.forget()
    counts = np.zeros(0, np.int64)
    for b in batches:
        for data in b.column(0).to_pylist():
            own = np.frombuffer(data, "<i8").copy()
            if len(own) > len(counts):
                own, counts = counts, own
            counts[: len(own)] += own
    used = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "n"])


def pack_file(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codec: huffman.Codec, block_tokens: int) -> bytes:
    blocks = [codec.encode(ids[k : k + block_tokens]) for k in range(0, len(ids), block_tokens)]
    parts = [zlib.compress(codec.lengths.tobytes(), 6), zlib.compress(doc_ids.astype("<i8").tobytes(), 6), zlib.compress(sizes.astype("<i8").tobytes(), 6)]
    head = common.as_json({"n_docs": len(doc_ids), "n_tokens": len(ids), "parts": [len(p) for p in parts], "blocks": [len(b) for b in blocks]}).encode()
    return b"".join([_MAGIC, struct.pack("<I", len(head)), head, *parts, *blocks])


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of documents, their token counts, and all token ids."""
    if data[:8] != _MAGIC:
        raise ValueError("no token file")
    (n,) = struct.unpack_from("<I", data, 8)
    head, at, parts = json.loads(data[12 : 12 + n]), 12 + n, []
    for size in head["parts"]:
        parts.append(zlib.decompress(data[at : at + size]))
        at += size
    codec, ids = huffman.Codec(np.frombuffer(parts[0], np.uint8)), []
    for size in head["blocks"]:
        ids.append(codec.decode(data[at : at + size]))
        at += size
    return np.frombuffer(parts[1], "<i8"), np.frombuffer(parts[2], "<i8"), np.concatenate(ids) if ids else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, out_dir: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_bits: int = 16, file_tokens: int = 1_000_000, block_tokens: int = 1 << 16) -> DataFrame:
    """Write files into out_dir, which all executors must reach; return (file, part, seq, n_docs, n_tokens).

    The driver gets one count for each id of the vocabulary, whose size is the
    tokenizer's and not the corpus's.
    """
    spark, path = docs.sparkSession, tokenizer or tokens.default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    where = common.shared_dir(spark)
    rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(_tokenize(path, file_tokens), _GROUPS).write.option("compression", "zstd").parquet(where)
    groups = spark.read.schema(_GROUPS).parquet(where)
    counted = groups.select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in counted), default=0) + 1, np.int64)
    counts[[r.id for r in counted]] = [r.n for r in counted]
    lengths = huffman.code_lengths(counts, max_bits).tobytes()
    names = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def put(batches):
        tokens.forget()
        codec = huffman.Codec(np.frombuffer(lengths, np.uint8))
        for b in batches:
            for k in range(b.num_rows):
                part, seq, n_docs, n_tokens, doc_ids, sizes, ids = (c[k].as_py() for c in b.columns)
                file = f"{part:06d}-{seq:06d}.tok"
                common.put_file(f"{out_dir}/{file}", pack_file(np.frombuffer(doc_ids, "<i8"), np.frombuffer(sizes, "<i8"), _from_planes(ids), codec, block_tokens))
                yield common.batch(names, [file], [part], [seq], [n_docs], [n_tokens])

    manifest = common.written(groups.drop("counts").mapInArrow(put, "file string, part int, seq int, n_docs long, n_tokens long"))
    common.remove(spark, where)
    return manifest


def file_starts(files: DataFrame) -> DataFrame:
    """(part, seq, base) of files (part, seq, n_tokens): tokens in all files before. Only one row for each part meets in one task."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    within = files.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("own_base"))
    return within.join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("own_base")).alias("base"))


def read_token_files(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, part, seq, place, ids): ids as little-endian unsigned 32-bit integers; place: tokens before in the file."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("place", pa.int64()), ("ids", pa.binary())])

    def get(batches):
        tokens.forget()
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part, seq = (int(x) for x in path.rpartition("/")[2].partition(".")[0].split("-"))
                names, sizes, ids = unpack_file(data)
                ends = np.cumsum(sizes)
                for lo in range(0, len(names), 2000):
                    hi = min(lo + 2000, len(names))
                    raw = ids[ends[lo] - sizes[lo] : ends[hi - 1]].astype("<u4").tobytes()
                    at = np.concatenate([[0], np.cumsum(sizes[lo:hi])]) * 4
                    yield common.batch(schema, [None if x == _NO_ID else x for x in names[lo:hi].tolist()], np.full(hi - lo, part), np.full(hi - lo, seq), (ends - sizes)[lo:hi], [raw[at[k] : at[k + 1]] for k in range(hi - lo)])

    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, part int, seq int, place long, ids binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(out_dir).select("path", "content")
    return files.mapInArrow(get, "doc_id long, part int, seq int, place long, ids binary")


def digest(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    rows = read_token_files(spark, out_dir, manifest)
    rows = common.written(rows.select("doc_id", "part", "seq", "place", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    starts = file_starts(rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n_tokens")))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
