"""Token ids in training order: fixed-stride binary shards for sequential, resumable reads.

Documents are encoded (byte-level BPE, by tiktoken) and cut into sequences of stride tokens,
the last one padded. A sequence's number follows from its document id and its
place there, and a keyed Feistel permutation with cycle-walking maps the
numbers, a bijection that any task computes alone: no shuffle buffer, no table.
The order of the permuted numbers is the training order. Ranges of them are the
shards; as the permutation spreads any ids evenly, equal ranges get near equal
shares, and the rank in a range and the counts of the ranges before it are the
global slot, without gaps. In a shard's file record r is slot first + r at byte
r * record size, so a reader can seek to any slot and go on after any stop.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import blocks, kept, load_ranks
from .common import materialise, shared_dir

ROUNDS = 6


def _round_keys(key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.uint64(key % (1 << 64)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def permute(numbers: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slot of each number under the permutation of [0, n) that key names; inverse: the number of each slot.

    A balanced Feistel network permutes the least even number of bits that hold
    n; what falls outside [0, n) goes through it again (cycle-walking).
    """
    x = np.asarray(numbers).astype(np.uint64)
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key)
    if inverse:
        keys = keys[::-1]
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & low
        if inverse:
            left, right = right, left
        for k in keys:
            with np.errstate(over="ignore"):
                f = (right ^ k) * np.uint64(0xD6E8FEB86659FD93)
                f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(29)) & low)
        if inverse:
            left, right = right, left
        x[todo] = left << half | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


@dataclass(frozen=True)
class Order:
    """Numbers own * per + piece below domain, permuted by key, in ranges of span."""

    per: int
    domain: int
    key: int
    span: int


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def sequences(docs: DataFrame, ranks_path: str, pattern: str, stride: int, end_id: int, id_col: str, text_col: str, own: Column, order: Order) -> DataFrame:
    """Sequences of at most stride ids of every row: id_col, piece, n_tokens, ids (16-bit little-endian, padded with end_id to stride), value and shard.

    A document is its ids and then end_id, so a null or empty text is one
    sequence of one token. own: the document's number; value: that of the
    sequence, permuted; shard: the range it falls into.
    """
    ranks = load_ranks(ranks_path)
    if max(max(ranks.values()), end_id) >= 1 << 16:
        raise ValueError("ids of more than 16 bits")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    source = docs.select(id_col, text_col, own.cast("long").alias("__own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = kept((ranks_path, pattern, "tiktoken"), lambda: tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}))
        for batch, texts in blocks(batches, 1, 1 << 22):
            found = [np.array(encoding.encode_ordinary(t), "<u2") for t in texts]
            sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
            pieces = -(-sizes // stride)
            starts = np.cumsum(pieces) - pieces
            ids = np.full((int(pieces.sum()), stride), end_id, "<u2")
            flat = ids.reshape(-1)
            for start, own_ids in zip((starts * stride).tolist(), found):
                flat[start : start + len(own_ids)] = own_ids
            row = np.repeat(np.arange(len(found)), pieces)
            piece = np.arange(len(ids)) - starts[row]
            count = np.minimum(sizes[row] - piece * stride, stride)
            value = permute(batch.column(2).to_numpy()[row] * order.per + piece, order.domain, order.key)
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(count, pa.int32()), _binary(ids)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value), pa.array(value // order.span)], [id_col, "piece", "n_tokens", "ids", "value", "shard"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, piece int, n_tokens int, ids binary, value bigint, shard bigint")


def _place(out_dir: str) -> tuple[fs.FileSystem, str]:
    if urlparse(out_dir).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(out_dir).path
    return fs.FileSystem.from_uri(out_dir)


def write_shards(
    docs: DataFrame,
    out_dir: str,
    ranks_path: str,
    pattern: str,
    stride: int = 512,
    shards: int | None = None,
    key: int = 2024,
    end_id: int = 50256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the shards under out_dir (a folder that all executors share) and return where every sequence is.

    Result: id_col (a bigint), piece, n_tokens, slot, shard, byte_offset,
    ids_crc32 (of the record as it is in the file). meta.json holds what a
    reader needs. A shard file is written under another name and then moved, so
    a task that is run again leaves the same file; what failed tasks left is
    removed at the end. shards: as many as shuffle partitions if not given. Rows
    of one id have the same numbers and follow each other, by piece and ids;
    rows without id are numbered by a hash of their text. Other columns are not
    used. No rows: no shard files.

    The ids are shuffled once, by shard, and written; the shards' first slots
    follow from the counts in the manifest. What is collected and broadcast is
    a row per shard.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    low, high, longest = docs.agg(F.min(id_col), F.max(id_col), F.max(size)).first()
    per = (longest or 0) // stride + 1  # a document has no more tokens than bytes, and its end
    low, high = low or 0, high or 0
    wide = (high - low + 2) * per >= 1 << 62  # ids too far apart for numbers of 63 bits: hashes of them
    room = (1 << 62) // per if wide else high - low + 2
    domain = room * per
    span = -(-domain // shards)

    nameless = F.pmod(F.xxhash64(text_col), F.lit(room))
    named = F.pmod(F.xxhash64(id_col), F.lit(room)) if wide else F.col(id_col) - low
    own = F.when(F.col(id_col).isNull(), nameless).otherwise(named)
    pieces = (
        sequences(docs, ranks_path, pattern, stride, end_id, id_col, text_col, own, Order(per, domain, key, span))
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "value", id_col, "piece", "ids")
        .select(id_col, "piece", "n_tokens", "shard", "ids")
    )
    filesystem, root = _place(out_dir)
    filesystem.create_dir(root, recursive=True)
    width = 2 * stride

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _place(out_dir)
        shard, stream, temporary, row = None, None, "", 0

        def finish() -> None:
            if stream is not None:
                stream.close()
                filesystem.move(temporary, f"{root}/shard-{shard:08d}.bin")

        for batch in batches:
            crcs, rows = [], []
            for to, ids in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if to != shard:
                    finish()
                    shard, row = to, 0
                    temporary = f"{root}/_{shard:08d}-{uuid.uuid4().hex}"
                    stream = filesystem.open_output_stream(temporary)
                stream.write(ids)
                rows.append(row)
                crcs.append(zlib.crc32(ids))
                row += 1
            rows = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(rows * width), pa.array(crcs, pa.int64())],
                [id_col, "piece", "n_tokens", "shard", "byte_offset", "ids_crc32"],
            )
        finish()

    kind = docs.schema[id_col].dataType.simpleString()
    written = pieces.mapInArrow(run, f"`{id_col}` {kind}, piece int, n_tokens int, shard bigint, byte_offset bigint, ids_crc32 bigint")
    manifest = materialise(written, "shards")
    for left in filesystem.get_file_info(fs.FileSelector(root)):
        if os.path.basename(left.path).startswith("_"):
            filesystem.delete_file(left.path)
    counts = manifest.groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()
    firsts, n = [], 0
    for r in counts:
        firsts.append([r["shard"], n, r["n"]])
        n += r["n"]
    meta = {"n": n, "stride": stride, "dtype": "<u2", "key": key, "end_id": end_id, "shards": firsts}
    with filesystem.open_output_stream(f"{root}/meta.json") as f:
        f.write(json.dumps(meta).encode())
    starts = spark.createDataFrame([x[:2] for x in firsts], "shard bigint, __first bigint")
    slot = F.col("__first") + F.expr(f"byte_offset div {width}L")
    return manifest.join(F.broadcast(starts), "shard").select(id_col, "piece", "n_tokens", slot.alias("slot"), "shard", "byte_offset", "ids_crc32")


def read_slots(out_dir: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The sequences of the slots from start on, in training order: seeks to start, so a stopped run can go on there."""
    filesystem, root = _place(out_dir)
    with filesystem.open_input_stream(f"{root}/meta.json") as f:
        meta = json.loads(f.read())
    size = 2 * meta["stride"]
    stop = meta["n"] if stop is None else min(stop, meta["n"])
    for shard, first, n in meta["shards"]:
        if start < min(stop, first + n):
            with filesystem.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
                f.seek((start - first) * size)
                upto = min(stop, first + n)
                data = np.frombuffer(f.read((upto - start) * size), meta["dtype"]).reshape(-1, meta["stride"])
            yield from data
            start = upto


def shard_folder(docs: DataFrame) -> str:
    """A new folder for shards in the shared folder of the cluster."""
    return os.path.join(shared_dir(docs.sparkSession), f"token-shards-{uuid.uuid4().hex}")
