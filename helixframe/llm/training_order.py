"""Operator 6, training-order materialisation: token ids in fixed-stride shards, in a keyed order.

Every document is cut into sequences of at most SEQUENCE ids, and one keyed Feistel permutation with
cycle-walking over the whole table decides where each goes:

1. Places.  A text of b bytes has at most b ids and a closing one, so it reserves as many places as
   that makes sequences.  Reserved places are summed up by input partition in the JVM (one number
   each); a task adds the reservations of its own rows, so every sequence of the table has a place of
   its own in range(P), P being the sum of all.
2. Order.  The permutation of range(P) sends each place to its rank in the training order; reserved
   places without a sequence leave gaps.
3. Shards.  Equal ranges of ranks are shards; each is sorted by rank and written as a stream.  The
   global slot of a sequence is its place among the sequences that exist: those of the shards before
   and those before it in its shard.

Texts are read twice and tokenised once; only ids are shuffled, and nothing but the manifest is
staged.  The order is a function of the key and of the input's partitions alone, so a lost task
writes the same file again.  Input partitions must hold the same rows each time they are read, as
those of files do; a task whose rows reserve other numbers than were summed up fails.  Stage frames
that come from a shuffle first.

A shard is a file of records of one stride: doc_id (int64), piece (int32), length (int32), then
SEQUENCE ids (uint16 where the vocabulary allows, else uint32; zeros behind the length).  Slot s of
shard k lies at byte s * stride: readers seek to any slot and go on from there, in the shards after
it too.

Cases: a null or empty text is one sequence of the closing id alone.  A null doc_id is stored as the
least int64.  Repeated rows are stored as often as they occur.  An empty table writes no shard.
Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vocab

SEQUENCE, KEY = 256, 0x5EED
#: Ranks of a shard; about a quarter of them hold a sequence where an id has four bytes.
SHARD_RANKS = 65_536
ROUNDS = 6
_U = np.uint64


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Keyed permutation of range(n) at the places x: a balanced Feistel network on the least even
    number of bits that holds n; values beyond n walk on until they fall inside."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, shift = _U((1 << half) - 1), _U(half)
    keys = common.mix64(np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(key & 0xFFFFFFFFFFFFFFFF))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys:
            left, right = right, left ^ (common.mix64(right + k) & mask)
        return left << shift | right

    out = once(x.astype(_U))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def record_type(sequence: int, wide: bool) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("length", "<i4"), ("ids", "<u4" if wide else "<u2", (sequence,))])


def _sequences(path: str, sequence: int, wide: bool, ranges: Broadcast, total: int, key: int):
    """Rows (doc_id, piece, rank, ids); ranges: partitions, their first places and numbers of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, at, end = vocab.encoder(path), None, None
        for rows, _, offsets in common.text_batches(batches):
            if at is None:
                parts, first, n = ranges.value
                here = int(np.searchsorted(parts, rows.column("part")[0].as_py()))
                at, end = int(first[here]), int(first[here] + n[here])
            taken, piece, ids, place = [], [], [], []
            reserved = (-(-(np.diff(offsets) + 1) // sequence)).tolist()
            for i, x in enumerate(tokenizer.ids(rows.column("text").to_pylist())):
                a = np.frombuffer(x + b"\0\0\0\0", "<u4")
                if not wide and a.max() >= 1 << 16:
                    raise ValueError("ids beyond 16 bits need wide=True")
                size, raw = (4, a.tobytes()) if wide else (2, a.astype("<u2").tobytes())
                for k, cut in enumerate(range(0, len(raw), size * sequence)):
                    taken.append(i)
                    piece.append(k)
                    place.append(at + k)
                    ids.append(raw[cut : cut + size * sequence])
                if piece[-1] >= reserved[i]:
                    raise ValueError("a text has more ids than bytes")
                at += reserved[i]
            if at > end:
                raise ValueError("the partition holds other rows than when it was counted: stage the input first")
            rank = feistel(np.array(place, np.int64), total, key)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(taken, pa.int64())), pa.array(piece, pa.int32()), pa.array(rank), pa.array(ids, pa.binary())], ["doc_id", "piece", "rank", "ids"])
        if at != end:
            raise ValueError("the partition holds other rows than when it was counted: stage the input first")

    return run


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write(folder: str, sequence: int, wide: bool):
    """Rows sorted by shard and rank -> the shard files, and for each record its place."""
    kind = record_type(sequence, wide)
    stride, item = kind.itemsize, kind["ids"].base.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, slot, part, out = None, 0, "", None
        store, path = _store(folder)

        def close() -> None:
            # a task that is tried again writes the same bytes; the move makes them visible
            out.close()
            store.move(part, f"{path}/shard-{shard:08d}.bin")

        for b in batches:
            column = b.column("shard").to_numpy()
            heads, bounds = common.runs_by(column)
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rows, n = b.slice(begin, end - begin), end - begin
                if column[begin] != shard:
                    if out is not None:
                        close()
                    shard, slot = int(column[begin]), 0
                    store.create_dir(path, recursive=True)
                    part = f"{path}/.{shard:08d}-{np.random.SeedSequence().entropy:x}"
                    out = store.open_output_stream(part)
                raw = rows.column("ids").to_pylist()
                length = np.fromiter(map(len, raw), np.int64, n) // item
                records = np.zeros(n, kind)
                records["doc_id"], records["piece"], records["length"] = rows.column("doc_id").to_numpy(), rows.column("piece").to_numpy(), length
                ids = np.frombuffer(b"".join(raw), kind["ids"].base)
                first = np.repeat(np.cumsum(length) - length, length)
                records["ids"][np.repeat(np.arange(n), length), np.arange(len(ids)) - first] = ids
                written = records.tobytes()
                out.write(written)
                slots = slot + np.arange(n)
                slot += n
                crc = [zlib.crc32(written[x : x + stride]) for x in range(0, len(written), stride)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("piece"), pa.array(length), pa.array(column[begin:end]), pa.array(slots), pa.array(slots * stride), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "length", "shard", "shard_slot", "byte_offset", "record_crc32"],
                )
        if out is not None:
            close()

    return run


def materialise(docs: DataFrame, tokenizer_path: str, folder: str, sequence: int = SEQUENCE, key: int = KEY, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below folder (a store that all executors reach); returns the manifest
    (doc_id, piece, length, shard, shard_slot, byte_offset, record_crc32, slot), slot being global.

    wide: store ids as uint32, for vocabularies of more than 65,536."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), text.alias("text"), F.spark_partition_id().alias("part"))
    reserved = F.ceil((F.octet_length("text") + 1) / sequence)
    sums = sorted((r["part"], r["n"]) for r in named.groupBy("part").agg(F.sum(reserved).alias("n")).collect())  # one number for each input partition
    parts, sizes = np.array([p for p, _ in sums], np.int64), np.array([n for _, n in sums], np.int64)
    total = int(sizes.sum())
    kind = "doc_id long, piece int, length long, shard long, shard_slot long, byte_offset long, record_crc32 long"
    if not total:
        return docs.sparkSession.createDataFrame([], f"{kind}, slot long")
    ranges = docs.sparkSession.sparkContext.broadcast((parts, np.cumsum(sizes) - sizes, sizes))  # three numbers a partition
    cut = named.mapInArrow(_sequences(tokenizer_path, sequence, wide, ranges, total, key), "doc_id long, piece int, rank long, ids binary")
    ordered = cut.withColumn("shard", F.expr(f"rank div {SHARD_RANKS}")).repartition("shard").sortWithinPartitions("shard", "rank")
    manifest = common.staged(ordered.mapInArrow(_write(folder, sequence, wide), kind), "manifest")
    counts = manifest.groupBy("shard").count()  # one row for each shard
    first = counts.select("shard", (F.sum("count").over(Window.orderBy("shard")) - F.col("count")).alias("first"))
    return manifest.join(first, "shard").withColumn("slot", F.col("first") + F.col("shard_slot")).drop("first").select(*manifest.columns, "slot")


def read_from(folder: str, shard: int, slot: int = 0, sequence: int = SEQUENCE, wide: bool = False) -> np.ndarray:
    """Records of a shard from a slot on: one seek, then one sequential read."""
    kind = record_type(sequence, wide)
    store, path = _store(folder)
    with store.open_input_file(f"{path}/shard-{shard:08d}.bin") as f:
        f.seek(slot * kind.itemsize)
        return np.frombuffer(f.read(), kind)


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "shards")
    return materialise(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
