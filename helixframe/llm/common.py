"""Shared pieces of the training-data operators: inputs, staging, Arrow batches, word hashing.

Words are maximal runs of bytes other than space and \\x09-\\x0D, found on UTF-8 bytes, so no
Unicode rule applies.  Hashing is vectorised over whole Arrow buffers: no Python call per word.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled by one vectorised step; a longer document is a step of its own.
STEP_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MULT = 0x9E3779B97F4A7C15 | 1
_MULT_INV = pow(_MULT, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see: below spark.checkpoint.dir.

    Only in local mode (tests) may that setting be absent: then a folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "helixframe-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def give_back() -> None:
    """Return free memory to the system: workers outlive their tasks, and several share a machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def discard(df: DataFrame) -> None:
    """Delete the folder of a staged frame that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most STEP_BYTES of text (one row at least), with the column's
    bytes and offsets as numpy views.  A null text has no bytes."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = col.fill_null("")
        if pa.types.is_large_string(col.type):
            offsets_type = np.int64
        else:
            col, offsets_type = col.cast(pa.string()), np.int32
        n = len(col)
        if not n:
            continue
        _, raw_offsets, raw_data = col.buffers()
        offsets = np.frombuffer(raw_offsets, dtype=offsets_type)[col.offset : col.offset + n + 1].astype(np.int64)
        data = np.frombuffer(raw_data, dtype=np.uint8) if raw_data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1
            end = min(max(end, at + 1), n)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, extended on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, m in (("up", _MULT), ("down", _MULT_INV)):
                    a = np.full(size, m, _U)
                    a[0] = 1
                    setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (bijective) over uint64."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix64(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    if lower:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


_CODES = {False: _byte_codes(False), True: _byte_codes(True)}


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; a document's border also ends a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = border[:n].copy()
    before[1:] |= space[:-1]
    before[0] = True
    after = border[1:].copy()
    after[:-1] |= space[1:]
    after[-1] = True
    word = ~space
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of the first word of each document and the total).

    The hash is a polynomial over random byte codes modulo 2^64 from one prefix sum, then mixed."""
    starts, ends = word_spans(data, offsets)
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, _U), firsts
    up, down = _POWERS.get(len(data))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_CODES[lower][data] * up, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F)), firsts


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of each run of k consecutive words (over all documents; the caller masks runs
    that cross a document's border)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, (salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, _U)
    for j in range(k):
        out += words[j : j + n] * _U((0x2545F4914F6CDD1D * (2 * j + 1) + 2 * salt) & 0xFFFFFFFFFFFFFFFF | 1)
        out ^= out >> _U(29)
    return mix64(out)


def runs_by(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each run of equal neighbours, and the number of all): bounds of sorted keys."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return first, np.append(first, n)


def slices(raw: bytes | memoryview, bounds: np.ndarray, width: int) -> list[bytes]:
    """raw cut at bounds (numbers of items of a width)."""
    at = (bounds * width).tolist()
    return [bytes(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
