"""Operator 2, document fingerprints: context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the text; where it hits a multiple of the block size, a
chunk ends.  Each chunk's hash gives one character of the signature.  Block sizes are 3 * 2^k, the
least that keeps a signature within SIGNATURE characters; a fingerprint holds the signatures of
that size and its double, so that texts of up to twice the length can be compared.  Likeness is
1 - d / (m + n) for the insert-delete edit distance d of signatures of equal block size, the best
of the sizes two fingerprints share; 0 if they share no run of COMMON characters.

Edited texts need each document's successor by descending doc_id.  Documents are dealt into ranges
of ids whose borders are quantiles of all ids; the highest document of a range also goes to the
range above as the successor of its last row.  So each text is shuffled once, and no task sees more
than a range.

Cases: a null text counts as empty; the empty text has the fingerprint "3::", and two empty texts
are alike by 1.  Repeated doc_ids follow each other in the order of their texts.  A null doc_id
comes after all others.  One row alone is its own successor.  An empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SIGNATURE, COMMON, LEAST_BLOCK = 7, 64, 4, 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Documents of one id range; borders are approximate quantiles.  Beyond MAX_RANGES ranges get longer:
#: they are sorted by Spark and streamed, never held.
RANGE_ROWS = 4_000
MAX_RANGES = 65_536


def rolling(data: np.ndarray) -> np.ndarray:
    """32-bit hash of the WINDOW bytes that end at each position: their sum, their sum weighted by
    recency, and a shifted exclusive-or, added up."""
    n = len(data)
    x = np.zeros(n + WINDOW - 1, np.uint32)
    x[WINDOW - 1 :] = data
    total, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
    for age in range(WINDOW):
        past = x[WINDOW - 1 - age : n + WINDOW - 1 - age]
        total += past
        weighted += past * np.uint32(WINDOW - age)
        shifted ^= past << np.uint32(5 * age) if 5 * age < 32 else np.uint32(0)
    return total + weighted + shifted


def _signature(raw: bytes, ends: np.ndarray) -> str:
    """One character for each chunk; at most SIGNATURE, the last one taking the rest."""
    cuts = [0, *(ends[: SIGNATURE - 1] + 1).tolist()]
    if cuts[-1] < len(raw):
        cuts.append(len(raw))
    view = memoryview(raw)
    return "".join([ALPHABET[xxhash.xxh64_intdigest(view[a:b]) & 63] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def fingerprint(raw: bytes) -> str:
    """'block size:signature:signature at double block size' of a text's bytes."""
    hashes = rolling(np.frombuffer(raw, np.uint8)) + np.uint32(1)
    block = LEAST_BLOCK
    while block * SIGNATURE < len(raw):
        block *= 2
    while True:
        ends = np.flatnonzero(hashes % np.uint32(block) == 0)
        if len(ends) >= SIGNATURE // 2 or block == LEAST_BLOCK:
            break
        block //= 2  # too few chunks: finer
    return f"{block}:{_signature(raw, ends)}:{_signature(raw, ends[hashes[ends] % np.uint32(2 * block) == 0])}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, all cells of a row in one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & mask
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    k = min(COMMON, len(a), len(b))
    if not k or not {a[i : i + k] for i in range(len(a) - k + 1)}.intersection(b[i : i + k] for i in range(len(b) - k + 1)):
        return 0.0
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """Likeness of two fingerprints, from 0 to 1; 1 for equal ones."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        return max(_alike(x1, y1), _alike(x2, y2))
    if bx == 2 * by:
        return _alike(x1, y2)
    return _alike(x2, y1) if by == 2 * bx else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by as many first ones of the next text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and order within it -> one row for each but the borrowed ones."""
    held = None  # (range, doc_id, text, fingerprint) of a row that waits for its successor
    out: list[tuple] = []

    def close(following: str, print_next: str) -> None:
        _, doc, text, own = held
        changed = edited(text, following).encode()
        after = fingerprint(changed)
        out.append((doc, len(text), hashlib.sha256(changed).hexdigest(), own, after, likeness(own, after), likeness(own, print_next)))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        columns = list(zip(*out, strict=True)) or [()] * 7
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for b in batches:
        for part, borrowed, doc, text in zip(*(b.column(c).to_pylist() for c in ("part", "borrowed", "doc_id", "text")), strict=True):
            if borrowed and (held is None or held[0] != part):
                continue  # further rows of the borrowed id
            own = fingerprint(text.encode())
            if held is not None:
                close(text, own)
            held = None if borrowed else (part, doc, text, own)
        if len(out) >= 1000:
            yield flush()
    yield flush()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # ascending place: null first, so that it comes last in descending order
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("at"))
    ids = named.select(place["at"].alias("at"))
    n = ids.count()
    ranges = min(MAX_RANGES, max(1, -(-n // RANGE_ROWS)))
    borders: list[int] = []
    if ranges > 1:
        found = ids.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("b")).first()["b"]
        borders = sorted(set(found))
    # part 0 holds the largest ids: number of borders above a place
    part = _part(borders)(F.col("at")) if borders else F.lit(0)
    dealt = named.withColumn("at", place["at"]).withColumn("part", part.cast("int"))
    heads = dealt.groupBy("part").agg(F.max("at").alias("head"))
    # the head of each range is the successor of the last row of the range before (the last of all:
    # of the first); ranges without rows have no head, so neighbours are taken among the present
    rows = sorted(heads.collect())  # one row for each range: at most MAX_RANGES
    present = [r["part"] for r in rows]
    before = {r["head"]: present[i - 1] for i, r in enumerate(rows)}
    link = dealt.sparkSession.createDataFrame(sorted(before.items()), "head long, goes_to int")
    own = dealt.select("part", F.lit(False).alias("borrowed"), "at", "doc_id", "text")
    lent = dealt.join(F.broadcast(link), dealt["at"] == link["head"]).select(F.col("goes_to").alias("part"), F.lit(True).alias("borrowed"), "at", "doc_id", "text")
    ordered = own.union(lent).repartition("part").sortWithinPartitions("part", "borrowed", F.desc("at"), "text")
    return ordered.select("part", "borrowed", "doc_id", "text").mapInArrow(
        _fingerprints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _part(borders: list[int]):
    ascending = np.array(borders, np.int64)

    @F.pandas_udf("int")
    def part(at: pd.Series) -> pd.Series:
        return pd.Series(len(ascending) - np.searchsorted(ascending, at.to_numpy(), side="right"))

    return part


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))
