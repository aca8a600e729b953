"""Operator 10, best-fit packing by length patterns.

1. Documents become pieces of at most ``limit`` tokens (only longer ones are cut).
2. The histogram of piece lengths, at most ``limit`` numbers, goes to the driver.
3. Patterns of few pieces (one to four lengths that nearly fill a sequence) are enumerated, their
   repeat counts fitted to the histogram by non-negative least squares, and rounded down.
4. The residual histogram is packed best-fit decreasing, whole groups of equal sequences at a time.
5. The plan says for each length which ranks go to which sequence and offset; pieces are ranked
   within their length by salted groups (no task sees all pieces of a length) and look it up.
6. A piece of ``limit`` tokens fills a sequence alone, so it needs no rank: it stays where it is and
   gets a negative number, unique by the task that cut it and its place there.  Only shorter pieces are
   shuffled.

The plan has a size bound by ``limit``, not by the input.  Pieces with their ids are staged once in
the shared folder, since histogram and ranking both read them.

Cases: a null or empty text is one piece with the closing id 0 alone.  Repeated rows are packed as
often as they occur.  An empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common, vocab

LIMIT = 2048
#: Pieces of one length are ranked in groups by a salt; there are so many salts that a group has about
#: SALT_ROWS pieces at most, should all pieces have one length.
SALT_ROWS, LEAST_SALTS = 100_000, 16
#: Bits of a piece's number within the task that cut it.
PLACE_BITS = 36


def _pieces(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, here = vocab.encoder(path), TaskContext.get().partitionId() << PLACE_BITS
        for rows, _, _ in common.text_batches(batches):
            taken, piece, start, length, ids, number = [], [], [], [], [], []
            for at, x in enumerate(tokenizer.ids(rows.column("text").to_pylist())):
                x += b"\0\0\0\0"
                n = len(x) // 4
                # only the first piece is shorter than the limit
                cuts = [0, *range(n % limit or limit, n + 1, limit)] if n > limit else [0, n]
                for k in range(len(cuts) - 1):
                    taken.append(at)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    here += 1
                    number.append(-here if length[-1] == limit else here)
                    ids.append(x[4 * cuts[k] : 4 * cuts[k + 1]])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(taken, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(number, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids", "number"],
            )

    return run


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, number) with ids as little-endian unsigned 32-bit numbers;
    number is unique, negative for pieces of limit tokens and positive for others."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_pieces(tokenizer_path, limit), f"doc_id {id_type}, piece int, start long, length long, ids binary, number long")


def patterns(lengths: np.ndarray, counts: np.ndarray, limit: int, per_length: int = 24) -> np.ndarray:
    """Rows of at most four lengths (0: none), longest first, that fill a sequence or nearly do.

    For each length: alone; with its best partners; and with pairs and triples whose last member
    closes the gap best."""
    have = np.zeros(limit + 1, bool)
    have[lengths] = True
    # the largest present length up to each bound, 0 if none
    fit = np.maximum.accumulate(np.where(have, np.arange(limit + 1), 0))
    common_first = lengths[np.argsort(-counts, kind="stable")]
    found = {(int(a), 0, 0, 0) for a in lengths}
    for a in map(int, lengths):
        room = limit - a
        if (b := int(fit[room])) and b <= a:
            found.add((a, b, 0, 0))
        for b in map(int, common_first[(common_first <= min(a, room))][:per_length]):
            if (c := int(fit[room - b])) and room - b:
                found.add(tuple(sorted((a, b, c), reverse=True)) + (0,))
                for c2 in map(int, common_first[common_first <= room - b][:2]):
                    if (left := room - b - c2) and (d := int(fit[left])):
                        found.add(tuple(sorted((a, b, c2, d), reverse=True)))
    out = np.array(sorted(found), dtype=np.int64)
    full = out.sum(1)
    return out[(full >= limit - max(8, limit // 64)) | (out[:, 1] == 0)]


def fit_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of A x = histogram, A[length, pattern] = pieces of that length.

    Multiplicative updates keep x >= 0; A is only touched through its at most four entries a
    column.  Shorter sequences cost more room, so patterns start in proportion to their filling."""
    size = len(histogram)
    used = rows > 0
    gather = lambda v: (v[rows] * used).sum(1)
    scatter = lambda x: np.bincount(rows[used], weights=np.repeat(x, used.sum(1)), minlength=size)
    target = gather(histogram.astype(float))
    x = np.where(used[:, 1], rows.sum(1).astype(float) / rows.sum(1).max(), 1e-3) * histogram.sum() / max(1, len(rows))
    for _ in range(rounds):
        x *= target / np.maximum(gather(scatter(x)), 1e-12)
    return x


def plan(histogram: dict[int, int], limit: int = LIMIT) -> pd.DataFrame:
    """Which ranks of each length go where.

    Rows (length, first_rank, ranks, first_sequence, offset): the piece of that length with rank
    r in [first_rank, first_rank + ranks) goes to sequence first_sequence + r - first_rank."""
    left = np.zeros(limit + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    next_rank, rows, sequences = np.zeros(limit + 1, np.int64), [], 0

    def place(size: int, n: int, first: int, offset: int) -> None:
        rows.append((size, int(next_rank[size]), n, first, offset))
        next_rank[size] += n
        left[size] -= n

    if left.sum():
        lengths = np.flatnonzero(left)
        table = patterns(lengths, left[lengths], limit)
        x = np.floor(fit_counts(table, left) + 1e-9).astype(np.int64)
        for k in np.lexsort((-x, -table.sum(1))):
            members, each = np.unique(table[k][table[k] > 0], return_counts=True)
            if len(members) == 1 and each[0] == 1 and members[0] < limit:
                continue  # lone pieces wait for the residual step
            n = int(min(x[k], (left[members] // each).min()))
            if n > 0:
                offset = 0
                for size in map(int, table[k][table[k] > 0]):
                    place(size, n, sequences, offset)
                    offset += size
                sequences += n
    # residuals: best-fit decreasing; room[r] holds groups (first sequence, number) with r tokens left
    room: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]
    for size in range(limit, 0, -1):
        r = size
        while left[size]:
            while r <= limit and not room[r]:
                r += 1
            if r > limit:
                # each new sequence takes as many of this length as fit
                fit = limit // size
                whole, rest = divmod(int(left[size]), fit)
                for take, n in ((fit, whole), (rest, 1)):
                    if take and n:
                        for j in range(take):
                            place(size, n, sequences, j * size)
                        room[limit - take * size].append((sequences, n))
                        sequences += n
                break
            first, n = room[r].pop()
            n_now = min(n, int(left[size]))
            place(size, n_now, first, limit - r)
            room[r - size].append((first, n_now))
            if n > n_now:
                room[r].append((first + n_now, n - n_now))
            r = size
    out = pd.DataFrame(rows, columns=["length", "first_rank", "ranks", "first_sequence", "offset"]).astype("int64")
    return out.sort_values(["length", "first_rank"], ignore_index=True)


def _assign(table: pd.DataFrame, limit: int):
    # one key orders (length, first_rank): ranks stay below 2^44, lengths below 2^19
    keys = (table["length"].to_numpy() << 44) + table["first_rank"].to_numpy()
    first_rank, first_sequence, offset = (table[c].to_numpy() for c in ("first_rank", "first_sequence", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            sequence = first_sequence[at] + rank - first_rank[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids")), pa.array(sequence), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): each piece and its place."""
    cut = common.staged(pieces(docs, tokenizer_path, limit, id_col, text_col), "pieces")
    alone = cut.filter("number < 0").select("doc_id", "piece", "start", "length", "ids", F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut.filter("number > 0")
    histogram = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}  # at most limit rows
    salts = max(LEAST_SALTS, -(-sum(histogram.values()) // SALT_ROWS))
    salted = short.withColumn("_salt", F.pmod(F.xxhash64("number"), F.lit(salts)))
    group = Window.partitionBy("length", "_salt")
    # the first rank of each group; the join deals by the groups that the window needs as well
    sizes = salted.groupBy("length", "_salt").count()
    bases = sizes.select(F.col("length"), F.col("_salt"), (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_base"))
    local = F.row_number().over(group.orderBy("number")).cast("long") - 1
    ranked = salted.withColumn("_local", local).join(bases.hint("merge"), ["length", "_salt"]).withColumn("rank", F.col("_base") + F.col("_local"))
    kind = StructType(list(short.drop("number").schema.fields)).add("sequence_id", "long").add("offset", "long")
    placed = ranked.select("doc_id", "piece", "start", "length", "ids", "rank").mapInArrow(_assign(plan(histogram, limit), limit), kind)
    return alone.unionByName(placed)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
