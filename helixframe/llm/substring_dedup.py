"""Operator 8, substring dedup: a count-min prefilter, then exact grouping of repeated windows.

A window is SPAN consecutive words of one document.  Words covered by a window that also starts
earlier (smaller doc_id, or the same document and an earlier start) are removed.

Documents are dealt into chunks by a hash of the row, CHUNK_BYTES of text each; one exchange of the
texts serves all passes.  A chunk's windows are 64-bit hashes.

1. Sketch.  Each chunk counts all its windows in a count-min sketch of ROWS rows of one width: the
   least power of two that is not below the number of bytes of all texts, so about six cells a window.
   A chunk's sketch travels as its non-zero counters (cells in ascending order as packed gaps, and
   which of them are above 1), cut into blocks of cells; the partition sketches are merged by adding
   equal cells of a block.  A chunk gets back one bit for each cell it sent: merged counter 2 or more.
   A window's estimate is its least counter, which is never below its true count.
2. Exact pass.  Only windows estimated at 2 or more travel: of equal ones in a chunk the first, as
   (hash, doc_id, start), dealt out by hash, so a passage that a third of all rows share costs one row
   for each chunk and window, and its windows go to different tasks.  The least (doc_id, start) of a
   hash is the first occurrence; each chunk gets back the hashes that start earlier elsewhere.
3. Cut.  A window is covered if it is not its chunk's first of that hash, or that first is covered.

Cases: a null or empty text has no words and keeps the empty text.  A row with a null doc_id is
compared with nothing and keeps all its words.  Repeated rows of one document do not cover each
other: the same start of the same doc_id is not earlier.  Empty tables give empty results.  Only
doc_id and text are read, and the columns to carry.  Equal 64-bit hashes of different windows are
taken as equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_U = np.uint64
SPAN, ROWS = 20, 2
#: Text of a chunk, which one task holds; a longer document is in a chunk with its like by hash.
CHUNK_BYTES = 6 << 20
#: Cells of a block of the merged sketch, as many windows at most as it has cells.
BLOCK_CELLS = 1 << 22
#: Windows of a bucket of the exact pass, about.
BUCKET_BYTES = 32 << 20


def windows(words: np.ndarray, firsts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start within it) of all windows, in order."""
    counts = np.maximum(np.diff(firsts) - span + 1, 0)
    of = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    return common.gram_hashes(words, span, salt=11)[start + firsts[:-1][of]], of, start


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cell of each window in a row of the sketch; width is a power of two."""
    return common.mix64(hashes + _U(0x9E3779B97F4A7C15 * (2 * row + 1) & 0xFFFFFFFFFFFFFFFF)) & _U(width - 1)


def pack_gaps(x: np.ndarray) -> bytes:
    """Ascending distinct numbers as gaps, seven bits a byte, low ones first."""
    gaps = np.diff(x, prepend=_U(0))
    n = np.maximum(1, -(-np.ceil(np.log2(gaps.astype(float) + 1)).astype(np.int64) // 7))
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(n.max()) if len(n) else 0):
        some = n > k
        more = (n[some] > k + 1).astype(np.uint8) << 7
        out[(ends - n)[some] + k] = ((gaps[some] >> _U(7 * k)) & _U(127)).astype(np.uint8) | more
    return out.tobytes()


def unpack_gaps(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    last = b < 128
    number = np.cumsum(last) - last
    starts = np.flatnonzero(np.concatenate(([True], last[:-1]))) if len(b) else np.zeros(0, np.int64)
    place = np.arange(len(b)) - starts[number]
    gaps = np.zeros(int(last.sum()), _U)
    for k in range(int(place.max()) + 1 if len(b) else 0):
        at = place == k
        gaps[number[at]] |= (b[at] & 127).astype(_U) << _U(7 * k)
    return np.cumsum(gaps, dtype=_U)


def chunk_sketch(hashes: np.ndarray, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, whether the counter is above 1) of a chunk's row, ascending."""
    c, n = np.unique(cells(hashes, row, width), return_counts=True)
    return c, n > 1


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema, strict=True)], schema=schema)


SKETCHES = "block long, chunk long, cells binary, many binary"
_SKETCHES = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("cells", pa.binary()), ("many", pa.binary())])
REPLIES = "block long, chunk long, bits binary"
_REPLIES = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("bits", pa.binary())])
EXACT = "bucket long, chunk long, hashes binary, docs binary, starts binary"
_EXACT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])
COVERED = "chunk long, hashes binary"
_COVERED = pa.schema([("chunk", pa.int64()), ("hashes", pa.binary())])


def _read(texts: pa.Table, span: int) -> tuple[pa.RecordBatch | None, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, hashes, index of the row, start) of a chunk; a row without doc_id has no windows."""
    common.give_back()
    rows = texts.combine_chunks().to_batches()
    if not rows:
        none = np.zeros(0, np.int64)
        return None, none.view(_U), none, none
    hashes, of, start, at = [], [], [], 0
    ids = rows[0].column("doc_id")
    for part, data, offsets in common.text_batches(rows):
        h, o, s = windows(*common.word_hashes(data, offsets), span)
        hashes.append(h), of.append(o + at), start.append(s)
        at += len(part)
    h, o, s = (np.concatenate(x) for x in (hashes, of, start))
    if ids.null_count:
        has = ids.is_valid().to_numpy(zero_copy_only=False)[o]
        h, o, s = h[has], o[has], s[has]
    return rows[0], h, o, s


def _blocks(c: np.ndarray, row: int, width: int) -> Iterator[tuple[int, slice]]:
    """(block, its slice) of ascending cells of a row."""
    per = -(-width // BLOCK_CELLS)
    edges = np.searchsorted(c // _U(BLOCK_CELLS), np.arange(per + 1, dtype=_U))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield row * per + b, slice(int(edges[b]), int(edges[b + 1]))


def _sketch(span: int, width: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, texts: pa.Table) -> pa.Table:
        out, hashes = [], _read(texts, span)[1]
        for row in range(ROWS):
            c, many = chunk_sketch(hashes, row, width)
            out += [(b, key[0].as_py(), pack_gaps(c[z]), np.packbits(many[z]).tobytes()) for b, z in _blocks(c, row, width)]
        return _table(_SKETCHES, out)

    return run


def merge_sketches(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each chunk's (cells, above 1) whether the merged counters are 2 or more."""
    c = np.concatenate([x for x, _ in parts])
    _, at, n = np.unique(c, return_inverse=True, return_counts=True)
    above = n > 1
    above[at[np.concatenate([m for _, m in parts])]] = True
    return np.split(above[at], np.cumsum([len(x) for x, _ in parts])[:-1])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk sketches sorted by block -> for each one bit a cell."""
    block, held = None, []

    def done() -> pa.RecordBatch:
        parts = []
        for _, raw, many in held:
            c = unpack_gaps(raw)
            parts.append((c, np.unpackbits(np.frombuffer(many, np.uint8), count=len(c)).astype(bool)))
        bits = [np.packbits(x).tobytes() for x in merge_sketches(parts)]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(held), pa.int64()), pa.array([k for k, _, _ in held], pa.int64()), pa.array(bits, pa.binary())], schema=_REPLIES)

    for b in batches:
        for key, *part in zip(*(b.column(c).to_pylist() for c in _SKETCHES.names), strict=True):
            if key != block:
                if held:
                    yield done()
                block, held = key, []
            held.append(part)
    if held:
        yield done()


def _first(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by hash, doc_id and start; index of the first of each hash; its number for each place)."""
    order = np.lexsort((starts, docs, hashes))
    h = hashes[order]
    head = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return order, np.flatnonzero(head), np.cumsum(head) - 1


def _exact(span: int, width: int, buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        rows, hashes, of, start = _read(texts, span)
        if rows is None or not len(hashes):
            return _table(_EXACT, [])
        bits = dict(zip(replies.column("block").to_pylist(), replies.column("bits").to_pylist(), strict=True))
        estimated = np.ones(len(hashes), bool)
        for row in range(ROWS):
            c, at = np.unique(cells(hashes, row, width), return_inverse=True)
            above = np.zeros(len(c), bool)
            for b, z in _blocks(c, row, width):
                above[z] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=z.stop - z.start)
            estimated &= above[at]
        docs = rows.column("doc_id").fill_null(0).to_numpy()[of[estimated]]
        h, s = hashes[estimated], start[estimated].astype(np.int32)
        order, first, _ = _first(h, docs, s)
        at = order[first]
        bucket = (h[at] % _U(buckets)).astype(np.int64)
        at, bucket = at[(o := np.argsort(bucket, kind="stable"))], bucket[o]
        heads, bounds = common.runs_by(bucket)
        packed = [common.slices(memoryview(np.ascontiguousarray(x[at]).view(np.uint8)), bounds, n) for x, n in ((h, 8), (docs, 8), (s, 4))] if len(at) else [[]] * 3
        chunk = key[0].as_py()
        return _table(_EXACT, [(b, chunk, *x) for b, *x in zip(bucket[heads].tolist(), *packed, strict=True)])

    return run


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by bucket -> for each chunk its hashes that start earlier elsewhere."""
    bucket, held = None, []

    def done() -> pa.RecordBatch:
        chunk = np.repeat(np.array([k for k, *_ in held], np.int64), [len(h) // 8 for _, h, _, _ in held])
        h, d, s = (np.concatenate([np.frombuffer(x[i], kind) for x in held]) for i, kind in ((1, _U), (2, np.int64), (3, np.int32)))
        order, first, number = _first(h, d, s)
        lead = order[first[number]]
        covered = order[(d[order] != d[lead]) | (s[order] != s[lead])]
        by = covered[np.argsort(chunk[covered], kind="stable")]
        heads, bounds = common.runs_by(chunk[by])
        found = common.slices(memoryview(np.ascontiguousarray(h[by]).view(np.uint8)), bounds, 8) if len(by) else []
        return pa.RecordBatch.from_arrays([pa.array(chunk[by][heads], pa.int64()), pa.array(found, pa.binary())], schema=_COVERED)

    for b in batches:
        for key, *part in zip(*(b.column(c).to_pylist() for c in _EXACT.names), strict=True):
            if key != bucket:
                if held:
                    yield done()
                bucket, held = key, []
            held.append(part)
    if held:
        yield done()


def _cut(span: int, as_is: bool, carry: bool, schema: pa.Schema) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        rows, hashes, of, start = _read(texts, span)
        if rows is None:
            return schema.empty_table()
        elsewhere = np.sort(np.frombuffer(b"".join(replies.column("hashes").to_pylist()), _U))
        docs = rows.column("doc_id").fill_null(0).to_numpy()[of]
        order, first, number = _first(hashes, docs, start)
        lead = order[first[number]] if len(order) else order
        later = (docs[order] != docs[lead]) | (start[order] != start[lead])
        if len(elsewhere):
            near = np.minimum(np.searchsorted(elsewhere, hashes[order]), len(elsewhere) - 1)
            later |= elsewhere[near] == hashes[order]
        covered = np.sort(order[later])  # back in the order of rows and starts
        cut = np.searchsorted(of[covered], np.arange(len(rows) + 1)).tolist()
        n_words, removed, kept = [], [], []
        for i, text in enumerate(rows.column("text").to_pylist()):
            raw = (text or "").encode()
            words = raw.split()
            n_words.append(len(words))
            gone = 0
            if cut[i + 1] > cut[i]:
                drop = np.zeros(len(words) + 1, np.int32)
                at = start[covered[cut[i] : cut[i + 1]]]
                np.add.at(drop, at, 1)
                np.add.at(drop, at + span, -1)
                stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
                gone = len(words) - len(stay)
                words = [words[j] for j in stay]
            removed.append(gone)
            kept.append(raw if as_is and not gone else b" ".join(words))
        columns = [rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays([*columns, *([rows.column("carried")] if carry else [])], names=["doc_id", "n_words", "n_removed", "kept", *(["carried"] if carry else [])])

    return run


def substring_dedup(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: kept are the words that stay, joined by one space.

    carry: further columns of docs to return, in a struct ``carried``.  as_is: texts that lose nothing
    keep their own white space."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 1
    width = max(1 << (size - 1).bit_length(), 1 << 10)
    chunks, buckets = -(-size // CHUNK_BYTES), -(-size // BUCKET_BYTES)
    named = docs.select(doc_id.alias("doc_id"), text.alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    # one exchange of the texts serves all three passes
    dealt = named.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition("chunk")
    texts = dealt.groupBy("chunk")
    sketches = texts.applyInArrow(_sketch(span, width), SKETCHES)
    replies = sketches.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, REPLIES)
    exact = texts.cogroup(replies.groupBy("chunk")).applyInArrow(_exact(span, width, buckets), EXACT)
    covered = exact.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_group, COVERED)
    out = StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept", "string")
    if carry:
        out = out.add(named.schema["carried"])
    return texts.cogroup(covered.groupBy("chunk")).applyInArrow(_cut(span, as_is, bool(carry), to_arrow_schema(out)), out)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(common.documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - {SPAN - 2}, 1))) AS i, w FROM d),
h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(w, i, i + {SPAN - 1}), ' ') ORDER BY doc_id, i) AS k FROM s),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM h, (SELECT unnest(range(0, {SPAN})) AS j) WHERE k > 1),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
g AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
