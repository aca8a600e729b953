"""Operator 1, n-gram Jaccard join: T-occurrence search over inverted lists with DivideSkip.

1. Every text becomes its set of 64-bit shingle hashes; documents of equal sets form a class
   (copies are never compared with each other).  All steps are keyed by class, doc_ids come in last.
2. Blocking without loss: sets of nearly equal size whose Jaccard similarity reaches the threshold
   differ in at most H shingles, so of P > H parts of the hash space some part is equal in both.
   Each class emits one signature per part; they travel packed, several bytes each, and only those that
   classes share go on.  Classes that share a signature are candidates; a parity
   bitmap of each set bounds the number of shingles in which two sets differ from below, and
   candidates that this bound allows fall into one block (connected components).  So documents that
   share a passage but are not alike stay apart.
3. In each block an inverted index from shingle to documents answers a T-occurrence search for each
   document: the L longest lists are set aside, the short ones heap-merged with skips for documents
   of at least T - L occurrences, those binary-probed in the long lists, and kept if the exact
   overlap reaches the threshold.  Documents are searched against the leaders (documents without a
   link to an earlier leader); then, if a block still has several components, all documents outside
   its largest component are searched against the whole block.  So no link between components is
   lost, and a group of m near copies takes about m searches of a small index.
4. Blocks beyond MAX_BLOCK shingles are cut into slices by document, each searched by itself.  Of each
   slice the first of its largest component stands for it: those are searched in turn, cut again
   where they are too many.  What is then outside its block's largest component is held, in slices,
   against all slices of the block.  So no link between components is lost, and a family of m near
   copies takes about m searches however many slices it has.

A part that is empty in both sets agrees without a signature.  P leaves room for some; a document
with more empty parts also emits the shingles of its prefix (the least hashes of which two such
documents must share one), which keeps the blocking exact.

Cases: a null or empty text, or one without words, has no shingles and links with nothing.  A text
of fewer than k words has its whole sequence as one shingle.  Repeated rows give one row each, and so
do rows that repeat a doc_id with another text; each has the component of its own text.  A row with a null doc_id links with nothing and has a null component.  Empty tables give
empty results; only doc_id and text are read.  Equal 64-bit hashes of different shingles are taken
as equal (about n^2 / 2^65 for n distinct shingles of two documents under comparison), and so are
sets of equal 64-bit digests.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

_U = np.uint64
#: Shingles of a block that one task indexes (8 bytes each, and about twice that for the index).
MAX_BLOCK = 4_000_000
#: Signatures that a map task gathers before it emits them, packed by bucket.
EMIT_ROWS = 2_000_000
#: A bucket of signatures, which one task sorts, holds about so many; at first there are more buckets
#: of fewer, so that small inputs are spread too.
BUCKET_ROWS, FIRST_ROWS, FIRST_BUCKETS = 4_000_000, 250_000, 4_096
MARK_BYTES = 5
#: Weight of a probe against a heap step in the choice of L.
MU = 0.0085


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds): document i has the sorted distinct hashes shingles[bounds[i]:bounds[i+1]]."""
    words, firsts = common.word_hashes(data, offsets, lower)
    grams = common.gram_hashes(words, k)
    sets = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            sets.append(common.gram_hashes(words[a:b], b - a, salt=b - a) if b > a else grams[:0])
    bounds = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else grams[:0]), bounds


class Blocking:
    """Signatures of shingle sets for a threshold in percent."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        # sizes [low[i], low[i+1]) form class i; a set's partners lie in its own or the next classes
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low, np.int64)
        most = self.low[1:] - 1
        differ = 2 * most * (100 - percent) // (100 + percent)
        spare = np.where(differ > 0, 1 + differ // 50, 0)
        self.differ, self.parts = differ, differ + 1 + spare

    def signatures(self, shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, document) pairs."""
        sizes = np.diff(bounds)
        docs = np.flatnonzero(sizes)
        if not len(docs):
            return np.zeros(0, _U), np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        mixed, high = common.mix64(shingles ^ _U(0x5851F42D4C957F2D)), shingles >> _U(32)
        at = np.zeros(len(sizes), np.int64)
        at[docs] = np.searchsorted(self.low, sizes[docs], side="right") - 1
        out, open_docs = [], np.zeros(len(sizes), bool)
        for step in (0, 1):
            scheme = at + step
            parts = np.where(sizes > 0, self.parts[scheme], 0)
            first = np.cumsum(parts) - parts
            part = ((high * parts[owner].astype(_U)) >> _U(32)).astype(np.int64)
            group = first[owner] + part
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            of = owner[starts]
            code = (scheme[of] << 40) + part[starts]
            out.append((common.mix64(np.add.reduceat(mixed, starts) ^ common.mix64(code.astype(_U) + _U(1))), of))
            empty = parts - np.bincount(of, minlength=len(sizes))
            open_docs |= empty > parts - self.differ[scheme] - 1
        for d in np.flatnonzero(open_docs & (sizes > 0)).tolist():
            n = int(sizes[d])
            prefix = shingles[bounds[d] : bounds[d] + n - -(-self.percent * n // 100) + 1]
            out.append((common.mix64(prefix + _U(0x632BE59BD9B4E019)), np.full(len(prefix), d)))
        return np.concatenate([s for s, _ in out]), np.concatenate([d for _, d in out])


class Index:
    """Inverted lists from shingle number to documents in ascending order, for T-occurrence search."""

    def __init__(self, sizes: list[int], n_shingles: int, percent: int) -> None:
        self.sizes, self.percent = sizes, percent
        self.lists: list[list[int] | None] = [None] * n_shingles

    def add(self, doc: int, shingles: Iterable[int]) -> None:
        lists = self.lists
        for s in shingles:
            if lists[s] is None:
                lists[s] = [doc]
            else:
                lists[s].append(doc)

    def search(self, size: int, shingles: Iterable[int], skip: int = -1) -> list[int]:
        """Indexed documents whose similarity to a set of that size reaches the threshold."""
        percent, sizes = self.percent, self.sizes
        need = max(1, -(-percent * size // 100))
        found = [x for x in map(self.lists.__getitem__, shingles) if x]
        if len(found) < need:
            return []
        found.sort(key=len, reverse=True)
        n_long = min(need - 1, int(need / (MU * log2(max(2, len(found[0]))) + 1)))
        long, short = found[:n_long], found[n_long:]
        out = []
        for doc, overlap in merge_skip(short, need - n_long):
            other = sizes[doc]
            if doc == skip or 100 * min(size, other) < percent * max(size, other):
                continue
            least = -(-percent * (size + other) // (100 + percent))
            left = len(long)
            for x in long:
                if overlap + left < least:
                    break
                left -= 1
                p = bisect_left(x, doc)
                overlap += p < len(x) and x[p] == doc
            if overlap >= least:
                out.append(doc)
        return out


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(document, occurrences) of those in at least `need` of the sorted lists, by a heap that skips."""
    heap = [(x[0], j) for j, x in enumerate(lists)]
    heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= need:
        doc = heap[0][0]
        popped = []
        while heap and heap[0][0] == doc:
            popped.append(heappop(heap)[1])
        if len(popped) >= need:
            yield doc, len(popped)
            for j in popped:
                at[j] += 1
                if at[j] < len(lists[j]):
                    heappush(heap, (lists[j][at[j]], j))
            continue
        # fewer than `need` lists hold documents before the next candidate: skip to it
        while heap and len(popped) < need - 1:
            popped.append(heappop(heap)[1])
        if not heap:
            return
        goal = heap[0][0]
        for j in popped:
            at[j] = bisect_left(lists[j], goal, at[j])
            if at[j] < len(lists[j]):
                heappush(heap, (lists[j][at[j]], j))


def link_block(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set of a block the position of the first one of its component."""
    n = len(sets)
    sizes = list(map(len, sets))
    _, numbers, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[numbers] > 1  # others are in one set only and match nothing
    ends = np.cumsum(sizes)
    live = [numbers[e - s : e][shared[e - s : e]] for e, s in zip(ends, sizes, strict=True)]
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(x: int, y: int) -> None:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)

    leaders, followers = Index(sizes, len(times), percent), 0
    for q in range(n):
        mine = live[q].tolist()
        found = leaders.search(sizes[q], mine)
        for d in found:
            join(q, d)
        if found:
            followers += 1
        else:
            leaders.add(q, mine)
    if followers:
        # leaders are compared with each other; what is left are links of followers
        of = np.array([find(x) for x in range(n)])
        labels, members = np.unique(of, return_counts=True)
        if len(labels) > 1:
            rest = np.flatnonzero(of != labels[members.argmax()]).tolist()
            whole = Index(sizes, len(times), percent)
            for d in range(n):
                whole.add(d, live[d].tolist())
            for q in rest:
                for d in whole.search(sizes[q], live[q].tolist(), q):
                    join(q, d)
    return [find(x) for x in range(n)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _class_of(digest: bytes | None) -> int:
    """Number of a class of equal sets: 64 bits of the set's digest."""
    return int.from_bytes(digest[:8], "little", signed=True) if digest else 0


def _digests(shingles: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    raw, cut = memoryview(shingles.view(np.uint8)), (8 * bounds).tolist()
    return [xxhash.xxh3_128_digest(raw[a:b]) if b > a else None for a, b in zip(cut[:-1], cut[1:], strict=True)]


def parities(shingles: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """For each set a bitmap of at least as many bits as shingles (a power of two, 64 at least): bit i
    is the parity of the number of hashes that are i modulo the size.  Bitmaps of two sets differ in
    at most as many bits as the sets differ in shingles."""
    sizes = np.diff(bounds)
    bits = np.where(sizes > 64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 64)
    first = np.cumsum(np.where(sizes > 0, bits, 0)) - np.where(sizes > 0, bits, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = first[owner] + (shingles & (bits[owner] - 1).astype(_U)).astype(np.int64)
    odd = np.bincount(at, minlength=int(first[-1] + bits[-1]) if len(sizes) else 0) & 1
    raw = np.packbits(odd.astype(np.uint8)).tobytes()
    return [raw[a // 8 : (a + b) // 8] if n else None for a, b, n in zip(first.tolist(), bits.tolist(), sizes.tolist(), strict=True)]


def near_clusters(sizes: np.ndarray, bitmaps: list[bytes], percent: int) -> list[int]:
    """For each set the first of its cluster: sets whose bitmaps allow a link are in one cluster.

    Sets that can be linked differ by less than twice in size, so their bitmaps have one length or
    neighbouring ones: each length is clustered with the next, and what meets is joined."""
    lengths = np.array(list(map(len, bitmaps)))
    kinds = np.unique(lengths).tolist()
    if len(kinds) == 1 or kinds == [kinds[0], 2 * kinds[0]]:
        return _near_level(sizes, bitmaps, percent).tolist()
    root = np.arange(len(sizes))
    for kind in kinds:
        of = np.flatnonzero((lengths == kind) | (lengths == 2 * kind))
        found = of[_near_level(sizes[of], [bitmaps[i] for i in of.tolist()], percent)]
        for i, j in zip(of.tolist(), found.tolist(), strict=True):
            if root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
    return root.tolist()


def _near_level(sizes: np.ndarray, bitmaps: list[bytes], percent: int) -> np.ndarray:
    """near_clusters at the least length of the bitmaps.

    As in a block, leaders take followers first; then all outside the largest cluster are held
    against all, so that no pair that may be linked is parted."""
    least = min(map(len, bitmaps))
    maps = np.empty((len(bitmaps), least // 8), np.uint64)
    for i, b in enumerate(bitmaps):
        x = np.frombuffer(b, np.uint64)
        while len(x) * 8 > least:  # bit i modulo half the size: fold the halves
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        maps[i] = x

    def allowed(i: int, others: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(maps[others] ^ maps[i]).sum(1, dtype=np.int64)
        a, b = sizes[i], sizes[others]
        return (differ <= (a + b) * (100 - percent) // (100 + percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))

    n = len(sizes)
    root, left = np.arange(n), np.arange(n)
    while len(left):
        head, left = left[0], left[1:]
        near = allowed(head, left)
        root[left[near]] = head
        left = left[~near]
    labels, members = np.unique(root, return_counts=True)
    if len(labels) > 1 and n > 2:
        for i in np.flatnonzero(root != labels[members.argmax()]).tolist():
            met = np.unique(root[np.flatnonzero(allowed(i, np.arange(n)))])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    return root


def _cluster(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, classes, sizes, maps, edges = None, [], [], [], set()

        def done() -> None:
            if len(classes) > 1 and not (len(classes) == 2 and (classes[1], classes[0]) in edges):
                for c, r in zip(classes, near_clusters(np.array(sizes), maps, percent), strict=True):
                    if c != classes[r]:
                        edges.add((c, classes[r]))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], ["a", "b"])

        for b in batches:
            for s, c, n, m in zip(*(b.column(x).to_pylist() for x in ("signature", "class_id", "n", "parity")), strict=True):
                if s != key:
                    done()
                    key, classes, sizes, maps = s, [], [], []
                classes.append(c)
                sizes.append(n)
                maps.append(m)
            if len(edges) > 100_000:
                yield out()
                edges.clear()
        done()
        yield out()

    return run


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.text_batches(batches):
            shingles, bounds = shingle_sets(data, offsets, k)
            digests = _digests(shingles, bounds)
            parity = pa.array(parities(shingles, bounds), pa.binary())
            classes = pa.array([_class_of(d) if d else None for d in digests], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row_key"), pa.array(np.diff(bounds)), classes, parity], ["doc_id", "row_key", "n_shingles", "class_id", "parity"])

    return run


def _sign(k: int, percent: int, buckets: int):
    """Packed signatures: rows (bucket, owners, counts, marks), owners[i] having the next counts[i]
    of the marks, the low 40 bits of signatures that fall into the bucket.  A mark stands for its
    signature: should two of one bucket coincide, a candidate more is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocking, seen, held, rows_held = Blocking(percent), set(), [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            s, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            bucket = ((s >> _U(32)) % _U(buckets)).astype(np.int64)
            order = np.lexsort((c, bucket))
            s, c, bucket = s[order], c[order], bucket[order]
            head = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (c[1:] != c[:-1])))
            first = np.flatnonzero(head)
            counts = np.diff(np.append(first, len(s))).astype(np.uint32)
            marks = mix_marks(s)
            per, bounds = common.runs_by(bucket[first])
            owners, sizes = common.slices(memoryview(c[first].view(np.uint8)), bounds, 8), common.slices(memoryview(counts.view(np.uint8)), bounds, 4)
            packed = common.slices(memoryview(marks), np.append(first[per], len(s)), MARK_BYTES)
            for at in range(0, len(per), 2_000):
                z = slice(at, at + 2_000)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first[per[z]]]), *(pa.array(x[z], pa.binary()) for x in (owners, sizes, packed))], ["bucket", "owners", "counts", "marks"])

        for _, data, offsets in common.text_batches(batches):
            shingles, bounds = shingle_sets(data, offsets, k)
            classes = np.array([_class_of(d) for d in _digests(shingles, bounds)], np.int64)
            new = []  # copies within a task sign once
            for i, c in enumerate(classes.tolist()):
                if bounds[i + 1] > bounds[i] and c not in seen:
                    seen.add(c)
                    new.append(i)
            if not new:
                continue
            if len(new) < len(classes):
                shingles = np.concatenate([shingles[bounds[i] : bounds[i + 1]] for i in new])
                bounds = np.cumsum([0, *(int(bounds[i + 1] - bounds[i]) for i in new)])
                classes = classes[new]
            s, d = blocking.signatures(shingles, bounds)
            held.append((s, classes[d]))
            rows_held += len(s)
            if rows_held >= EMIT_ROWS:
                yield from emit()
                held, rows_held = [], 0
        if held:
            yield from emit()

    return run


def mix_marks(s: np.ndarray) -> np.ndarray:
    """The low MARK_BYTES bytes of each number, one after another."""
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :MARK_BYTES]).ravel()


def _wide(marks: bytes) -> np.ndarray:
    x = np.zeros((len(marks) // MARK_BYTES, 8), np.uint8)
    x[:, :MARK_BYTES] = np.frombuffer(marks, np.uint8).reshape(-1, MARK_BYTES)
    return x.view("<u8").ravel()


def repeated(marks: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, owner): owners that share a mark, each once a mark; of marks with the same set of
    owners one is enough."""
    order = np.lexsort((owners, marks))
    m, c = marks[order], owners[order]
    new = np.concatenate(([True], (m[1:] != m[:-1]) | (c[1:] != c[:-1])))
    m, c = m[new], c[new]
    first, bounds = common.runs_by(m)
    sizes = np.diff(bounds)
    mixed = common.mix64(c.view(_U))
    names = np.stack([np.add.reduceat(mixed, first), np.bitwise_xor.reduceat(common.mix64(mixed + _U(1)), first), sizes.astype(_U)], 1)
    many = np.flatnonzero(sizes > 1)
    if not len(many):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, keep = np.unique(names[many], axis=0, return_index=True)
    keep = np.sort(many[keep])
    group = np.repeat(np.arange(len(keep)), sizes[keep])
    at = np.repeat(first[keep] - (np.cumsum(sizes[keep]) - sizes[keep]), sizes[keep]) + np.arange(len(group))
    return m[first[keep]].view(np.int64)[group], c[at]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed signatures sorted by bucket -> (signature, class_id) of those that classes share."""
    key, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        marks = np.concatenate([_wide(m) for _, _, m in held])
        owners = np.concatenate([np.repeat(np.frombuffer(o, np.int64), np.frombuffer(n, np.uint32)) for o, n, _ in held])
        group, owner = repeated(marks, owners)
        name = common.mix64(group.view(_U) ^ common.mix64(np.full(len(group), key, _U))).view(np.int64)
        for at in range(0, len(name), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(name[at : at + 100_000]), pa.array(owner[at : at + 100_000])], ["signature", "class_id"])

    for b in batches:
        for bucket, *parts in zip(*(b.column(c).to_pylist() for c in ("bucket", "owners", "counts", "marks")), strict=True):
            if bucket != key:
                if held:
                    yield from done()
                key, held = bucket, []
            held.append(parts)
    if held:
        yield from done()


def _reshingle(k: int):
    """Texts of a class's first doc_id -> the class with its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.text_batches(batches):
            shingles, bounds = shingle_sets(data, offsets, k)
            classes, wanted = [_class_of(d) for d in _digests(shingles, bounds)], rows.column("class_id").to_pylist()
            # a doc_id may repeat with another text: only the text of the wanted class goes on
            keep = pa.array([i for i, (d, w) in enumerate(zip(classes, wanted, strict=True)) if d == w], pa.int64())
            raw, cut = shingles.tobytes(), (8 * bounds).tolist()
            sets = pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()).take(keep)
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(keep) for c in SET_KEY), sets], [*SET_KEY, "shingles"])

    return run


def _link(percent: int):
    """Sets sorted by block and slice -> (class, first class of its component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, classes, sets, seen = None, [], [], set()

        def done() -> Iterator[tuple[int, int]]:
            if len(classes) > 1:
                for c, first in zip(classes, link_block(sets, percent), strict=True):
                    if c != classes[first]:
                        yield c, classes[first]

        def rows(b: pa.RecordBatch):
            return zip(*(b.column(c).to_pylist() for c in ("block", "slice", "class_id", "shingles")), strict=True)

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            found = []
            for block, part, c, shingles in rows(b):
                if (block, part) != key:
                    found += done()
                    key, classes, sets, seen = (block, part), [], [], set()
                if c not in seen:  # repeated rows bring a class more than once
                    seen.add(c)
                    classes.append(c)
                    sets.append(np.frombuffer(shingles, _U))
            if found:
                yield out(found)
        yield out(list(done()))

    return run


SET_KEY = ("doc_id", "class_id", "block", "slice")
SETS = "doc_id long, class_id long, block long, slice long, shingles binary"


def _sliced(member: DataFrame, salt: int = 0) -> DataFrame:
    """Members (first_doc, class_id, n, block) with their block's number of slices and their own slice.

    The few weights are written, so that the join can split a block of many members."""
    weights = member.groupBy("block").agg(F.sum("n").alias("weight")).filter(F.col("weight") > MAX_BLOCK)
    cut = common.staged(weights.select("block", F.ceil(F.col("weight") * 2 / MAX_BLOCK).cast("long").alias("slices")), "slices")
    own = F.pmod(F.xxhash64("class_id", F.lit(salt)), "slices").alias("slice")
    wide = member.join(cut, "block", "left").withColumn("slices", F.coalesce("slices", F.lit(1).cast("long")))
    return wide.select("first_doc", "class_id", "n", "block", "slices", own)


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    ordered = sets.repartition("block", "slice").sortWithinPartitions("block", "slice", "doc_id", "class_id")
    return ordered.mapInArrow(_link(percent), "a long, b long")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with `label`, the least class that links lead to."""
    found = components(links).select(F.col("node").alias("class_id"), F.col("component").alias("label"))
    return rows.join(found.hint("merge"), "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))


def _of_most(labelled: DataFrame, *keys: str) -> DataFrame:
    """The label that most rows of each key have, as `most`."""
    return labelled.groupBy(*keys, "label").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.max_by("label", F.struct("c", "label")).alias("most"))


def _across_slices(large: DataFrame, held: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links of all classes, with those between slices of one block (see 4 above): held has the
    shingles of the classes of large, links those within slices."""

    def search(rows: DataFrame, name: str) -> DataFrame:
        sets = rows.join(held.hint("merge"), "class_id").select(F.col("first_doc").alias("doc_id"), *SET_KEY[1:], "shingles")
        return common.staged(_linked(sets, percent), name)

    within = links.join(large.select("class_id"), links["a"] == large["class_id"], "left_semi")
    level, n_rows, salt = large, large.count(), 0
    while True:
        # one class stands for each slice: the label of its largest component is a class of the slice
        first = _of_most(_labelled(level, within), "block", "slice").select("block", F.col("most").alias("class_id"))
        rows = large.select("first_doc", "class_id", "n").join(first.hint("merge"), "class_id")
        salt += 1
        level = common.staged(_sliced(rows, salt), "level")
        was, n_rows = n_rows, level.count()
        within = search(level, "links")
        links = links.union(within)
        if n_rows >= was or not level.filter("slices > 1").limit(1).count():
            break
    labelled = common.staged(_labelled(large, links).drop("slices", "slice"), "labelled")
    most = common.staged(_of_most(labelled, "block"), "most")
    marked = common.staged(labelled.join(most, "block").select("first_doc", "class_id", "n", "block", (F.col("label") == F.col("most")).alias("inside")), "marked")
    if marked.filter("NOT inside").limit(1).count():
        # slice r of those outside meets slice s of those inside, and each other slice of its own kind
        cut = lambda w: F.greatest(F.lit(1), F.ceil(w * 2 / MAX_BLOCK)).cast("long")
        weights = marked.groupBy("block").agg(F.sum(F.when(~F.col("inside"), F.col("n"))).alias("out"), F.sum(F.when(F.col("inside"), F.col("n"))).alias("in"))
        cuts = common.staged(weights.filter("out > 0").select("block", cut(F.col("out")).alias("r"), cut(F.col("in")).alias("s")), "cuts")
        own = F.pmod(F.xxhash64("class_id"), F.when(F.col("inside"), F.col("s")).otherwise(F.col("r")))
        dealt = marked.join(cuts, "block").withColumn("own", own)
        met = "CASE WHEN inside THEN transform(sequence(0L, r - 1), i -> shiftleft(i, 31) + own) ELSE transform(sequence(0L, s - 1), i -> shiftleft(own, 31) + i) END"
        others = "CASE WHEN inside OR r = 1 THEN array() ELSE transform(filter(sequence(0L, r - 1), i -> i <> own), i -> -1L - shiftleft(least(i, own), 31) - greatest(i, own)) END"
        dealt = dealt.select("first_doc", "class_id", "block", F.explode(F.expr(f"concat({met}, {others})")).alias("slice"))
        links = links.union(search(dealt, "links"))
    return components(links).select(F.col("node").alias("a"), F.col("component").alias("b"))


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, group_id, row_key) of every row: the least doc_id that links
    lead to; the group of linked texts, which tells apart groups that a repeated doc_id names alike
    (null for rows that link with nothing by definition); and the value of `key` for the row."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(None) if key is None else key).cast("long").alias("row_key"))
    described = common.staged(named.mapInArrow(_describe(k), "doc_id long, row_key long, n_shingles long, class_id long, parity binary"), "shingled")
    named = named.drop("row_key")
    linkable = described.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linkable.groupBy("class_id").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity"), F.count("*").alias("rows"))

    # about 0.5 to 0.7 signatures a shingle at the usual thresholds
    expected = (linkable.agg(F.sum("n_shingles")).first()[0] or 0) * 2 * (100 - percent) // percent
    buckets = max(1, -(-expected // BUCKET_ROWS), min(FIRST_BUCKETS, -(-expected // FIRST_ROWS)))
    signed = named.filter("doc_id IS NOT NULL").select("text").mapInArrow(_sign(k, percent, buckets), "bucket long, owners binary, counts binary, marks binary")
    shared = signed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "signature long, class_id long")
    known = classes.select("class_id", "n", "parity")
    mapped = shared.join(known.hint("merge"), "class_id").select("signature", "class_id", "n", "parity")
    near = mapped.repartition("signature").sortWithinPartitions("signature", "class_id").mapInArrow(_cluster(percent), "a long, b long")
    blocks = components(near).select(F.col("node").alias("class_id"), F.col("component").alias("block"))

    member = common.staged(classes.drop("parity").join(blocks.hint("merge"), "class_id"), "members")
    placed = _sliced(member)
    # always by shuffle: the members grow with the input
    texts = named.join(placed.hint("merge"), named["doc_id"] == placed["first_doc"]).select(*SET_KEY, "text")
    sets = texts.mapInArrow(_reshingle(k), SETS)
    links = common.staged(_linked(sets, percent), "links")
    large = placed.filter("slices > 1")
    if large.limit(1).count():
        large = common.staged(large, "large")
        own = named.join(large.hint("merge"), named["doc_id"] == large["first_doc"]).select(*SET_KEY, "text")
        held = common.staged(own.mapInArrow(_reshingle(k), SETS).select("class_id", "shingles"), "held")
        links = _across_slices(large, held, links, percent)
    # a component's name is the least doc_id of its classes
    root = links.select(F.col("a").alias("class_id"), F.col("b").alias("root")).union(links.select("b", "b")).distinct()
    rooted = root.join(member.select("class_id", "first_doc"), "class_id")
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    linked = rooted.join(least, "root").select("class_id", "component_id", "root")
    # labels of classes that have links or copies; any other row stands alone
    copies = classes.filter("rows > 1").select("class_id", "first_doc")
    both = copies.join(linked.hint("merge"), "class_id", "full").select("class_id", F.coalesce("component_id", "first_doc").alias("component_id"), "root")
    labels = common.staged(both, "labels")  # written, so that the join can split a class of many copies
    found = described.drop("parity").join(labels.hint("merge"), "class_id", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    own = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.when(~alone, F.coalesce("root", "class_id")).alias("group_id"), "row_key")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(common.documents(spark, sf_dir), k=4, percent=85).drop("group_id", "row_key")


OP1_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
s AS (SELECT DISTINCT doc_id, s FROM g),
n AS (SELECT doc_id, count(s) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n AS i ON i.doc_id = x JOIN n AS j ON j.doc_id = y WHERE 100 * o >= 85 * (i.n + j.n - o)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(reached) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2
"""
