"""Operator 5, LM scoring: Brown class-based bigrams with classes from exchange clustering.

Tokens are the words of a text in lower case (A-Z only) and one end.  Words are 64-bit hashes, and
all tables of words are packed: a row holds a bucket of words as sorted arrays, so the vocabulary may
have any size and no word table goes to the driver.

1. Word counts over all training documents.
2. Units: the CLUSTER_WORDS most frequent words, the end, and one unit for all other words.  Their
   bigrams over all training documents are counted.
3. Exchange clustering on these: each unit moves to the class that raises the likelihood of the class
   bigrams most, until no unit moves or SWEEPS sweeps are done.
4. Exchange for every other training word, in one distributed pass: its counts of following and
   preceding classes over all training documents decide which class makes them most likely, its own
   counts left out of the class of the common unit.
5. All documents become sequences of final classes.  They are dealt into chunks by a hash; a chunk asks
   for its distinct words, once each, and gets back their counts and classes.  The class bigrams of
   the training documents are counted again on these sequences.
6. log P(text) = sum of log P(class | previous class) + log P(word | class); transitions are smoothed
   towards class frequencies, words by UNSEEN counts for each word of a class and one unseen one.  A
   word without a training document has the class of the common unit.

Cases: a null or empty text is its end token alone.  A null doc_id counts as not held out.  Repeated
rows count as often as they occur and give one row each.  An empty table gives an empty result;
without training documents every token is unseen.  Only doc_id and text are read.  Equal 64-bit
hashes of different words are taken as equal; classes are found by 57 bits of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_U = np.uint64
FOLDS, ADD = 10, 0.1
CLUSTER_WORDS, CLASSES, SWEEPS = 2000, 48, 6
PRIOR, UNSEEN = 20.0, 0.5
#: Tokens that a map task gathers before it counts and emits them.
FLUSH_TOKENS = 1_000_000
#: Text of a chunk, and of the share of all words that one bucket holds.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 6 << 20
PAIR_BUCKETS = 64
END = _U(0x00E4D0F7E8700000)
_CLASS_BITS = _U(7)  # a preceding class is 64 more than a following one
_BEFORE = 64
PACKED = "bucket long, keys binary, counts binary"


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): document i has tokens[bounds[i]:bounds[i+1]], the last of them its end."""
    words, firsts = common.word_hashes(data, offsets, lower=True)
    return np.insert(words, firsts[1:], END), firsts + np.arange(len(firsts))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(32)) % _U(buckets)).astype(np.int64)


def packed(keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Ascending keys and their counts as rows of PACKED."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    heads, bounds = common.runs_by(bucket[order])
    k = common.slices(memoryview(keys[order].view(np.uint8)), bounds, 8)
    n = common.slices(memoryview(counts[order].astype(np.int64).view(np.uint8)), bounds, 8)
    for at in range(0, len(heads), 1_000):
        z = slice(at, at + 1_000)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order[heads[z]]]), pa.array(k[z], pa.binary()), pa.array(n[z], pa.binary())], ["bucket", "keys", "counts"])


def _emitter(keys_of, buckets: int):
    """mapInArrow function that counts the keys keys_of(tokens, bounds) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, data, offsets in common.text_batches(batches):
            held.append(keys_of(*token_hashes(data, offsets)))
            n += len(held[-1])
            if n >= FLUSH_TOKENS:
                yield from packed(*np.unique(np.concatenate(held), return_counts=True), buckets)
                held, n = [], 0
        if n:
            yield from packed(*np.unique(np.concatenate(held), return_counts=True), buckets)
        held.clear()
        common.give_back()

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, ascending keys, summed counts) of rows of PACKED that are sorted by bucket."""
    bucket, held = None, []

    def merged() -> tuple[int, np.ndarray, np.ndarray]:
        k, n = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held, strict=True), (_U, np.int64), strict=True))
        order = np.argsort(k, kind="stable")
        first, _ = common.runs_by(k[order])
        return bucket, k[order][first], np.add.reduceat(n[order], first)

    for b in batches:
        for key, *part in zip(*(b.column(c).to_pylist() for c in ("bucket", "keys", "counts")), strict=True):
            if key != bucket:
                if held:
                    yield merged()
                bucket, held = key, []
            held.append(part)
    if held:
        yield merged()
    common.give_back()


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, k, n in by_bucket(batches):
        yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([k.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["bucket", "keys", "counts"])


def _summed(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sum, PACKED)


def _level(counts: np.ndarray) -> np.ndarray:
    """Steps of about 4 % of a count."""
    return np.floor(np.log2(counts) * 16).astype(np.int64)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, words, tokens) of packed counts."""
    for b in batches:
        n = np.frombuffer(b"".join(b.column("counts").to_pylist()), np.int64)
        level, at, words = np.unique(_level(n), return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(words), pa.array(np.bincount(at, n, len(level)).astype(np.int64))], ["level", "words", "tokens"])


def _above(floor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n = (np.frombuffer(b"".join(b.column(c).to_pylist()), kind) for c, kind in (("keys", np.int64), ("counts", np.int64)))
            keep = (_level(n) >= floor) | (k == np.int64(END))
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(n[keep])], ["key", "c"])

    return run


class Units(NamedTuple):
    """Frequent words and the end, ascending, with their counts; the unit after them is all others."""

    keys: np.ndarray
    counts: np.ndarray

    @property
    def n(self) -> int:
        return len(self.keys) + 1

    @property
    def end(self) -> int:
        return int(np.searchsorted(self.keys, END))

    def of(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        return np.where(self.keys[at] == tokens, at, len(self.keys))


def _pairs(units: Units):
    def keys_of(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        # the end also stands before a text, so texts follow each other
        u = units.of(tokens)
        return (np.concatenate(([units.end], u[:-1])) * units.n + u).astype(_U) << _U(32)  # the bits that deal to buckets

    return keys_of


def _contexts(units: Units, of: np.ndarray):
    """Keys of words that are no units: 57 bits of the word, and a class that follows or precedes it."""

    def keys_of(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        u = units.of(tokens)
        c = of[u]
        at = np.flatnonzero(u == units.n - 1)
        word = tokens[at] >> _CLASS_BITS << _CLASS_BITS
        before = np.where(at > 0, c[at - 1], of[units.end])
        return np.concatenate((word | c[at + 1].astype(_U), word | (before + _BEFORE).astype(_U)))

    return keys_of


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit.  Units start dealt by frequency; each in turn leaves its class and joins
    the one with the greatest gain in sum N(c,d) log N(c,d) - 2 sum N(c) log N(c)."""
    n = len(bigrams)
    weight = bigrams.sum(0)
    rank = np.argsort(-weight, kind="stable")
    of = np.empty(n, np.int64)
    of[rank] = np.arange(n) % classes
    member = np.eye(classes)[of]
    f = member.T @ bigrams @ member
    left, right = f.sum(1), f.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in rank[weight[rank] > 0]:
            a, self_count = of[w], bigrams[w, w]
            out = np.bincount(of, bigrams[w], classes)
            into = np.bincount(of, bigrams[:, w], classes)
            out[a] -= self_count
            into[a] -= self_count
            # take the unit out of its class
            f[a] -= out
            f[:, a] -= into
            f[a, a] -= self_count
            left[a] -= out.sum() + self_count
            right[a] -= into.sum() + self_count
            rows, columns = _xlogx(f + out) - _xlogx(f), _xlogx(f + into[:, None]) - _xlogx(f)
            d = f.diagonal()
            gain = rows.sum(1) - rows.diagonal() + columns.sum(0) - columns.diagonal() + _xlogx(d + out + into + self_count) - _xlogx(d)
            gain -= _xlogx(left + out.sum() + self_count) - _xlogx(left) + _xlogx(right + into.sum() + self_count) - _xlogx(right)
            b = int(gain.argmax())
            moved += b != a
            of[w] = b
            f[b] += out
            f[:, b] += into
            f[b, b] += self_count
            left[b] += out.sum() + self_count
            right[b] += into.sum() + self_count
        if not moved:
            break
    return of


def transitions(f: np.ndarray) -> np.ndarray:
    """log10 P(class | previous class) of the class bigrams f."""
    share = (f.sum(0) + 0.5) / (f.sum() + 0.5 * len(f))
    return np.log10((f + PRIOR * share) / (f.sum(1, keepdims=True) + PRIOR))


def best_classes(f: np.ndarray, word: np.ndarray, near: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Class of each word under the class bigrams f.  Entry i says that word[i] (ascending) has the
    class near[i] (+ len(f): before it) next to it n[i] times; own is the class in which f holds the
    word's counts."""
    sides = []
    for g in (f, f.T):
        prior = PRIOR * (g.sum(0) + 0.5) / (g.sum() + 0.5 * len(g))
        sides.append((g, prior, g.sum(1), np.log((g + prior) / (g.sum(1, keepdims=True) + PRIOR))))
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    gain = np.add.reduceat(np.concatenate([x[3].T for x in sides])[near] * n[:, None], starts)
    # in its own class the word finds the others' counts alone
    mine, total = np.zeros(len(n)), np.bincount(word, np.where(near >= len(f), n, 0))
    for k, (g, prior, sums, _) in enumerate(sides):
        i = np.flatnonzero(near // len(f) == k)
        a, c = own[word[i]], near[i] % len(f)
        left = np.maximum(sums[a] - total[word[i]], 0)
        mine[i] = n[i] * np.log((np.maximum(g[a, c] - n[i], 0) + prior[c]) / (left + PRIOR))
    gain[np.arange(len(own)), own] = np.add.reduceat(mine, starts)
    gain[:, f.sum(1) == 0] = -np.inf
    return gain.argmax(1)


CLASSED = "bucket long, keys binary, classes binary, sizes binary"


def _assign(f: np.ndarray, own: int):
    """Packed contexts sorted by bucket -> words and their classes; sizes: tokens and words by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, key, n in by_bucket(batches):
            words, word = np.unique(key >> _CLASS_BITS, return_inverse=True)
            near = (key & _U(127)).astype(np.int64)
            preceding = near >= _BEFORE
            near = np.where(preceding, near - _BEFORE + len(f), near)
            count = np.bincount(word, np.where(preceding, n, 0))
            c = best_classes(f, word, near, n, np.full(len(words), own))
            sizes = np.concatenate((np.bincount(c, count, len(f)), np.bincount(c, minlength=len(f))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket]), *(pa.array([x], pa.binary()) for x in ((words << _CLASS_BITS).tobytes(), c.astype(np.uint8).tobytes(), sizes.tobytes()))],
                ["bucket", "keys", "classes", "sizes"],
            )

    return run


def _class_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * CLASSES)
    for b in batches:
        for raw in b.column("sizes").to_pylist():
            total += np.frombuffer(raw)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total[:CLASSES]), pa.array(total[CLASSES:])], ["class", "n", "v"])


class Model(NamedTuple):
    tokens: int
    words: int
    units: Units
    of: np.ndarray  # class of each unit, the last that of all other words without a training document
    size: np.ndarray  # of each class: smoothed tokens
    counts: DataFrame  # PACKED, of all training words
    classed: DataFrame  # CLASSED, of those that are no units


def fit(learned: DataFrame, buckets: int) -> Model:
    """Counts and classes of the words of a frame (text)."""
    counts = common.staged(_summed(learned.mapInArrow(_emitter(lambda t, _: t, buckets), PACKED)), "words")
    levels = counts.mapInArrow(_levels, "level long, words long, tokens long").groupBy("level").agg(F.sum("words").alias("v"), F.sum("tokens").alias("n")).collect()
    left, floor = CLUSTER_WORDS, 1 << 20
    for r in sorted(levels, reverse=True):  # at most 16 * 63 rows
        left -= r["v"]
        if left < 0:
            break
        floor = r["level"]
    top = sorted((r["key"] & 0xFFFFFFFFFFFFFFFF, r["c"]) for r in counts.mapInArrow(_above(floor), "key long, c long").collect())  # at most CLUSTER_WORDS and the end
    if not any(k == int(END) for k, _ in top):
        top = sorted([*top, (int(END), 0)])
    units = Units(np.array([k for k, _ in top], _U), np.array([c for _, c in top], np.int64))
    bigrams = np.zeros(units.n * units.n)
    for r in _summed(learned.mapInArrow(_emitter(_pairs(units), PAIR_BUCKETS), PACKED)).collect():  # at most (CLUSTER_WORDS + 2)^2 numbers
        bigrams[np.frombuffer(r["keys"], np.int64) >> 32] = np.frombuffer(r["counts"], np.int64)
    bigrams = bigrams.reshape(units.n, units.n)
    of = exchange(bigrams)
    member = np.eye(CLASSES)[of]
    contexts = learned.mapInArrow(_emitter(_contexts(units, of), buckets), PACKED)
    classed = contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_assign(member.T @ bigrams @ member, int(of[-1])), CLASSED)
    classed = common.staged(classed, "classes")
    known = units.counts > 0
    size = UNSEEN + np.bincount(of[:-1][known], units.counts[known] + UNSEEN, CLASSES)
    for r in classed.mapInArrow(_class_sizes, "class long, n double, v double").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        size[r["class"]] += r["n"] + UNSEEN * r["v"]
    return Model(sum(r["n"] for r in levels), sum(r["v"] for r in levels), units, of, size, counts, classed)


ASKED = "bucket long, kind int, chunk long, keys binary, more binary"
ANSWERS = "bucket long, chunk long, counts binary, classes binary"
_ASKED = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])
_ANSWERS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("counts", pa.binary()), ("classes", pa.binary())])


def _chunk_words(texts: pa.Table, units: Units) -> tuple[pa.RecordBatch | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, bounds, distinct tokens, number of each token among them, those that are no units)."""
    rows = texts.combine_chunks().to_batches()
    if not rows:
        none = np.zeros(0, np.int64)
        return None, none, none.view(_U), none, none
    tokens, bounds, at = [], [np.zeros(1, np.int64)], 0
    for _, data, offsets in common.text_batches(rows):
        t, b = token_hashes(data, offsets)
        tokens.append(t)
        bounds.append(b[1:] + at)
        at += len(t)
    distinct, number = np.unique(np.concatenate(tokens), return_inverse=True)
    return rows[0], np.concatenate(bounds), distinct, number, np.flatnonzero(units.of(distinct) == units.n - 1)


def _ask(units: Units, buckets: int):
    def run(key: tuple, texts: pa.Table) -> pa.Table:
        _, _, distinct, _, other = _chunk_words(texts, units)
        keys, chunk = distinct[other], key[0].as_py()
        common.give_back()
        out = [(b, 2, chunk, k, None) for batch in packed(keys, keys, buckets) for b, k in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist(), strict=True)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 5, _ASKED, strict=True)], schema=_ASKED)

    return run


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing, values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing).astype(values.dtype)


def _answer(missing: int):
    """Rows sorted by bucket and kind: 0 counts of words, 1 classes, 2 questions -> answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, _U), np.zeros(0, np.int64)), (np.zeros(0, _U), np.zeros(0, np.uint8))
        bucket, (counts, classes) = None, none
        for b in batches:
            out = []
            for here, kind, chunk, keys, more in zip(*(b.column(c).to_pylist() for c in _ASKED.names), strict=True):
                if here != bucket:
                    bucket, (counts, classes) = here, none
                keys = np.frombuffer(keys, _U)
                if kind == 0:
                    counts = keys, np.frombuffer(more, np.int64)
                elif kind == 1:
                    classes = keys, np.frombuffer(more, np.uint8)
                else:
                    out.append((here, chunk, _lookup(*counts, keys, 0).tobytes(), _lookup(*classes, keys >> _CLASS_BITS << _CLASS_BITS, missing).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 4, _ANSWERS, strict=True)], schema=_ANSWERS)

    return run


def _sequences(units: Units, of: np.ndarray, size: np.ndarray, base_log: float, buckets: int):
    """Per row its tokens, known ones, base score, the words' share of the score, and its classes."""
    size_log = np.log10(size)

    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        common.give_back()
        rows, bounds, distinct, number, other = _chunk_words(texts, units)
        names = ["doc_id", "learned", "n_tokens", "n_known", "base_score", "score", "classes"]
        if rows is None:
            kinds = (texts.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        u = units.of(distinct)
        c, cls = np.append(units.counts, 0)[u], of[u].astype(np.uint8)
        bucket = bucket_of(distinct[other], buckets)
        place = other[np.argsort(bucket, kind="stable")]
        if len(place):
            found = sorted(zip(*(answers.column(x).to_pylist() for x in ("bucket", "counts", "classes")), strict=True))
            c[place] = np.frombuffer(b"".join(x for _, x, _ in found), np.int64)
            cls[place] = np.frombuffer(b"".join(x for _, _, x in found), np.uint8)
        per = lambda x: np.add.reduceat(x[number], bounds[:-1])  # noqa: E731  each document has its end
        base, word = np.log10(c + ADD) - base_log, np.log10(c + UNSEEN) - size_log[cls]
        classes = common.slices(memoryview(cls[number]), bounds, 1)
        columns = [pa.array(np.diff(bounds)), pa.array(per((c > 0).astype(np.int64))), pa.array(per(base)), pa.array(per(word)), pa.array(classes, pa.binary())]
        return pa.Table.from_arrays([rows.column("doc_id"), rows.column("learned"), *columns], names)

    return run


def _joined(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all sequences of a batch, their bounds)."""
    raw = b.column("classes").to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), np.cumsum([0, *map(len, raw)])


def _class_bigrams(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            c, _ = _joined(b)
            f += np.bincount(np.concatenate(([end], c[:-1]))[: len(c)] * CLASSES + c, minlength=len(f))
        some = np.flatnonzero(f)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(f[some])], ["pair", "n"])

    return run


def _total(end: int, step: np.ndarray):
    """Adds the transitions to the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, bounds = _joined(b)
            if len(b):
                cost = step.ravel()[np.concatenate(([end], c[:-1])) * CLASSES + c]
                score = b.column("score").to_numpy() + np.add.reduceat(cost, bounds[:-1])
                yield b.drop_columns(["classes", "learned", "score"]).append_column("score", pa.array(score))

    return run


def score_documents(docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    training: which rows to learn from, over the column doc_id; by default those not held out."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = named.withColumn("learned", F.coalesce(~held_out() if training is None else training, F.lit(False)))
    bytes_ = named.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    chunks, buckets = -(-bytes_ // CHUNK_BYTES), -(-bytes_ // BUCKET_BYTES)
    m = fit(named.filter("learned").select("text"), buckets)

    # one exchange of the texts serves questions and scores
    texts = named.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition("chunk").groupBy("chunk")
    asked = texts.applyInArrow(_ask(m.units, buckets), ASKED)
    table = lambda df, kind, more: df.select("bucket", F.lit(kind).alias("kind"), F.lit(-1).cast("long").alias("chunk"), "keys", F.col(more).alias("more"))
    both = asked.unionByName(table(m.counts, 0, "counts")).unionByName(table(m.classed, 1, "classes"))
    answers = both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer(int(m.of[-1])), ANSWERS)
    base_log = float(np.log10(m.tokens + ADD * (m.words + 1)))
    id_type = named.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double"
    found = texts.cogroup(answers.groupBy("chunk")).applyInArrow(_sequences(m.units, m.of, m.size, base_log, buckets), kind.replace("n_tokens", "learned boolean, n_tokens", 1) + ", classes binary")
    sequences = common.staged(found, "sequences")

    end, f = int(m.of[m.units.end]), np.zeros(CLASSES * CLASSES)
    pairs = sequences.filter("learned").select("classes").mapInArrow(_class_bigrams(end), "pair long, n long")
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most CLASSES * CLASSES
        f[r["pair"]] = r["n"]
    scored = sequences.mapInArrow(_total(end, transitions(f.reshape(CLASSES, CLASSES))), kind)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.documents(spark, sf_dir)).withColumn("held_out", held_out())
