"""Paired reads drawn from contigs under empirical or given distributions, with a seed.

Contigs are cut into tasks by weight: the number of reads of a contig is its expected share, rounded
by cumulative sums, so that totals hold.  Every read comes from a random generator seeded by (seed,
contig, number): the outcome does not depend on partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reads generated by one row of work; a long contig has many such rows.
CHUNK = 2_000
#: Bases of a contig that go to one group of pairs.
TILE = 1 << 16
SLACK = 20
READ_SCHEMA = "r1_id string, r1_seq string, r1_qual string, r2_id string, r2_seq string, r2_qual string"
_BASES = np.frombuffer(b"ACGT", np.uint8)
_CODE = np.full(256, 4)
_CODE[_BASES] = np.arange(4)
_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")


class Model:
    """Cumulative tables for lengths, inserts and per-cycle qualities.

    vary_lengths: reads take their lengths from r1 and r2; otherwise all have read_length."""

    def __init__(self, r1=None, r2=None, insert=None, q1=None, q2=None, read_length: int = 150, vary_lengths: bool = True) -> None:
        point = lambda x: {x: 1}
        if not vary_lengths:
            r1 = r2 = None
        self.tables = [self._cumulate(t) for t in (r1 or point(read_length), r2 or point(read_length), insert or {i: 1 for i in range(300, 401)})]
        self.q1, self.q2 = ([self._cumulate(t) for t in (q or [point(37)]) if t] or [self._cumulate(point(37))] for q in (q1, q2))

    @classmethod
    def from_document(cls, m: dict, read_length: int = 150, vary_lengths: bool = False) -> Model:
        """A model as model_document stores it."""
        read = lambda h: {round(h["min_val"] + i * h["bin_width"]): n for i, n in enumerate(h["counts"]) if n}
        return cls(read(m["r1_lengths"]), read(m["r2_lengths"]), read(m["insert_sizes"]), *([*map(read, m[f"r{k}_qualities"])] for k in (1, 2)), read_length, vary_lengths)

    @staticmethod
    def _cumulate(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        values = np.array(sorted(counts))
        share = np.cumsum([counts[v] for v in values.tolist()], dtype=float)
        return values, share / share[-1]

    @staticmethod
    def draw(table: tuple[np.ndarray, np.ndarray], p) -> np.ndarray:
        values, share = table
        return values[np.minimum(np.searchsorted(share, p), len(values) - 1)]


def model_document(runs: DataFrame, read_length: int = 150, least_mapq: int = 40, most_insert: int = 1000) -> dict:
    """Model of name-run pairs (r1, r2 with seq and qual as bytes of quality): inserts, lengths and per-cycle
    qualities, all as histograms with their empty ends cut off."""
    from .alignments import insert_sizes
    from .evaluation import histogram_document
    from .histograms import Bins, build

    pairs = runs.filter("r1 IS NOT NULL AND r2 IS NOT NULL")
    rows = lambda df: {r["bin"]: r["n"] for r in df.collect()}  # noqa: E731  as many as a histogram has bins
    insert, length, quality = Bins(0, most_insert, 1), Bins(0, read_length, 1), Bins(0, 60, 1)
    out = {"max_read_length": read_length, "insert_sizes": histogram_document(rows(build(insert_sizes(pairs, least_mapq, most_insert), insert, value="insert_size")), insert)}
    for k in (1, 2):
        size = F.octet_length(f"r{k}.qual")
        out[f"r{k}_lengths"] = histogram_document(rows(build(pairs.select(size.cast("double").alias("value")), length)), length)
    for k in (1, 2):
        # two hex digits a quality byte
        hexed = pairs.select(F.hex(f"r{k}.qual").alias("h")).filter("length(h) > 0")
        cycles = hexed.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.least(F.length("h") / 2, F.lit(read_length)).cast("int") - 1), lambda i: F.substr("h", 2 * i + 1, F.lit(2)))).alias("cycle", "q"))
        counts: list[dict[int, int]] = [{} for _ in range(read_length)]
        for r in build(cycles.select("cycle", F.conv("q", 16, 10).cast("double").alias("value")), quality, "cycle").collect():
            counts[r["cycle"]][r["bin"]] = r["n"]
        out[f"r{k}_qualities"] = [histogram_document(c, quality) for c in counts]
    return out


def mutate(bases: np.ndarray, length: int, substitution: float, indel: float, rng: np.random.Generator) -> tuple[np.ndarray, tuple[int, int, int]]:
    """`length` bases read off a slice with errors, upper case, padded at random: (bases, numbers of
    substitutions, insertions and deletions).

    At each step an indel happens first: half of them put a random base before the current one, which
    then is looked at again, half leave the current one out.  Else a substitution takes one of the
    other bases, each alike."""
    bases = np.where(bases >= 97, bases - 32, bases)
    if not indel:
        steps = min(len(bases), length)
        ins = dels = np.zeros(steps, bool)
    else:
        steps = len(bases) + length  # each step uses up a base or makes one
        hit, half = rng.random(steps) < indel, rng.random(steps) < 0.5
        ins, dels = hit & half, hit & ~half
    at = np.cumsum(~ins) - ~ins
    made = np.cumsum(~dels) - ~dels
    live = (at < len(bases)) & (made < length)
    ins, dels, at = ins[live], dels[live], at[live]
    current = bases[at]
    sub = ~ins & ~dels & (rng.random(len(at)) < substitution)
    code = _CODE[current]
    other = np.where(code < 4, (code + rng.integers(1, 4, len(at))) % 4, rng.integers(0, 4, len(at)))
    out = np.where(ins, _BASES[rng.integers(0, 4, len(at))], np.where(sub, _BASES[other], current))[~dels]
    padding = _BASES[rng.integers(0, 4, length - len(out))]
    return np.concatenate((out, padding)).astype(np.uint8), (int(sub.sum()), int(ins.sum()), int(dels.sum()))


class _Draw:
    """Lengths, insert and place of a read pair, from a generator seeded by (seed, contig, number)."""

    def __init__(self, model: Model, seed: int, contig: str, number: int, size: int) -> None:
        mark = hashlib.blake2b(f"{seed}\0{contig}\0{number}".encode(), digest_size=16).digest()
        self.rng = rng = np.random.default_rng(int.from_bytes(mark, "little"))
        self.l1, self.l2 = (int(model.draw(t, rng.random())) for t in model.tables[:2])
        least = max(self.l1, self.l2) + SLACK + 1
        insert = next((x for x in map(int, model.draw(model.tables[2], rng.random(100))) if x >= least), least)
        self.size = insert + SLACK
        self.start = int(rng.integers(0, max(size - self.size, 0) + 1))


def _places(model: Model, seed: int, tile: int):
    """Rows (id, contig, size, salts, first, reads) -> one row a pair with its tile and salt."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                numbers = range(r.first, r.first + r.reads)
                tiles = [_Draw(model, seed, r.contig, i, r.size).start // tile for i in numbers]
                yield pd.DataFrame({"id": r.id, "contig": r.contig, "size": r.size, "number": numbers, "tile": tiles, "salt": [i % r.salts for i in numbers]})

    return run


def _qualities(tables: list, shares: pd.Series) -> list[str]:
    """Printable qualities of a group's reads from the uniform numbers of each: cycle by cycle, all reads at once."""
    sizes = [len(x) for x in shares]
    grid = np.zeros((len(sizes), max(sizes)))
    for row, x in zip(grid, shares, strict=True):
        row[: len(x)] = x
    out = np.empty(grid.shape, np.uint8)
    for i in range(grid.shape[1]):
        out[:, i] = 33 + Model.draw(tables[min(i, len(tables) - 1)], grid[:, i])
    return [row[:n].tobytes().decode() for row, n in zip(out, sizes, strict=True)]


def _generate(model: Model, prefix: str, keyword: str, substitution: float, indel: float, seed: int, tile: int):
    columns = ["r1_id", "r1_seq", "r1_qual", "r2_id", "r2_seq", "r2_qual"]

    def one(text: np.ndarray, begin: int, contig: str, number: int, size: int) -> tuple:
        d = _Draw(model, seed, contig, number, size)
        piece = text[d.start - begin : d.start - begin + d.size]
        a, e1 = mutate(piece[: d.l1 + SLACK], d.l1, substitution, indel, d.rng)
        b, e2 = mutate(piece[-(d.l2 + SLACK) :], d.l2, substitution, indel, d.rng)
        name = lambda m, e: f"{prefix}:{keyword}:{contig}:{number} {m}:N:{e[0]}:{e[1]}:{e[2]}/{m}"
        return (name(1, e1), a.tobytes().decode(), d.rng.random(d.l1), name(2, e2), b.tobytes().translate(_COMPLEMENT)[::-1].decode(), d.rng.random(d.l2))

    def run(pairs: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs):
            return pd.DataFrame([], columns=columns)
        text = np.frombuffer(pieces["piece"][0].encode(), np.uint8)
        begin = int(pieces["tile"][0]) * tile
        out = pd.DataFrame([one(text, begin, c, int(n), int(s)) for c, n, s in zip(pairs["contig"], pairs["number"], pairs["size"], strict=True)], columns=columns)
        return out.assign(r1_qual=_qualities(model.q1, out["r1_qual"]), r2_qual=_qualities(model.q2, out["r2_qual"]))

    return run


def simulate(contigs: DataFrame, n: int, prefix: str, keyword: str, model: Model | None = None, substitution: float = 0.0, indel: float = 0.0, seed: int = 0) -> DataFrame:
    """Read pairs from contigs (contig, seq), about n times each contig's share of all bases."""
    # equal chunks of one contig are one chunk of more weight
    keyed = contigs.withColumn("_id", F.xxhash64("contig", "seq")).groupBy("_id").agg(F.first("contig").alias("contig"), F.first("seq").alias("seq"), F.count("*").alias("_m"))
    size = F.length("seq").cast("double") * F.col("_m")
    # cumulative shares over the small table of sizes; sequences join back by key
    sizes = keyed.select("_id", size.alias("_s"))
    w = Window.orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_s").over(Window.partitionBy())
    upto = F.round(F.sum("_s").over(w) / total * n).cast("long")
    shares = sizes.withColumn("_to", upto).withColumn("_from", F.coalesce(F.lag("_to").over(Window.orderBy("_id")), F.lit(0).cast("long")))
    return _run(keyed.join(shares.select("_id", "_from", "_to"), "_id"), model, prefix, keyword, substitution, indel, seed)


def generate(tasks: DataFrame, prefix: str, keyword: str, model: Model | None = None, substitution: float = 0.0, indel: float = 0.0, seed: int = 0) -> DataFrame:
    """Read pairs from tasks (contig, seq, reads): as many of each contig as it says."""
    return _run(tasks.withColumns({"_from": F.lit(0).cast("long"), "_to": F.col("reads").cast("long")}), model, prefix, keyword, substitution, indel, seed)


def _run(tasks: DataFrame, model: Model | None, prefix: str, keyword: str, substitution: float, indel: float, seed: int, tile: int = TILE) -> DataFrame:
    """Pairs are placed first, knowing only how long their contig is; then those of one tile meet its
    bases, about CHUNK at a time.  So what moves of a contig is one tile for each CHUNK of pairs."""
    model = model or Model()
    reach = max(int(model.tables[2][0][-1]), max(int(t[0][-1]) for t in model.tables[:2]) + SLACK + 1) + SLACK
    n = F.col("_to") - F.col("_from")
    some = tasks.filter("_to > _from AND length(seq) > 0").select("contig", "seq", "_from", "_to", F.length("seq").cast("long").alias("size"), F.xxhash64("contig", "seq", "_from").alias("id"))
    some = some.withColumn("salts", F.ceil(n * F.least(F.lit(1.0), F.lit(float(tile)) / F.col("size")) / CHUNK).cast("long"))
    work = some.select("id", "contig", "size", "salts", "_to", F.explode(F.sequence("_from", F.col("_to") - 1, F.lit(CHUNK).cast("long"))).alias("first"))
    chunks = work.select("id", "contig", "size", "salts", "first", F.least(F.lit(CHUNK), F.col("_to") - F.col("first")).alias("reads"))
    pairs = chunks.repartition("id", "first").mapInPandas(_places(model, seed, tile), "id long, contig string, size long, number long, tile long, salt long")
    cut = some.select("id", "salts", "seq", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {tile}"))).alias("tile"))
    pieces = cut.select("id", "tile", F.substr("seq", (F.col("tile") * tile + 1).cast("int"), F.lit(tile + reach)).alias("piece"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    key = ("id", "tile", "salt")
    return pairs.groupBy(*key).cogroup(pieces.groupBy(*key)).applyInPandas(_generate(model, prefix, keyword, substitution, indel, seed, tile), READ_SCHEMA)
