"""Operator 7, byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece the last token of its encoding is unique.  A token t can end a prefix
if t is a suffix of it and the last token u of the rest is compatible with t, that is, if u and t
stay apart when their joined bytes are merged by rank.  So ``last[i]`` follows from earlier entries;
the ids of any prefix are read off backwards.  Appending extends the table; an edit recomputes it
from the edit on until it runs parallel to the old one.

Cases: a null text counts as empty (0 tokens; digests of the empty string).  Repeated rows give one
row each; an empty table gives an empty result; only doc_id and text are read.  Lone surrogates
cannot occur in Arrow strings.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .segments import SpacedSegments
from .vocab import read_ranks

#: Token pairs whose compatibility one worker remembers.
PAIRS_KEPT = 1_000_000
_LOADED: dict = {}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short piece by merging its lowest-ranked pair again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class PrefixBPE:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self._find = regex.compile(pattern).findall
        self._pairs: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        # all tokens that end at each byte, found in one pass over the piece
        suffixes = ahocorasick.Automaton()
        for t, i in ranks.items():
            suffixes.add_word(t.decode("latin-1"), (i, len(t)))
        suffixes.make_automaton()
        self._suffixes = suffixes.iter
        self.longest = max(map(len, ranks), default=1)
        self._segments = SpacedSegments(self._segment)

    def apart(self, u: int, t: int) -> bool:
        """Whether u, t is the encoding of their joined bytes."""
        key = u << 32 | t
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            found = self._pairs[key] = merge(self.tokens[u] + self.tokens[t], self.ranks) == [u, t]
        return found

    def reachable(self, t: int) -> bool:
        """Whether t is the encoding of its own bytes."""
        found = self._own.get(t)
        if found is None:
            found = self._own[t] = merge(self.tokens[t], self.ranks) == [t]
        return found

    def extend(self, piece: bytes, last: list[int], stop: int | None = None) -> None:
        """Fill last (last[0] unused) up to the end of the piece or to stop."""
        stop, n = len(piece) if stop is None else stop, len(last)
        pairs, own, base = self._pairs, self._own, max(0, n - self.longest) + 1
        for end, (t, size) in self._suffixes(piece[base - 1 : stop].decode("latin-1")):
            i = end + base
            if i != n:
                if i < n:
                    continue
                break
            if size == i:
                ok = own.get(t)
                if ok is None:
                    ok = self.reachable(t)
            else:
                ok = pairs.get(last[i - size] << 32 | t)
                if ok is None:
                    ok = self.reachable(t) and self.apart(last[i - size], t)
            if ok:
                last.append(t)
                n += 1
        if n != stop + 1:
            raise ValueError(f"no token ends at byte {n}")

    def read(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(self.tokens[last[i]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece that is a token is that token, as in the rank-based library."""
        t = self.ranks.get(piece)
        if t is not None:
            return [t]
        last = [-1]
        self.extend(piece, last)
        return self.read(last)

    def _segment(self, text: str) -> bytes:
        out = array("I")
        for piece in self._find(text):
            out.extend(self.encode_piece(piece.encode()))
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        return self._segments.of(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


class PrefixTable:
    """The table of one piece, for exact appends and re-encoding near edits."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b"") -> None:
        self.bpe, self.piece, self.last = bpe, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.extend(self.piece, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace piece[start:end]; returns how many entries were computed anew.

        Entries before start stay.  Behind the new bytes, once as many entries in a row as the
        longest token has bytes equal the old ones, all later ones do."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = old[: start + 1]
        at, same = start + len(new), 0
        self.bpe.extend(self.piece, self.last, at)
        while at < len(self.piece):
            at += 1
            self.bpe.extend(self.piece, self.last, at)
            same = same + 1 if self.last[at] == old[at - shift] else 0
            # a token that reaches back over the edit would differ from the old text's
            if same >= self.bpe.longest:
                self.last += old[at - shift + 1 :]
                break
        return at - start

    def ids(self) -> list[int]:
        t = self.bpe.ranks.get(self.piece)
        return [t] if t is not None else self.bpe.read(self.last)


def _coder(path: str) -> PrefixBPE:
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE(read_ranks(path))
    return _LOADED[path]


def _code(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(path)
        for rows, _, _ in common.text_batches(batches):
            ids = [bpe.encode(t) if t else b"" for t in rows.column("text").to_pylist()]
            offsets = [0]
            for x in ids:
                offsets.append(offsets[-1] + len(x) // 4)
            flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, pa.array(list(map(bpe.decode, ids)), pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every row; no shuffle."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_code(ranks_path), f"doc_id {id_type}, ids array<int>, decoded binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
