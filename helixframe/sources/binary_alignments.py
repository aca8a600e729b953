"""Binary alignment files (BAM): a Spark data source, and a writer.

    spark.dataSource.register(BinaryAlignments)
    spark.read.format("binary_alignments").load("a.bam")                    # records
    spark.read.format("binary_alignments").option("part", "references").load("a.bam")
    spark.read.format("binary_alignments").option("part", "header").load("a.bam")           # header text

Records go to Spark in Arrow batches.  Block-compressed files are split into ranges of about ``split``
bytes (an option, 0: one partition a file); ``ord`` then is a record's place in the file, else its number.
A range begins with the first place from which a chain of sound records starts, and the task before it
must arrive at just that place: if it does not, the read fails rather than return other records.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import blocks
from .files import expand, open_binary, open_plain

# Fixed values of the format.
MAGIC = b"BAM\1"
BASES = "=ACMGRSVTWYHKDBN"
OPERATORS = "MIDNSHP=X"

RECORD = (
    "file string, ord long, ref_id int, pos int, mapq int, bin int, flag int, l_seq int, next_ref_id int, next_pos int, tlen int, "
    "qname string, cigar string, seq string, qual binary, tags binary, nm int, as_score int"
)
HEADER = "file string, text string"
REFERENCE = "file string, ref_id int, ref_name string, ref_length int"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
#: Records of an Arrow batch.
BATCH = 4_096
#: Compressed bytes of a partition.
SPLIT = 64 << 20
#: Records that have to follow each other for a place to be a record's start.
CHAIN = 16
_FIXED = struct.Struct("<iiBBHHHIiii")
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_INTS = {"A": "<B", "C": "<B", "c": "<b", "s": "<h", "S": "<H", "i": "<i", "I": "<i"}


def int_tag(tags: bytes, name: bytes) -> int | None:
    """Value of a whole-number tag; tags of other kinds are skipped, an unknown kind ends the scan.
    Unsigned 32-bit values are read as signed."""
    at = 0
    while at + 3 <= len(tags):
        key, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            end = tags.find(b"\0", at)
            if end < 0:
                return None
            at = end + 1
        elif kind == "B":
            if at + 5 > len(tags):
                return None
            size = _SIZES.get(chr(tags[at]))
            if size is None:
                return None
            at += 5 + size * int.from_bytes(tags[at + 1 : at + 5], "little")
        elif kind in _SIZES:
            if at + _SIZES[kind] > len(tags):
                return None
            if key == name and kind in _INTS:
                return struct.unpack_from(_INTS[kind], tags, at)[0]
            at += _SIZES[kind]
        else:
            return None
    return None


_TWO_BASES = ["".join((BASES[b >> 4], BASES[b & 15])) for b in range(256)]


def unpack_bases(raw: bytes, n: int) -> str:
    return "".join(map(_TWO_BASES.__getitem__, raw))[:n]


def unpack_cigar(words: tuple[int, ...]) -> str:
    return "".join(f"{w >> 4}{OPERATORS[w & 15] if w & 15 < 9 else '?'}" for w in words)


def read_header(f) -> tuple[str, list[tuple[str, int]]]:
    if f.read(4) != MAGIC:
        raise ValueError("not a binary alignment file")
    text = f.read(*struct.unpack("<i", f.read(4))).decode()
    refs = []
    for _ in range(*struct.unpack("<i", f.read(4))):
        name = f.read(*struct.unpack("<i", f.read(4))).rstrip(b"\0").decode()
        refs.append((name, *struct.unpack("<i", f.read(4))))
    return text, refs


def _decode(raw: bytes) -> tuple:
    ref, pos, name_size, mapq, bin_, n_cigar, flag, l_seq, next_ref, next_pos, tlen = _FIXED.unpack_from(raw)
    at = _FIXED.size
    name, at = raw[at : at + name_size].rstrip(b"\0").decode(errors="replace"), at + name_size
    cigar, at = struct.unpack_from(f"<{n_cigar}I", raw, at), at + 4 * n_cigar
    seq, at = unpack_bases(raw[at : at + (l_seq + 1) // 2], l_seq), at + (l_seq + 1) // 2
    qual, tags = raw[at : at + l_seq], raw[at + l_seq :]
    return ref, pos, mapq, bin_, flag, l_seq, next_ref, next_pos, tlen, name, unpack_cigar(cigar), seq, qual, tags, int_tag(tags, b"NM"), int_tag(tags, b"AS")


def read_records(path: str) -> Iterator[tuple]:
    with open_binary(path) as f:
        read_header(f)
        ord_ = 0
        while len(size := f.read(4)) == 4:
            yield (path, ord_, *_decode(f.read(*struct.unpack("<i", size))))
            ord_ += 1


def _after(b: blocks.Blocks, i: int, references: int) -> int | None:
    """Where the record at byte i ends; None if no sound record starts there."""
    if not b.need(i + 4 + _FIXED.size):
        return None
    size, ref, pos, name_size, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack("<i" + _FIXED.format[1:], b.get(i, i + 4 + _FIXED.size))
    if not (-1 <= ref < references and -1 <= next_ref < references and pos >= -1 and next_pos >= -1 and name_size > 0 and l_seq >= 0):
        return None
    at = i + 4 + _FIXED.size
    if _FIXED.size + name_size + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size or not b.need(at + name_size + 4 * n_cigar):
        return None
    name, operators = b.get(at, at + name_size), b.get(at + name_size, at + name_size + 4 * n_cigar)[::4]
    if name[-1] or any(c < 32 for c in name[:-1]) or any(c & 15 >= len(OPERATORS) for c in operators):
        return None
    return i + 4 + size


def _first_record(b: blocks.Blocks, references: int) -> int | None:
    """The first byte from which CHAIN sound records, or all up to the end of the file, follow."""
    i = 0
    while b.need(i + 4):
        at, n = i, 0
        while n < CHAIN and (following := _after(b, at, references)) is not None and b.need(following):
            at, n = following, n + 1
            if not b.need(at + 1):
                return i
        if n == CHAIN:
            return i
        i += 1
    return None


def read_range(path: str, begin: int, end: int) -> Iterator[tuple]:
    """Records that start in the blocks of this range of the file."""
    with open_binary(path) as f:
        _, refs = read_header(f)
        after_header = f.tell()
    with open_plain(path) as raw:
        b = blocks.Blocks(raw, begin)
        i = after_header if begin == 0 else _first_record(b, len(refs))
        place = None if i is None else b.place(i)
        while place is not None and place >> 16 < end:
            if not b.need(i + 4) or not b.need(following := i + 4 + int.from_bytes(b.get(i, i + 4), "little")):
                raise ValueError(f"{path}: truncated record at {place}")
            yield (path, place, *_decode(b.get(i + 4, following)))
            i = following
            place = b.place(i)
            b.drop(i)
    # also where no record starts in this range: so every range's first place is checked by the one before
    with open_plain(path) as raw:
        later = blocks.Blocks(raw, end)
        found = _first_record(later, len(refs))
        if (None if found is None else later.place(found)) != place:
            raise ValueError(f"{path}: no certain record start after {end}; read it with the option split = 0")


class _File(InputPartition):
    def __init__(self, path: str, begin: int = 0, end: int | None = None) -> None:
        super().__init__((path, begin, end))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.part = expand(options["path"]), options.get("part", "records")
        self.split = int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for p in self.paths:
            parts = []
            if self.part == "records" and p != "-":
                with open_plain(p) as raw:
                    parts = [_File(p, *r) for r in blocks.ranges(raw, self.split)]
            out += parts or [_File(p)]
        return out

    def read(self, partition):
        path, begin, end = partition.value
        if self.part == "records":
            schema = pa.schema([(n, _ARROW[t]) for n, t in map(str.split, RECORD.split(", "))])
            records = read_records(path) if end is None else read_range(path, begin, end)
            while rows := list(islice(records, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            return
        with open_binary(path) as f:
            text, references = read_header(f)
        if self.part == "header":
            yield path, text
            return
        for i, (name, length) in enumerate(references):
            yield path, i, name, length


class BinaryAlignments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_alignments"

    def schema(self) -> str:
        return {"records": RECORD, "header": HEADER, "references": REFERENCE}[self.options.get("part", "records")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _pack(text: str, references: list[tuple[str, int]]) -> bytes:
    out = bytearray(MAGIC + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(references)))
    for name, length in references:
        raw = name.encode() + b"\0"
        out += struct.pack("<i", len(raw)) + raw + struct.pack("<i", length)
    return bytes(out)


def _pack_record(qname, flag, ref_id, pos, mapq, cigar, seq, qual, tags) -> bytes:
    name = qname.encode() + b"\0"
    codes = [max(BASES.find(b), 0) if b in BASES else 15 for b in seq] + [0] * (len(seq) % 2)
    body = _FIXED.pack(ref_id, pos, len(name), mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name
    body += struct.pack(f"<{len(cigar)}I", *(n << 4 | OPERATORS.index(op) for op, n in cigar))
    body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + qual + tags
    return struct.pack("<i", len(body)) + body


def write_binary(df: DataFrame, folder: str) -> None:
    """One binary file a partition below folder, each with the references that its records name.

    df (qname, flag, rname, pos 1-based, mapq, cigar, seq, qual as printable text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, refs, body = TaskContext.get().partitionId(), None, {}, []
        for b in batches:
            for r in b.to_pylist():
                ref = refs.setdefault(r["rname"], len(refs))
                cigar = [(x[-1], int(x[:-1])) for x in re.findall("[0-9]+[MIDNSHP=X]", r["cigar"])]
                body.append(_pack_record(r["qname"], r["flag"], ref, r["pos"] - 1, r["mapq"], cigar, r["seq"], bytes(ord(c) - 33 for c in r["qual"]), b""))
        if body:
            store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
            store.create_dir(path, recursive=True)
            out = blocks.compress(_pack("", [(n, 1 << 20) for n in refs]) + b"".join(body))
            part = f"{path}/.part-{number:05d}-{TaskContext.get().attemptNumber()}"
            with store.open_output_stream(part) as f:
                f.write(out)
            store.move(part, f"{path}/part-{number:05d}.bam")
        yield pa.RecordBatch.from_arrays([pa.array([len(body)], pa.int64())], ["records"])

    df.mapInArrow(run, "records long").agg({"records": "sum"}).collect()


def write_records(path: str, references: list[tuple[str, int]], records, text: str = "") -> None:
    """Write (qname, flag, ref_id, pos 0-based, mapq, cigar [(operator, length)], seq, qual bytes, tags)."""
    with open(path, "wb") as f:
        f.write(blocks.compress(_pack(text, references) + b"".join(_pack_record(*r) for r in records)))
