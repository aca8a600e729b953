"""FASTQ files as a Spark data source, one partition a file (or pair of files), and writers.

    spark.dataSource.register(Reads)
    spark.read.format("reads").load("a.fq.gz")                                        # id, seq, qual
    spark.read.format("reads").option("path2", "b.fq.gz").load("a.fq.gz")             # r1, r2 by place
    spark.read.format("reads").option("interleaved", "true").load("a.fq.gz")          # r1, r2

A missing line of a record, files of unequal length and an odd number of interleaved reads are
errors; ids of pairs are not compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import expand, open_binary

READ = "struct<id:string,seq:string,qual:string>"
_READ = pa.struct([(c, pa.string()) for c in ("id", "seq", "qual")])
#: Reads of an Arrow batch.
BATCH = 4_096


def parse(path: str) -> Iterator[tuple[str, str, str]]:
    with open_binary(path) as f:
        while head := f.readline():
            seq, plus, qual = f.readline(), f.readline(), f.readline()
            if not (seq and plus and qual):
                raise ValueError(f"{path}: truncated record {head!r}")
            yield head.decode().rstrip("\r\n").lstrip("@"), seq.decode().rstrip("\r\n"), qual.decode().rstrip("\r\n")


class _Files(InputPartition):
    def __init__(self, first: str, second: str | None) -> None:
        super().__init__((first, second))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        first, second = expand(options["path"]), expand(options.get("path2", ""))
        if second and len(first) != len(second):
            raise ValueError("as many second files as first ones are needed")
        self.files, self.interleaved = list(zip_longest(first, second)), options.get("interleaved", "false").lower() == "true"

    def partitions(self):
        return [_Files(*x) for x in self.files]

    def read(self, partition):
        first, second = partition.value
        if second:
            rows = self._zipped(first, second)
        elif self.interleaved:
            rows = self._by_two(first)
        else:
            rows = ((*read,) for read in parse(first))
        at = 0
        while held := list(islice(rows, BATCH)):
            columns = list(zip(*held, strict=True))
            if second or self.interleaved:
                columns = [[dict(zip(("id", "seq", "qual"), r, strict=True)) for r in c] for c in columns]
            names = ["r1", "r2"] if second or self.interleaved else ["id", "seq", "qual"]
            kind = _READ if second or self.interleaved else pa.string()
            yield pa.RecordBatch.from_arrays([pa.array([first] * len(held)), pa.array(range(at, at + len(held)), pa.int64()), *(pa.array(c, kind) for c in columns)], ["file", "ord", *names])
            at += len(held)

    @staticmethod
    def _zipped(first: str, second: str) -> Iterator[tuple]:
        for a, b in zip_longest(parse(first), parse(second)):
            if a is None or b is None:
                raise ValueError(f"{first} and {second} hold unequal numbers of reads")
            yield a, b

    @staticmethod
    def _by_two(path: str) -> Iterator[tuple]:
        reads = parse(path)
        for a in reads:
            if (b := next(reads, None)) is None:
                raise ValueError(f"{path} holds an odd number of reads")
            yield a, b


class Reads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> str:
        paired = self.options.get("path2") or self.options.get("interleaved", "false").lower() == "true"
        return f"file string, ord long, r1 {READ}, r2 {READ}" if paired else "file string, ord long, id string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def record_text(id_, seq, qual, mate: int | None = None):
    """Four lines of a record; paired reads get /1 or /2 behind their id."""
    name = F.concat(F.lit("@"), id_, F.lit(f"/{mate}" if mate else ""))
    return F.concat_ws("\n", name, seq, F.lit("+"), qual)


def write_single(df: DataFrame, path: str, mate: int | None = None, compression: str = "gzip") -> None:
    df.select(record_text(F.col("id"), F.col("seq"), F.col("qual"), mate).alias("value")).write.option("compression", compression).text(path)


def _order(df: DataFrame) -> list[str]:
    """Columns that order pairs: file and place, then the reads themselves where places repeat."""
    return [*(c for c in ("file", "ord") if c in df.columns), "r1", "r2"]


def write_paired(df: DataFrame, path1: str, path2: str, compression: str = "gzip", mode: str = "errorifexists") -> None:
    """Two folders whose part files hold the mates in the same order.  One job writes both, each task
    the two files of its range, so that they cannot differ; mode may be append or overwrite."""
    spark, order = df.sparkSession, _order(df)
    text = lambda m: record_text(F.col(f"r{m}.id"), F.col(f"r{m}.seq"), F.col(f"r{m}.qual"), m)
    both = df.repartitionByRange(*order).select(*order, F.explode(F.array(*[F.struct(F.lit(m).alias("mate"), text(m).alias("value")) for m in (1, 2)])).alias("x"))
    sorted_ = both.select(*order, "x.mate", "x.value").sortWithinPartitions("mate", *order).select("mate", "value")
    target = f"{path1}.writing-{uuid.uuid4().hex}"
    sorted_.write.option("compression", compression).partitionBy("mate").text(target)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    store = folder(target).getFileSystem(spark._jsc.hadoopConfiguration())
    for m, path in ((1, path1), (2, path2)):
        made, wanted = folder(f"{target}/mate={m}"), folder(path)
        if mode == "overwrite":
            store.delete(wanted, True)
        if store.exists(wanted) and mode != "append":
            raise FileExistsError(path)
        store.mkdirs(wanted if mode == "append" else wanted.getParent())
        if not store.exists(made):  # no pairs
            store.mkdirs(wanted)
        elif mode == "append":
            for part in store.listStatus(made):
                store.rename(part.getPath(), folder(wanted, f"{_next(store, wanted):05d}-{part.getPath().getName()}"))
        else:
            store.rename(made, wanted)
    store.delete(folder(target), True)


def _next(store, path) -> int:
    """Number for a further part file, so that appended parts come after the others by name."""
    return len(store.listStatus(path))


def write_interleaved(df: DataFrame, path: str, compression: str = "gzip") -> None:
    both = F.concat_ws("\n", *[record_text(F.col(f"r{m}.id"), F.col(f"r{m}.seq"), F.col(f"r{m}.qual"), m) for m in (1, 2)])
    order = _order(df)
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(both.alias("value")).write.option("compression", compression).text(path)


def recode(spark, in1: str, in2: str, out1: str, out2: str) -> None:
    """Paired files of any codec to gzip."""
    spark.dataSource.register(Reads)
    write_paired(spark.read.format("reads").option("path2", in2).load(in1), out1, out2)
