"""Files written by the tests and read back."""

import bz2
import gzip
import struct

import pytest

from helixframe.sources import binary_alignments as B
from helixframe.sources import reads as R
from helixframe.sources import text as T


def test_fastq(spark, tmp_path):
    spark.dataSource.register(R.Reads)
    a, b = tmp_path / "a.fq.gz", tmp_path / "b.fq.bz2"
    a.write_bytes(gzip.compress(b"@x\nAC\n+\nII\n") + gzip.compress(b"@@y z\nG\n+\n@\n"))
    b.write_bytes(bz2.compress(b"@x\nTT\n+\nII\n@y\nC\n+\nI\n"))
    got = spark.read.format("reads").load(str(a)).orderBy("ord").collect()
    assert [(r.id, r.seq, r.qual) for r in got] == [("x", "AC", "II"), ("y z", "G", "@")]
    pair = spark.read.format("reads").option("path2", str(b)).load(str(a)).orderBy("ord").collect()
    assert [(r.r1.seq, r.r2.seq) for r in pair] == [("AC", "TT"), ("G", "C")]
    both = spark.read.format("reads").option("interleaved", "true").load(str(a)).collect()
    assert [(r.r1.id, r.r2.id) for r in both] == [("x", "y z")]


@pytest.mark.parametrize("text", [b"@x\nAC\n+\n", b"@x\nAC\n+\nII\n\n"])
def test_fastq_truncated(tmp_path, text):
    (tmp_path / "t.fq").write_bytes(text)
    with pytest.raises(ValueError, match="truncated"):
        list(R.parse(str(tmp_path / "t.fq")))


def test_binary_alignments(spark, tmp_path):
    path = str(tmp_path / "a.bam")
    tags = b"XXZabc\0" + b"XZf" + struct.pack("<f", 1.5) + b"NMC\x05" + b"ASi" + struct.pack("<i", 1000) + b"YYc\xfe"
    B.write_records(path, [("chr1", 100)], [("q1", 99, 0, 9, 60, [("M", 3), ("I", 1)], "ACGT", bytes([40] * 4), tags), ("q2", 4, -1, -1, 0, [], "ACN", b"\x01\x02\x03", b"")])
    spark.dataSource.register(B.BinaryAlignments)
    rows = spark.read.format("binary_alignments").load(path).orderBy("ord").collect()
    assert [(r.qname, r.flag, r.pos, r.cigar, r.seq, r.nm, r.as_score) for r in rows] == [("q1", 99, 9, "3M1I", "ACGT", 5, 1000), ("q2", 4, -1, "", "ACN", None, None)]
    assert B.int_tag(tags, b"YY") == -2 and B.int_tag(tags, b"XZ") is None and B.int_tag(tags, b"NA") is None
    refs = spark.read.format("binary_alignments").option("part", "references").load(path).collect()
    assert [(r.ref_name, r.ref_length) for r in refs] == [("chr1", 100)]
    (tmp_path / "bad.bam").write_bytes(gzip.compress(b"nope"))
    with pytest.raises(ValueError, match="not a binary"):
        list(B.read_records(str(tmp_path / "bad.bam")))


def test_bases():
    assert B.unpack_bases(b"\x12\x48", 4) == "ACGT" and B.unpack_bases(b"\x12\x4f", 3) == "ACG"
    assert B.unpack_cigar((0x30, 0x11, 0x22)) == "3M1I2D"


def test_sam(spark, tmp_path):
    p = tmp_path / "a.sam"
    p.write_text("@SQ\tSN:r\tLN:9\n@SQ\tSN:\tLN:3\nq\t99\tr\tx\t 7\t3M\t*\t0\t-5\tACG\tIII\tNM:i:1\n\nshort\n")
    rows = T.read_sam(spark, str(p)).orderBy("qname").collect()
    assert [(r.qname, r.flag, r.pos, r.mapq, r.tlen, r.tags) for r in rows] == [("q", 99, 0, 0, -5, ["NM:i:1"]), ("short", 0, 0, 0, 0, [])]
    assert [tuple(r) for r in T.sam_references(T.read_sam_header(spark, str(p))).collect()] == [("r", 9)]


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">a first one\nAC\nGT\n\n>b\nNN\n>c   x \n")
    assert [tuple(r) for r in T.read_fasta(spark, str(p)).orderBy("id").collect()] == [("a", "first one", "ACGT"), ("b", None, "NN"), ("c", "x", "")]


def test_tables(spark, tmp_path):
    p = tmp_path / "c.tsv"
    p.write_text("keyword\tid\tabundance\tfasta\tcircular\tsub_rate\tindel_rate\nK\ta\t0.5\tx.fa\tyes\t0.1\t0\n")
    r = T.read_table(spark, str(p), T.COMPOSE).first()
    assert (r.id, r.keyword, r.abundance, r.circular) == ("a", "K", 0.5, True)
    m = tmp_path / "m.tsv"
    m.write_text("r1\tc\nlone\nr2\td\n")
    assert sorted(map(tuple, T.read_reference_map(spark, str(m)).collect())) == [("r1", "c"), ("r2", "d")]
    n = tmp_path / "nodes.dmp"
    n.write_text("1\t|\t1\t|\tno rank\t|\t\t|\n9\t|\t1\t|\tspecies\t|\tX\t|\nbad\n")
    assert sorted(map(tuple, T.read_nodes(spark, str(n)).collect())) == [(1, "1", "no rank"), (9, "1", "species")]


def test_recode_of_a_folder_keeps_mates_together(spark, tmp_path):
    """Places repeat in every file of a folder; mates stay in step, part by part."""
    for m in (1, 2):
        (tmp_path / f"in{m}").mkdir()
        for f in range(3):
            text = "".join(f"@f{f}n{i}\nAC{'ACGT'[(f + i) % 4]}\n+\nIII\n" for i in range(50))
            (tmp_path / f"in{m}" / f"{f}.fq.bz2").write_bytes(bz2.compress(text.encode()))
    for source in (str(tmp_path), f"file://{tmp_path}"):
        out = [str(tmp_path / f"out{len(source)}-{m}") for m in (1, 2)]
        R.recode(spark, f"{source}/in1", f"{source}/in2", *out)
        parts = [sorted(p for p in __import__("pathlib").Path(o).glob("part-*")) for o in out]
        names = [[gzip.open(p, "rt").read().splitlines()[::4] for p in side] for side in parts]
        assert [[x[:-2] for x in p] for p in names[0]] == [[x[:-2] for x in p] for p in names[1]]
        assert [x[:-2] for p in names[0] for x in p] == [f"@f{f}n{i}" for f in range(3) for i in range(50)]


def test_duplicate_rules(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:r\tLN:5\n@SQ\tSN:r\tLN:9\n@SQ\tSN:s\tLN:0\n")
    assert [tuple(r) for r in T.sam_references(T.read_sam_header(spark, str(tmp_path / "a.sam"))).collect()] == [("r", 5)]
    (tmp_path / "m.tsv").write_text("r\tx\nr\ty\nshort\n")
    assert [tuple(r) for r in T.read_reference_map(spark, str(tmp_path / "m.tsv")).collect()] == [("r", "y")]
    (tmp_path / "nodes.dmp").write_text(" 7 \t|\t1\t|\tgenus\t|\tx\t|\n7\t|\t2\t|\t species \t|\tx\t|\nx\t|\t2\t|\tclass\t|\tx\t|\n")
    assert [tuple(r) for r in T.read_nodes(spark, str(tmp_path / "nodes.dmp")).collect()] == [(7, "2", "species")]


def test_bam_header_text(spark, tmp_path):
    path = str(tmp_path / "a.bam")
    B.write_records(path, [("r", 4)], [(f"q{i}", 4, -1, -1, 0, [], "A", b"\x01", b"") for i in range(10_000)], text="@HD\tVN:1.6\n")
    spark.dataSource.register(B.BinaryAlignments)
    assert spark.read.format("binary_alignments").option("part", "header").load(path).first().text == "@HD\tVN:1.6\n"
    d = spark.read.format("binary_alignments").load(path)
    assert d.count() == 10_000 and d.selectExpr("max(ord)").first()[0] == 9_999


def _varied(n):
    """Records of very different lengths, some larger than a block, whose qualities look like anything."""
    for i in range(n):
        size = 90_000 if i % 211 == 5 else i * 37 % 301
        yield (f"q{i}", 4 if i % 3 else 99, -1 if i % 3 else i % 2, -1 if i % 3 else i, i % 61, [("M", size)] if size else [], "ACGTN"[i % 5] * size, bytes((i * 31 + j * j) % 256 for j in range(size)), b"NMC" + bytes([i % 256]))


@pytest.mark.parametrize("split", [3_000, 70_000, 400_000])
def test_split_files_lose_no_record(spark, tmp_path, split):
    path = str(tmp_path / "a.bam")
    B.write_records(path, [("r", 9_000), ("s", 9)], _varied(2_000))
    want = [r[2:] for r in B.read_records(path)]
    size = (tmp_path / "a.bam").stat().st_size
    got = [r for at in range(0, size, split) for r in B.read_range(path, at, min(size, at + split))]
    assert [r[2:] for r in got] == want and [r[1] for r in got] == sorted({r[1] for r in got})
    if split == 70_000:
        spark.dataSource.register(B.BinaryAlignments)
        d = spark.read.format("binary_alignments").option("split", split).load(path)
        assert d.rdd.getNumPartitions() == -(-size // split) > 3
        assert [r.qname for r in d.orderBy("ord").select("qname").collect()] == [f"q{i}" for i in range(2_000)]


def test_split_of_other_files(tmp_path):
    """Files of one member or without records are read whole, or have empty ranges."""
    B.write_records(str(tmp_path / "none.bam"), [("r", 9)], [])
    size = (tmp_path / "none.bam").stat().st_size
    assert [r for at in range(0, size, 20) for r in B.read_range(str(tmp_path / "none.bam"), at, min(size, at + 20))] == []
    (tmp_path / "one.bam").write_bytes(gzip.compress(bytes(100_000)))
    with open(tmp_path / "one.bam", "rb") as raw:
        assert list(B.blocks.ranges(raw, 10)) == []
    B.write_records(str(tmp_path / "cut.bam"), [("r", 9)], list(_varied(500)))
    whole = (tmp_path / "cut.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(ValueError):
        list(B.read_range(str(tmp_path / "cut.bam"), 0, len(whole) // 2))
