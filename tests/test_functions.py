"""Golden values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import alignment as A
from helixframe.functions import sequence as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    ("cigar", "want"),
    [
        ("10M2I3S", (12, 2, 3, 15, 10)),
        ("50M10I5D20S", (65, 15, 20, 80, 55)),
        ("50M10I5D100N20S", (65, 15, 20, 80, 155)),
        ("*", (None,) * 5),
        ("", (None,) * 5),
        ("5Q", (None,) * 5),
        ("M7", (0, 0, 0, 0, 0)),
        ("99999999999M", (4294967295, 0, 0, 4294967295, 4294967295)),
    ],
)
def test_cigar(spark, cigar, want):
    c = F.lit(cigar)
    assert one(spark, A.align_length(c), A.indels(c), A.soft_clips(c), A.read_length(c), A.reference_span(c)) == want


def test_metrics(spark):
    c = F.lit("10M2I3S")
    assert one(spark, A.score_per_length(c, F.lit(10)), A.percent_identity(c, F.lit(2))) == (pytest.approx(0.8333, abs=1e-4), pytest.approx(83.33, abs=1e-2))
    assert one(spark, A.percent_identity(F.lit("100M"), F.lit(5)), A.percent_identity(F.lit("10M"), F.lit(15))) == (95.0, 0.0)
    assert one(spark, A.align_proportion(F.lit("50M50S"), F.lit(100)), A.align_proportion(F.lit("50M10I20S"), F.lit(0))) == (0.5, 0.75)
    assert one(spark, A.percent_identity(F.lit("10M"), F.lit(None).cast("int")), A.percent_identity(F.lit("10M"), F.lit(-3))) == (None, 0.0)


def test_flags_and_tags(spark):
    f = F.lit(99)
    assert one(spark, A.has_flag(f, "is_read1"), A.has_flag(f, "is_proper"), A.has_flag(f, "is_reverse"), A.has_flag(f, "is_mate_reverse"), A.is_primary(f)) == (True, True, False, True, True)
    t = F.array(*map(F.lit, ("NM:i:2", "AS:i:10", "XZ:Z:dummy")))
    assert one(spark, A.tag_int(t, "NM"), A.tag_int(t, "AS"), A.tag(t, "XZ"), A.tag(t, "XX"), A.tag(t, "N"), A.tag_int(t, "XZ")) == (2, 10, "dummy", None, None, None)
    assert one(spark, A.lenient_unsigned(F.lit(" 12"), 100), A.lenient_unsigned(F.lit("70000"), 65535), A.lenient_unsigned(F.lit("+7"), 9)) == (0, 0, 7)


def test_sequences(spark):
    assert one(spark, S.reverse_complement(F.lit("ACGTacgtNn-"))) == ("-nNacgtACGT",)
    assert one(spark, S.kmers(F.lit("ACGT"), 3), S.kmers(F.lit("AC"), 3)) == (["ACG", "CGT"], [])
    assert one(spark, S.decode_kmer(S.encode_kmer(F.lit("ACGTACGT")), 8), S.encode_kmer(F.lit("acgn"))) == ("ACGTACGT", 0b00011000)
    assert one(spark, S.decode_kmer(S.encode_kmer(F.lit("T" * 32)), 32)) == ("T" * 32,)
    # unsigned order at 32 bases: all A is below all T
    assert one(spark, S.canonical_code(F.lit("T" * 32))) == (0,)
    with pytest.raises(ValueError):
        S.kmers(F.lit("A"), 0)
    with pytest.raises(Exception, match="longer than 32"):
        one(spark, S.encode_kmer(F.lit("A" * 33)))


@pytest.mark.parametrize(("line", "want"), [(">a", ("a", None)), (">a some text ", ("a", "some text")), (">a\tb", ("a", "b")), (">", ("", None))])
def test_fasta_header(spark, line, want):
    assert tuple(one(spark, S.fasta_header(F.lit(line)))[0]) == want


def test_minimizers_length_and_ascii(spark):
    a, b = F.lit("ACGT"), F.lit("GGGG")
    less, more, same = one(spark, S.is_minimizer_against(a, b), S.is_minimizer_against(b, a), S.is_minimizer_against(a, a))
    assert less != more and same is False
    assert one(spark, S.fasta_length(F.lit("ACGT")), S.fasta_length(F.lit(""))) == (4, 0)
    with pytest.raises(Exception, match="ASCII"):
        one(spark, S.kmers(F.lit("ACGÄT"), 2))
