"""Column functions over DNA strings: reverse complement, k-mers, two-bit codes, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(1 << 63)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq) -> Column:
    """Bases of either case are complemented; all other characters stay."""
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCAtgca"))


#: Windows are cut out of blocks of so many bases: finding a place in a text costs its distance.
KMER_BLOCK = 256


def kmer_blocks(seq, k: int) -> Column:
    """Overlapping blocks of KMER_BLOCK windows each; none if the sequence is shorter than k."""
    if k < 1:
        raise ValueError("k must be at least 1")
    s = _c(seq)
    s = F.when(s.rlike("[^\\x00-\\x7F]"), F.raise_error(F.lit("k-mers need ASCII text")).cast("string")).otherwise(s)
    starts = F.sequence(F.lit(0), F.floor((F.length(s) - k) / KMER_BLOCK).cast("int"))
    blocks = F.transform(starts, lambda i: F.substr(s, i * KMER_BLOCK + 1, F.lit(KMER_BLOCK + k - 1)))
    return F.when(F.length(s) >= k, blocks).otherwise(F.array().cast("array<string>"))


def kmers(seq, k: int) -> Column:
    """All windows of length k in order; none if the sequence is shorter; an error if it is not ASCII."""
    return F.flatten(F.transform(kmer_blocks(seq, k), lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - k + 1), lambda i: F.substr(b, i, F.lit(k)))))


def canonical(kmer) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(_c(kmer), reverse_complement(kmer))


def kmer_hash(kmer) -> Column:
    """64-bit hash of the canonical k-mer (our own hash; only equality and order within it count)."""
    return F.xxhash64(canonical(kmer))


def is_minimizer_against(kmer, other) -> Column:
    """Whether a k-mer's hash is less than another's; both are hashed in canonical form."""
    return kmer_hash(kmer) < kmer_hash(other)


def encode_kmer(kmer) -> Column:
    """Two bits a base, A 0, C 1, G 2, T 3 in either case, anything else 0; first base highest.

    Up to 32 bases; the code is the signed view of an unsigned 64-bit number."""
    k = _c(kmer)
    codes = F.translate(F.upper(k), "ACGT", "0123")
    digits = F.regexp_replace(codes, "[^0123]", "0")
    code = F.aggregate(F.split(digits, ""), F.lit(0).cast("long"), lambda a, x: F.when(x == "", a).otherwise(F.shiftleft(a, 2).bitwiseOR(x.cast("long"))))
    return F.when(F.length(k) <= 32, code).otherwise(F.raise_error(F.lit("k-mer longer than 32 bases")).cast("long"))


def decode_kmer(code, k: int) -> Column:
    letters = [F.substr(F.lit("ACGT"), F.shiftrightunsigned(_c(code), 2 * i).bitwiseAND(3).cast("int") + 1, F.lit(1)) for i in range(k - 1, -1, -1)]
    return F.concat(*letters)


def canonical_code(kmer) -> Column:
    """The lesser code, as unsigned numbers, of a k-mer and its reverse complement."""
    a, b = encode_kmer(kmer), encode_kmer(reverse_complement(kmer))
    return F.when(a.bitwiseXOR(F.lit(SIGN)) <= b.bitwiseXOR(F.lit(SIGN)), a).otherwise(b)


def fasta_header(line) -> Column:
    """struct(id, desc): the id runs to the first white space; an empty description is null."""
    s = F.regexp_replace(F.trim(_c(line)), "^>", "")
    ident = F.regexp_extract(s, r"^(\S*)", 1)
    desc = F.regexp_replace(F.substr(s, F.length(ident) + 1), r"^\s+|\s+$", "")
    return F.struct(ident.alias("id"), F.when(desc != "", desc).alias("desc"))


def fasta_length(seq) -> Column:
    """Bytes of a sequence."""
    return F.octet_length(_c(seq)).cast("long")


def split_contigs(seq, least: int = 1000, circular: Column | None = None) -> Column:
    """Runs without N of at least `least` bases; a circular sequence is first extended by its own
    start, if it is that long."""
    s = _c(seq)
    if circular is not None:
        s = F.when(circular & (F.length(s) >= least), F.concat(s, F.substring(s, 1, least))).otherwise(s)
    return F.filter(F.split(s, "[Nn]"), lambda x: F.length(x) >= least)


def known_bases(seq) -> Column:
    return F.length(F.translate(_c(seq), "Nn", ""))
