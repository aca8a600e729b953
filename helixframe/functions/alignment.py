"""Column functions over alignment records: flag bits, CIGAR measures, tags and derived metrics.

All are built-in expressions.  Measures of an invalid or missing CIGAR are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits of the SAM format.
FLAG_BITS = {
    "is_paired": 0x1,
    "is_proper": 0x2,
    "is_unmapped": 0x4,
    "is_mate_unmapped": 0x8,
    "is_reverse": 0x10,
    "is_mate_reverse": 0x20,
    "is_read1": 0x40,
    "is_read2": 0x80,
    "is_secondary": 0x100,
    "is_supplementary": 0x800,
}
U32_MAX = 4294967295


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_flag(flag, name: str) -> Column:
    return _c(flag).bitwiseAND(FLAG_BITS[name]) != 0


def is_mapped(flag) -> Column:
    return ~has_flag(flag, "is_unmapped")


def is_primary(flag) -> Column:
    """Neither secondary nor supplementary."""
    return _c(flag).bitwiseAND(FLAG_BITS["is_secondary"] | FLAG_BITS["is_supplementary"]) == 0


def mate_of(flag) -> Column:
    """1 for first reads, 2 for all others."""
    return F.when(has_flag(flag, "is_read1"), F.lit(1)).otherwise(F.lit(2))


def flag_columns(flag) -> dict[str, Column]:
    out = {name: has_flag(flag, name) for name in FLAG_BITS}
    return out | {"is_mapped": is_mapped(flag), "is_mate_mapped": ~has_flag(flag, "is_mate_unmapped"), "is_primary": is_primary(flag)}


def cigar_is_valid(cigar) -> Column:
    """Runs of digits and known operators; digits at the end are allowed and ignored."""
    return (_c(cigar) != "*") & _c(cigar).rlike("^([0-9]*[MIDNSHPX=])*[0-9]*$") & (F.length(_c(cigar)) > 0)


def _operator_sum(cigar: Column, operators: str) -> Column:
    numbers = F.regexp_extract_all(cigar, F.lit(f"([0-9]*)[{operators}]"), 1)
    # an operator without a number counts 0; numbers beyond 32 bits saturate
    one = lambda x: F.least(F.coalesce(F.try_to_number(x, F.lit("9" * 18)).cast("long"), F.when(x == "", F.lit(0)).otherwise(F.lit(U32_MAX))).cast("long"), F.lit(U32_MAX))
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + one(x))


def cigar_sum(cigar, operators: str) -> Column:
    """Summed lengths of the given operators, null if the CIGAR is missing or invalid."""
    return F.when(cigar_is_valid(cigar), _operator_sum(_c(cigar), operators))


def align_length(cigar) -> Column:
    return cigar_sum(cigar, "M=XID")


def indels(cigar) -> Column:
    return cigar_sum(cigar, "ID")


def soft_clips(cigar) -> Column:
    return cigar_sum(cigar, "S")


def read_length(cigar) -> Column:
    return cigar_sum(cigar, "M=XIS")


def reference_span(cigar) -> Column:
    return cigar_sum(cigar, "MDN=X")


def float_ratio(a: Column, b: Column) -> Column:
    """a / b rounded to 32 bits; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double")).cast("float")


def align_proportion(cigar, sequence_length: Column | None = None) -> Column:
    """Aligned share of the read.  Given a sequence length above 0 (binary records), that counts as
    the read's length, else the CIGAR's."""
    length = read_length(cigar)
    if sequence_length is not None:
        length = F.when(sequence_length > 0, sequence_length).otherwise(length)
    return float_ratio(align_length(cigar), F.when(length > 0, length))


def percent_identity(cigar, nm) -> Column:
    """100 * (aligned - NM) / aligned with 32-bit steps; a negative NM leaves no match."""
    al = align_length(cigar)
    match = F.when(_c(nm) < 0, F.lit(0).cast("long")).otherwise(F.greatest(al - _c(nm), F.lit(0).cast("long")))
    return F.when(_c(nm).isNotNull(), (float_ratio(match, F.when(al > 0, al)).cast("double") * 100).cast("float"))


def score_per_length(cigar, score) -> Column:
    al = align_length(cigar)
    return float_ratio(_c(score).cast("float"), F.when(al > 0, al))


def tag(tags, name: str) -> Column:
    """Raw value of the first tag of a two-letter name, whatever its type letter."""
    if len(name) != 2:
        return F.lit(None).cast("string")
    found = F.filter(_c(tags), lambda x: (F.substring(x, 1, 3) == f"{name}:") & (F.substring(x, 5, 1) == ":"))
    return F.substring(F.get(found, F.lit(0)), 6, 1 << 30)


def tag_int(tags, name: str) -> Column:
    value = tag(tags, name)
    return F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("int"))


def tag_float(tags, name: str) -> Column:
    value = tag(tags, name)
    return F.when(value.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("float"))


def lenient_unsigned(value, most: int) -> Column:
    """A whole number of the given range; anything else is 0."""
    v = F.when(_c(value).rlike("^[+]?[0-9]{1,18}$"), _c(value).try_cast("long"))
    return F.coalesce(F.when(v <= most, v), F.lit(0).cast("long"))


def qname_tokens(qname) -> Column:
    """struct(id, keyword, accession) of names with at least three colon-separated parts."""
    parts = F.split(_c(qname), ":")
    return F.when(F.size(parts) >= 3, F.struct(parts[0].alias("id"), parts[1].alias("keyword"), parts[2].alias("accession")))
