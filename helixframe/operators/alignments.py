"""Filters, pairing, counters and coverage over alignment records.

Records are rows of qname, ord (place in the input within a name), flag, rname, pos (1-based, 0 if
unmapped), mapq, cigar, tags, seq and qual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import sequence as S

MEASURES = ("ap", "pi", "as", "al", "sl", "mq")


def with_metrics(df: DataFrame, sequence_length: Column | None = None) -> DataFrame:
    """Adds nm, as_score, al, ap, pi and sl (score per aligned base)."""
    d = df.withColumns({"nm": A.tag_int("tags", "NM"), "as_score": A.tag_int("tags", "AS"), "al": A.align_length("cigar")})
    return d.withColumns({"ap": A.align_proportion("cigar", sequence_length), "pi": A.percent_identity("cigar", "nm"), "sl": A.score_per_length("cigar", "as_score")})


def _measure(name: str) -> Column:
    column = F.col({"ap": "ap", "pi": "pi", "as": "as_score", "al": "al", "sl": "sl", "mq": "mapq"}[name])
    return column.cast("float") if name in ("ap", "pi", "sl") else column


def low_pass(df: DataFrame, **most) -> DataFrame:
    """Poorly aligned records: unmapped, or any given measure at or below its limit.  A missing
    measure decides nothing."""
    keep = A.has_flag("flag", "is_unmapped")
    for name, limit in most.items():
        limit_c = F.lit(limit).cast("float") if name in ("ap", "pi", "sl") else F.lit(limit)
        keep = keep | F.coalesce(_measure(name) <= limit_c, F.lit(False))
    return df.filter(keep)


def high_pass(df: DataFrame, **least) -> DataFrame:
    """Well aligned records: mapped, and no given measure below its limit.  A missing one passes."""
    return df.filter(passes(**least))


def passes(**least) -> Column:
    """The condition of high_pass."""
    keep = A.is_mapped("flag")
    for name, limit in least.items():
        limit_c = F.lit(limit).cast("float") if name in ("ap", "pi", "sl") else F.lit(limit)
        keep = keep & F.coalesce(_measure(name) >= limit_c, F.lit(True))
    return keep


def to_reads(df: DataFrame, orient: bool = True) -> DataFrame:
    """Reads as sequenced: reverse alignments are turned back unless orient is off."""
    turn = A.has_flag("flag", "is_reverse") if orient else F.lit(False)
    return df.select(
        "qname",
        "ord",
        A.mate_of("flag").alias("mate"),
        F.when(turn, S.reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"),
        F.when(turn, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"),
    )


def mate_events(reads: DataFrame) -> DataFrame:
    """The outcome of every read in input order, as a streaming mate map decides it.

    A read waits under its name until another comes: one of the other side makes a pair, one of the
    same side drops both.  Either way the name is free again, so reads two by two decide: the
    2i-th and (2i+1)-th read of a name meet, and an odd last one stays an orphan."""
    w = Window.partitionBy("qname").orderBy("ord")
    d = reads.withColumn("_i", F.row_number().over(w) - 1).withColumn("_g", F.floor(F.col("_i") / 2))
    pair = Window.partitionBy("qname", "_g").orderBy("ord")
    whole = Window.partitionBy("qname", "_g")
    return d.withColumns(
        {
            "outcome": F.when(F.count("*").over(whole) == 1, "orphan").when(F.min("mate").over(whole) == F.max("mate").over(whole), "collision").otherwise("pair"),
            "_place": F.row_number().over(pair),
        }
    )


def mate_pairs(reads: DataFrame) -> DataFrame:
    """(qname, pair, r1, r2): paired reads, r1 and r2 being structs of seq and qual."""
    d = mate_events(reads).filter("outcome = 'pair'")
    side = lambda m: F.max(F.when(F.col("mate") == m, F.struct("seq", "qual")))
    return d.groupBy("qname", F.col("_g").cast("long").alias("pair")).agg(side(1).alias("r1"), side(2).alias("r2"))


def orphans(reads: DataFrame) -> DataFrame:
    return mate_events(reads).filter("outcome = 'orphan'").select("qname", "ord", "mate")


def name_runs(df: DataFrame, gated: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """One row a name: its last first read and last second read.

    gated: only primary records of proper pairs count.  more: further columns of a record to keep."""
    d = df.filter(A.is_primary("flag") & A.has_flag("flag", "is_proper")) if gated else df
    record = F.struct("ord", "flag", "rname", "pos", "mapq", "cigar", "tags", *more)
    last = lambda m: F.max_by(F.when(A.has_flag("flag", m), record), F.when(A.has_flag("flag", m), F.col("ord")))
    return d.groupBy("qname").agg(last("is_read1").alias("r1"), last("is_read2").alias("r2"))


def insert_sizes(pairs: DataFrame, least_mapq: int = 40, most: int = 1000) -> DataFrame:
    """(qname, insert_size) of pairs on one reference with good mapping quality."""
    first = F.when(F.col("r1.pos") <= F.col("r2.pos"), F.col("r1")).otherwise(F.col("r2"))
    second = F.when(F.col("r1.pos") <= F.col("r2.pos"), F.col("r2")).otherwise(F.col("r1"))
    d = pairs.filter("r1 IS NOT NULL AND r2 IS NOT NULL").withColumns({"_a": first, "_b": second})
    size = F.col("_b.pos") + A.reference_span("_b.cigar") - F.col("_a.pos")
    ok = (F.col("r1.mapq") >= least_mapq) & (F.col("r2.mapq") >= least_mapq) & (F.col("r1.rname") == F.col("r2.rname")) & (F.col("r1.pos") > 0) & (F.col("r2.pos") > 0)
    return d.withColumn("insert_size", size).filter(ok & (F.col("insert_size") > 0) & (F.col("insert_size") <= most)).select("qname", "insert_size")


def global_counters(df: DataFrame) -> DataFrame:
    """Per mate: unaligned, alignments, primary by mapping quality and pairing, secondary; total_reads is
    the number of names, the same for both mates."""
    total = df.agg(F.count_distinct("qname").alias("total_reads"))  # one row
    mate = F.when(A.has_flag("flag", "is_read1"), 1).when(A.has_flag("flag", "is_read2"), 2)
    mapped, primary = A.is_mapped("flag"), A.is_primary("flag")
    both = mapped & primary
    single, proper = A.has_flag("flag", "is_mate_unmapped"), A.has_flag("flag", "is_proper")
    return (
        df.withColumn("mate", mate)
        .filter("mate IS NOT NULL")
        .groupBy("mate")
        .agg(
            F.count_if(~mapped).alias("unaligned"),
            F.count_if(mapped).alias("alignments"),
            F.count_if(both).alias("primary_mapped"),
            F.count_if(both & (F.col("mapq") > 0)).alias("primary_mapq_above_0"),
            F.count_if(both & (F.col("mapq") == 0)).alias("primary_mapq_0"),
            F.count_if(both & single).alias("singletons"),
            F.count_if(both & ~single & proper).alias("concordant"),
            F.count_if(both & ~single & ~proper).alias("discordant"),
            F.count_if(mapped & ~primary).alias("secondary"),
        )
        .join(F.broadcast(total))
    )


def capped_metrics(df: DataFrame, read_length: int = 150) -> DataFrame:
    """(mate, metric, value): measures of primary mapped records of mapping quality above 0, cut at
    their upper limits."""
    d = with_metrics(df).filter(A.is_mapped("flag") & A.is_primary("flag") & (F.col("mapq") > 0))
    caps = {"mapq": ("mapq", 60), "align_score": ("as_score", 2 * read_length), "align_length": ("al", read_length), "as_al": ("sl", 2), "align_proportion": ("ap", 1), "percent_identity": ("pi", 100)}
    cut = {m: F.least(F.col(c).cast("double"), F.lit(float(cap))).alias(m) for m, (c, cap) in caps.items()}
    mate = F.when(A.has_flag("flag", "is_read1"), 1).otherwise(2).alias("mate")
    wide = d.select(mate, *[F.when(F.col(c).isNotNull(), cut[m]).alias(m) for m, (c, _) in caps.items()])
    return wide.unpivot("mate", list(caps), "metric", "value").filter("value IS NOT NULL")


def metric_summary(values: DataFrame, *keys: str) -> DataFrame:
    """Count, mean, exact median, population deviation, least and greatest value of each group."""
    return values.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.percentile("value", 0.5).alias("median"),
        F.stddev_pop("value").alias("stdev"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
    )


def range_histogram(values: DataFrame, least: float, most: float, width: float, *keys: str) -> DataFrame:
    """(keys, bin, n): values in [least, most) by truncation to bins of a width."""
    inside = values.filter((F.col("value") >= least) & (F.col("value") < most))
    return inside.groupBy(*keys, F.floor((F.col("value") - least) / width).alias("bin")).agg(F.count("*").alias("n"))


def report_ranges(read_length: int = 150, most_insert: int = 1000) -> dict[str, tuple[float, float]]:
    """Upper end and bin width of each measure's histogram in a report; all begin at 0."""
    ranges = {"mapq": (61.0, 1.0), "align_score": (2.0 * read_length + 1, 1.0), "align_length": (read_length + 1.0, 1.0), "as_al": (2.01, 0.01)}
    return ranges | {"align_proportion": (1.01, 0.01), "percent_identity": (101.0, 1.0), "pe_insert_size": (float(most_insert), 10.0)}


def report_histograms(values: DataFrame, read_length: int = 150, most_insert: int = 1000, *keys: str) -> DataFrame:
    """(keys, metric, bin, n) of all measures, each over its own range and width; what lies outside is
    left out.  keys: mate by default."""
    ranges = report_ranges(read_length, most_insert)
    most, width = (F.coalesce(*[F.when(F.col("metric") == m, F.lit(r[i])) for m, r in ranges.items()]) for i in range(2))
    inside = values.filter((F.col("value") >= 0) & (F.col("value") < most))
    return inside.groupBy(*(keys or ("mate",)), "metric", F.floor(F.col("value") / width).alias("bin")).agg(F.count("*").alias("n"))


def dynamic_histogram(values: DataFrame, *keys: str, bins: int = 100) -> DataFrame:
    """As range_histogram, over each group's own range, widened by 5 % at the top; a single value gets a
    range of 1 to both sides first."""
    spread = values.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    same = F.abs(F.col("_hi") - F.col("_lo")) < 2.220446049250313e-16
    spread = spread.select(*keys, F.when(same, F.col("_lo") - 1).otherwise(F.col("_lo")).alias("_lo"), F.when(same, F.col("_hi") + 1).otherwise(F.col("_hi")).alias("_hi"))
    d = values.join(spread, list(keys)) if keys else values.crossJoin(F.broadcast(spread))  # one row
    width = (F.col("_hi") + (F.col("_hi") - F.col("_lo")) * 0.05 - F.col("_lo")) / bins
    return d.groupBy(*keys, F.floor((F.col("value") - F.col("_lo")) / width).alias("bin")).agg(F.count("*").alias("n"))


#: Positions that one task sweeps: a reference of any length is cut into tiles, and depth is carried over.
TILE = 1 << 20


_COUNTS = ("primary_reads", "secondary_reads", "primary_concordant", "secondary_concordant")


def depth_events(df: DataFrame) -> DataFrame:
    """(rname, at, primary, secondary, mismatch, counts): changes of depth at 0-based positions; at
    position 0 also the numbers of records.

    M and = raise the depth, X too and the mismatch depth; D and N only move on."""
    ops = F.regexp_extract_all("cigar", F.lit("([0-9]+[M=XDN])"), 1)
    start = F.greatest(F.col("pos") - 1, F.lit(0))
    step = F.struct(F.lit(0).cast("long").alias("o"), F.array().cast("array<struct<at:bigint,d:bigint,k:string>>").alias("runs"))

    def move(a, x):
        n, k = F.substring_index(F.substring_index(F.substring_index(F.substring_index(F.substring_index(x, "M", 1), "=", 1), "X", 1), "D", 1), "N", 1).cast("long"), F.right(x, F.lit(1))
        event = lambda at, d: F.struct(at.alias("at"), F.lit(d).cast("long").alias("d"), k.alias("k"))
        more = F.concat(a["runs"], F.array(event(a["o"], 1), event(a["o"] + n, -1)))
        return F.struct((a["o"] + n).alias("o"), F.when(k.isin("M", "=", "X"), more).otherwise(a["runs"]).alias("runs"))

    runs = F.when(A.cigar_is_valid("cigar"), F.aggregate(ops, step, move)["runs"])
    record = F.array(F.struct((-F.col("s")).alias("at"), F.lit(1).cast("long").alias("d"), F.lit("R").alias("k")))
    each = df.select("rname", start.alias("s"), A.is_primary("flag").alias("p"), A.has_flag("flag", "is_proper").alias("c"), runs.alias("runs"))
    ends = each.select("rname", "s", "p", "c", F.explode(F.concat(record, F.coalesce("runs", F.array().cast("array<struct<at:bigint,d:bigint,k:string>>")))).alias("e"))
    one = lambda name, c: F.sum(F.when(c, F.col("e.d")).otherwise(0)).alias(name)
    p, c, r = F.col("p"), F.col("c"), F.col("e.k") == "R"
    return ends.groupBy("rname", (F.col("s") + F.col("e.at")).alias("at")).agg(
        one("primary", p & ~r), one("secondary", ~p & ~r), one("mismatch", p & (F.col("e.k") == "X")),
        one("primary_reads", p & r), one("secondary_reads", ~p & r), one("primary_concordant", p & c & r), one("secondary_concordant", ~p & c & r),
    )


def _swept(changes: DataFrame, refs: DataFrame, tile: int) -> DataFrame:
    """Runs of equal depth, those without depth too, with the record counts that stand at position 0."""
    depths = ("primary", "secondary", "mismatch")
    events = changes.join(refs, F.col("rname") == F.col("ref_name")).filter(F.col("at") < F.col("ref_length")).withColumn("tile", F.floor(F.col("at") / tile))
    # a tile begins with the depth that the tiles before leave, and ends where the next events begin
    along = Window.partitionBy("ref_name").orderBy("tile")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    sums = events.groupBy("ref_name", "tile").agg(*[F.sum(c).alias(c) for c in depths], F.min("at").alias("first"))
    tiles = sums.select("ref_name", "tile", F.lead("first").over(along).alias("next"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in depths])
    w = Window.partitionBy("ref_name", "tile").orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return events.join(tiles, ["ref_name", "tile"]).select(
        "ref_name", "ref_length", F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), F.col("next"), F.col("ref_length")).alias("stop"),
        *[(F.sum(c).over(so_far) + F.col(f"{c}_before")).alias(f"{c}_depth") for c in depths], *_COUNTS,
    )


def coverage_runs(df: DataFrame, refs: DataFrame, tile: int = TILE) -> DataFrame:
    """(ref_name, start, stop, primary_depth, secondary_depth, mismatch_depth): runs of equal depth,
    0-based, stop excluded, clamped at the reference's end; runs without any depth are left out.

    A sweep over depth changes, so no position is materialised."""
    return _swept(depth_events(df), refs, tile).filter("primary_depth > 0 OR secondary_depth > 0").select("ref_name", "start", "stop", "primary_depth", "secondary_depth", "mismatch_depth")


def depth_strings(df: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_name, primary_coverage, secondary_coverage, mismatch_coverage): the depth of every position,
    joined by commas.  A string is as long as its reference, whatever the number of records."""
    runs = _swept(depth_events(df), refs, TILE)
    depths = ("primary", "secondary", "mismatch")
    first = runs.groupBy("ref_name", "ref_length").agg(F.min("start").alias("f"), F.sort_array(F.collect_list(F.struct("start", "stop", *[F.col(f"{c}_depth").alias(c) for c in depths]))).alias("r"))
    text = lambda c: F.array_join(F.concat(F.array_repeat(F.lit("0"), F.col("f").cast("int")), F.flatten(F.transform("r", lambda x: F.array_repeat(x[c].cast("string"), (x["stop"] - x["start"]).cast("int"))))), ",")
    return first.select("ref_name", *[text(c).alias(f"{c}_coverage") for c in depths])


def trunc4(x: Column) -> Column:
    """Cut after four decimals."""
    return (x * 10000).cast("long") / F.lit(10000.0)


def coverage_summary(df: DataFrame, refs: DataFrame, tile: int = TILE) -> DataFrame:
    """Summary of records; one scan."""
    return summary_of_events(depth_events(df), refs, tile)


def summary_of_events(changes: DataFrame, refs: DataFrame, tile: int = TILE) -> DataFrame:
    """Per reference with primary alignments: reads, bases, breadth, mean depth, identity and reads per
    kilobase; primary and secondary alignments together where a name does not tell."""
    n, some = F.col("stop") - F.col("start"), lambda c: F.sum(F.when(c, F.col("stop") - F.col("start")).otherwise(0))
    p, s, m = F.col("primary_depth"), F.col("secondary_depth"), F.col("mismatch_depth")
    d = _swept(changes, refs, tile).groupBy("ref_name", "ref_length").agg(
        *[F.sum(c).alias(c) for c in _COUNTS], F.sum(n * p).alias("primary_bases"), F.sum(n * (p + s)).alias("aligned_bases"), F.sum(n * m).alias("mismatches"),
        some(p > 0).alias("pos_primary"), some((p > 0) | (s > 0)).alias("pos_covered"), some(m > 0).alias("pos_mismatched"),
    ).filter("primary_reads > 0")
    per = lambda a, b: trunc4(F.try_divide(F.col(a).cast("double"), F.col(b)))
    reads = F.col("primary_reads") + F.col("secondary_reads")
    identity = F.when(F.col("aligned_bases") > 0, trunc4(F.greatest(F.col("aligned_bases") - F.col("mismatches"), F.lit(0)).cast("double") / F.col("aligned_bases"))).otherwise(F.lit(0.0))
    return d.select(
        "ref_name", "aligned_bases", per("pos_covered", "ref_length").alias("aligned_cov_ratio"), identity.alias("aligned_cov_identity"), per("aligned_bases", "pos_covered").alias("aligned_pos_avg_cov"),
        F.col("pos_covered").alias("aligned_pos_covered"), F.col("pos_mismatched").alias("aligned_pos_mismatched"), F.col("pos_primary").alias("aligned_pos_primary"),
        reads.alias("aligned_reads"), F.col("primary_reads").alias("aligned_reads_primary"), F.col("secondary_reads").alias("aligned_reads_secondary"), F.col("mismatches").alias("aligned_bases_mismatches"),
        F.col("primary_concordant").alias("aligned_reads_primary_concordant"), F.col("secondary_concordant").alias("aligned_reads_secondary_concordant"),
        per("aligned_bases", "ref_length").alias("average_coverage"), per("primary_bases", "ref_length").alias("average_coverage_primary"), "ref_length",
        trunc4(F.try_divide(reads.cast("double"), F.col("ref_length") / 1000.0)).alias("rpk"),
    )


def run_counters(df: DataFrame, refs: DataFrame, passed: Column) -> DataFrame:
    """One row: records seen, primary and secondary ones that pass, references that either of them hits."""
    known = df.withColumns({"_k": F.coalesce(passed, F.lit(False)), "_p": A.is_primary("flag")}).join(refs.select(F.col("ref_name").alias("_ref")), F.col("rname") == F.col("_ref"), "left")
    k, p = F.col("_k"), F.col("_p")
    return known.agg(
        F.count("*").alias("alignments_seen"), F.count_if(k & p).alias("passed_primary"), F.count_if(k & ~p).alias("passed_secondary"),
        F.count_distinct(F.when(k & p, F.col("_ref"))).alias("refs_primary"), F.count_distinct(F.when(k & ~p, F.col("_ref"))).alias("refs_secondary"),
    )
