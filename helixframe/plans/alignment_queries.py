"""Queries over alignment rows derived from the test tables, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..operators import alignments as al
from ..operators import evaluation
from .fixtures import fixture, with_sql

# the alignment rows with flags and measures spelled out for the other engine
_X = """,
x AS (SELECT *, (flag & 4) <> 0 AS unmapped, (flag & 2304) = 0 AS is_primary, (flag & 2) <> 0 AS proper, (flag & 64) <> 0 AS read1,
  CASE WHEN (flag & 64) <> 0 THEN 1 ELSE 2 END AS mate,
  CASE WHEN cigar <> '*' THEN CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[M=XID]', 1), lambda v: CAST(v AS BIGINT))), 0) AS BIGINT) END AS al,
  CASE WHEN cigar <> '*' THEN CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[ID]', 1), lambda v: CAST(v AS BIGINT))), 0) AS BIGINT) END AS indels,
  CASE WHEN cigar <> '*' THEN CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)S', 1), lambda v: CAST(v AS BIGINT))), 0) AS BIGINT) END AS soft,
  CASE WHEN cigar <> '*' THEN CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[M=XIS]', 1), lambda v: CAST(v AS BIGINT))), 0) AS BIGINT) END AS rl,
  CASE WHEN cigar <> '*' THEN CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda v: CAST(v AS BIGINT))), 0) AS BIGINT) END AS span,
  TRY_CAST(nullif(regexp_extract(tags, 'NM:i:(-?[0-9]+)', 1), '') AS INTEGER) AS nm,
  TRY_CAST(nullif(regexp_extract(tags, 'AS:i:(-?[0-9]+)', 1), '') AS INTEGER) AS as_score FROM aln),
m AS (SELECT *, CAST(CAST(al AS DOUBLE) / nullif(rl, 0) AS FLOAT) AS ap,
  CASE WHEN nm IS NOT NULL THEN CAST(CAST(CAST(CAST(CASE WHEN nm < 0 THEN 0 ELSE greatest(al - nm, 0) END AS DOUBLE) / nullif(al, 0) AS FLOAT) AS DOUBLE) * 100 AS FLOAT) END AS pi,
  CAST(CAST(as_score AS DOUBLE) / nullif(al, 0) AS FLOAT) AS sl FROM x)
"""


def _aln(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "aln").withColumn("tags", F.split("tags", " "))


def _sql(body: str, *more: str) -> str:
    return with_sql("aln", *more) + _X + body


def flag_decode(spark, sf):
    d = _aln(spark, sf)
    flags = A.flag_columns("flag")
    return d.groupBy(*[c.alias(n) for n, c in flags.items()]).agg(F.count("*").alias("n"), F.sum("flag").alias("flag_sum"))


FLAG_DECODE = _sql("SELECT " + ", ".join(f"(flag & {b}) <> 0 AS {n}" for n, b in A.FLAG_BITS.items()) + """,
  (flag & 4) = 0 AS is_mapped, (flag & 8) = 0 AS is_mate_mapped, (flag & 2304) = 0 AS is_primary, count(*) AS n, CAST(sum(flag) AS BIGINT) AS flag_sum
  FROM aln GROUP BY ALL""")


def tag_extract(spark, sf):
    return _aln(spark, sf).select("qname", "ord", A.tag_int("tags", "NM").cast("double").alias("nm"), A.tag_int("tags", "AS").cast("double").alias("as_score"), A.tag("tags", "XZ").alias("xz"), A.tag("tags", "XX").alias("xx"), A.tag_float("tags", "NM").cast("double").alias("nm_float"))


TAG_EXTRACT = _sql("SELECT qname, ord, CAST(nm AS DOUBLE) AS nm, CAST(as_score AS DOUBLE) AS as_score, nullif(regexp_extract(tags, 'XZ:Z:([^ ]*)', 1), '') AS xz, CAST(NULL AS VARCHAR) AS xx, CAST(nm AS DOUBLE) AS nm_float FROM x")


def qname_tokens(spark, sf):
    name = F.when(F.col("k") % 3 == 0, F.concat_ws(":", "qname", "rname")).otherwise(F.concat_ws(":", "qname", "rname", F.concat(F.lit("acc"), "mapq"), "ord"))
    d = _aln(spark, sf).withColumn("t", A.qname_tokens(name)).filter("t IS NOT NULL")
    return d.groupBy("t.keyword", "t.accession").agg(F.count("*").alias("n"), F.min("t.id").alias("least_id"))


QNAME_TOKENS = _sql("SELECT rname AS keyword, 'acc' || mapq AS accession, count(*) AS n, min(qname) AS least_id FROM aln WHERE k % 3 <> 0 GROUP BY 1, 2")


def cigar_summary(spark, sf):
    return _aln(spark, sf).select("qname", "ord", *[f("cigar").cast("double").alias(n) for n, f in (("al", A.align_length), ("indels", A.indels), ("soft", A.soft_clips), ("rl", A.read_length))])


CIGAR_SUMMARY = _sql("SELECT qname, ord, CAST(al AS DOUBLE) AS al, CAST(indels AS DOUBLE) AS indels, CAST(soft AS DOUBLE) AS soft, CAST(rl AS DOUBLE) AS rl FROM x")


def ref_span(spark, sf):
    return _aln(spark, sf).select("qname", "ord", A.reference_span("cigar").cast("double").alias("span"))


REF_SPAN = _sql("SELECT qname, ord, CAST(span AS DOUBLE) AS span FROM x")


def align_metrics(spark, sf):
    return al.with_metrics(_aln(spark, sf)).select("qname", "ord", *[F.col(c).cast("double").alias(c) for c in ("al", "ap", "pi", "sl")])


ALIGN_METRICS = _sql("SELECT qname, ord, CAST(al AS DOUBLE) AS al, CAST(ap AS DOUBLE) AS ap, CAST(pi AS DOUBLE) AS pi, CAST(sl AS DOUBLE) AS sl FROM m")


def filter_lowpass(spark, sf):
    return al.low_pass(al.with_metrics(_aln(spark, sf)), ap=0.95, pi=95, mq=10).select("qname", "ord", "flag")


FILTER_LOWPASS = _sql("SELECT qname, ord, flag FROM m WHERE unmapped OR coalesce(ap <= CAST(0.95 AS FLOAT), false) OR coalesce(pi <= CAST(95 AS FLOAT), false) OR mapq <= 10")


def filter_highpass(spark, sf):
    return al.high_pass(al.with_metrics(_aln(spark, sf)), pi=90, al=30, **{"as": 20}).select("qname", "ord", "flag")


FILTER_HIGHPASS = _sql("SELECT qname, ord, flag FROM m WHERE NOT unmapped AND coalesce(pi >= CAST(90 AS FLOAT), true) AND coalesce(al >= 30, true) AND coalesce(as_score >= 20, true)")


def _low_reads(spark, sf):
    return al.to_reads(al.low_pass(al.with_metrics(_aln(spark, sf)).filter(A.is_primary("flag")), ap=0.95, pi=95, mq=10))


def filter_counters(spark, sf):
    events = al.mate_events(_low_reads(spark, sf)).agg(F.count_if((F.col("outcome") == "pair") & (F.col("_place") == 1)).alias("pairs_written"), F.count_if(F.col("outcome") == "orphan").alias("orphans"))
    primary = _aln(spark, sf).agg(F.floor(F.count_if(A.is_primary("flag")) / 2).alias("pairs_seen"))
    return primary.join(F.broadcast(events))  # one row each


_EVENTS = """,
r AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY ord) - 1 AS i FROM m WHERE {where}),
e AS (SELECT *, i // 2 AS g, count(*) OVER (PARTITION BY qname, i // 2) AS c, min(mate) OVER (PARTITION BY qname, i // 2) AS lo, max(mate) OVER (PARTITION BY qname, i // 2) AS hi FROM r)
"""
_LOW = "is_primary AND (unmapped OR coalesce(ap <= CAST(0.95 AS FLOAT), false) OR coalesce(pi <= CAST(95 AS FLOAT), false) OR mapq <= 10)"
FILTER_COUNTERS = _sql(_EVENTS.format(where=_LOW) + """SELECT (SELECT CAST(count(*) // 2 AS BIGINT) FROM x WHERE is_primary) AS pairs_seen,
  count(*) FILTER (c = 2 AND lo <> hi) // 2 AS pairs_written, count(*) FILTER (c = 1) AS orphans FROM e""")


def sam_to_fastq(spark, sf):
    return al.to_reads(_aln(spark, sf).filter(A.is_primary("flag")))


_ORIENTED = "CASE WHEN (flag & 16) <> 0 THEN reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) ELSE seq END AS seq, CASE WHEN (flag & 16) <> 0 THEN reverse(qual) ELSE qual END AS qual"
SAM_TO_FASTQ = _sql(f"SELECT qname, ord, mate, {_ORIENTED} FROM x WHERE is_primary")


def mate_pairs(spark, sf):
    d = al.mate_pairs(al.to_reads(_aln(spark, sf).filter(A.is_primary("flag"))))
    return d.select("qname", "pair", *[F.col(f"{r}.{c}").alias(f"{r}_{c}") for r in ("r1", "r2") for c in ("seq", "qual")])


MATE_PAIRS = _sql(_EVENTS.format(where="is_primary") + f""", o AS (SELECT qname, g, mate, {_ORIENTED} FROM e WHERE c = 2 AND lo <> hi)
SELECT qname, CAST(g AS BIGINT) AS pair, max(seq) FILTER (mate = 1) AS r1_seq, max(qual) FILTER (mate = 1) AS r1_qual, max(seq) FILTER (mate = 2) AS r2_seq, max(qual) FILTER (mate = 2) AS r2_qual FROM o GROUP BY 1, 2""")


def orphans(spark, sf):
    return al.orphans(al.to_reads(_aln(spark, sf).filter(A.is_primary("flag"))))


ORPHANS = _sql(_EVENTS.format(where="is_primary") + "SELECT qname, ord, mate FROM e WHERE c = 1")


def name_run_pairs(spark, sf):
    d = al.name_runs(_aln(spark, sf))
    return d.select("qname", *[(F.col(f"{r}.{c}") if c == "cigar" else F.col(f"{r}.{c}").cast("double")).alias(f"{r}_{c}") for r in ("r1", "r2") for c in ("ord", "pos", "cigar")])


_RUNS = """, p AS (SELECT * FROM x WHERE is_primary AND proper),
n AS (SELECT qname, max(ord) FILTER (read1) AS o1, max(ord) FILTER ((flag & 128) <> 0) AS o2 FROM p GROUP BY qname)
"""
NAME_RUN_PAIRS = _sql(_RUNS + """SELECT n.qname, CAST(o1 AS DOUBLE) AS r1_ord, CAST(a.pos AS DOUBLE) AS r1_pos, a.cigar AS r1_cigar, CAST(o2 AS DOUBLE) AS r2_ord, CAST(b.pos AS DOUBLE) AS r2_pos, b.cigar AS r2_cigar
FROM n LEFT JOIN p AS a ON a.qname = n.qname AND a.ord = o1 LEFT JOIN p AS b ON b.qname = n.qname AND b.ord = o2""")


def insert_size(spark, sf):
    # few references, so that pairs meet on one: the mates of two thirds of the names do not
    d = _aln(spark, sf).withColumn("rname", F.expr("concat('ref', CAST(CAST(substring(rname, 4) AS BIGINT) % 3 AS STRING))"))
    return al.insert_sizes(al.name_runs(d), least_mapq=5)


INSERT_SIZE = _sql(_RUNS + """, i AS (SELECT n.qname, CASE WHEN a.pos <= b.pos THEN b.pos + b.span - a.pos ELSE a.pos + a.span - b.pos END AS insert_size
FROM n JOIN p AS a ON a.qname = n.qname AND a.ord = o1 JOIN p AS b ON b.qname = n.qname AND b.ord = o2 WHERE a.mapq >= 5 AND b.mapq >= 5 AND a.pos > 0 AND b.pos > 0 AND CAST(substring(a.rname, 4) AS BIGINT) % 3 = CAST(substring(b.rname, 4) AS BIGINT) % 3)
SELECT qname, insert_size FROM i WHERE insert_size > 0 AND insert_size <= 1000""")


def pair_count(spark, sf):
    return _aln(spark, sf).agg(F.count_distinct("qname").alias("n_pairs"))


PAIR_COUNT = _sql("SELECT count(DISTINCT qname) AS n_pairs FROM aln")


def global_counters(spark, sf):
    return al.global_counters(_aln(spark, sf))


GLOBAL_COUNTERS = _sql("""SELECT CASE WHEN read1 THEN 1 ELSE 2 END AS mate, count(*) FILTER (unmapped) AS unaligned, count(*) FILTER (NOT unmapped) AS alignments,
  count(*) FILTER (NOT unmapped AND is_primary) AS primary_mapped, count(*) FILTER (NOT unmapped AND is_primary AND mapq > 0) AS primary_mapq_above_0,
  count(*) FILTER (NOT unmapped AND is_primary AND mapq = 0) AS primary_mapq_0, count(*) FILTER (NOT unmapped AND is_primary AND (flag & 8) <> 0) AS singletons,
  count(*) FILTER (NOT unmapped AND is_primary AND (flag & 8) = 0 AND proper) AS concordant, count(*) FILTER (NOT unmapped AND is_primary AND (flag & 8) = 0 AND NOT proper) AS discordant,
  count(*) FILTER (NOT unmapped AND NOT is_primary) AS secondary, (SELECT count(DISTINCT qname) FROM aln) AS total_reads FROM x WHERE (flag & 192) <> 0 GROUP BY 1""")

_VALUES = """, w AS (SELECT * FROM m WHERE NOT unmapped AND is_primary AND mapq > 0),
v AS (SELECT mate, 'mapq' AS metric, CAST(least(mapq, 60) AS DOUBLE) AS value FROM w UNION ALL SELECT mate, 'align_score', least(CAST(as_score AS DOUBLE), 300) FROM w WHERE as_score IS NOT NULL
UNION ALL SELECT mate, 'align_length', least(CAST(al AS DOUBLE), 150) FROM w WHERE al IS NOT NULL UNION ALL SELECT mate, 'as_al', least(CAST(sl AS DOUBLE), 2) FROM w WHERE sl IS NOT NULL
UNION ALL SELECT mate, 'align_proportion', least(CAST(ap AS DOUBLE), 1) FROM w WHERE ap IS NOT NULL UNION ALL SELECT mate, 'percent_identity', least(CAST(pi AS DOUBLE), 100) FROM w WHERE pi IS NOT NULL)
"""


def metric_summary(spark, sf):
    d = al.metric_summary(al.capped_metrics(_aln(spark, sf)), "mate", "metric")
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "stdev", "median")})


METRIC_SUMMARY = _sql(_VALUES + "SELECT mate, metric, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS stdev, min(value) AS least, max(value) AS greatest FROM v GROUP BY 1, 2")


def report_histogram(spark, sf):
    return al.report_histograms(al.capped_metrics(_aln(spark, sf)))


REPORT_HISTOGRAM = _sql(_VALUES + """, c AS (SELECT * FROM (VALUES ('mapq', 61::DOUBLE, 1::DOUBLE), ('align_score', 301, 1), ('align_length', 151, 1), ('as_al', 2.01, 0.01), ('align_proportion', 1.01, 0.01), ('percent_identity', 101, 1)) AS t(metric, most, width))
SELECT mate, metric, CAST(floor(value / width) AS BIGINT) AS bin, count(*) AS n FROM v JOIN c USING (metric) WHERE value >= 0 AND value < most GROUP BY 1, 2, 3""")


def dynamic_histogram(spark, sf):
    """Alignment scores of each reference over their own range."""
    d = al.with_metrics(_aln(spark, sf)).filter("as_score IS NOT NULL").select("rname", F.col("as_score").cast("double").alias("value"))
    return al.dynamic_histogram(d, "rname")


DYNAMIC_HISTOGRAM = _sql(""", u AS (SELECT rname, CAST(as_score AS DOUBLE) AS v FROM m WHERE as_score IS NOT NULL),
g AS (SELECT rname, CASE WHEN min(v) = max(v) THEN min(v) - 1 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 1 ELSE max(v) END AS hi FROM u GROUP BY 1)
SELECT rname, CAST(floor((v - lo) / ((hi + (hi - lo) * 0.05::DOUBLE - lo) / 100)) AS BIGINT) AS bin, count(*) AS n FROM u JOIN g USING (rname) GROUP BY 1, 2""")


def cycle_quality_hist(spark, sf):
    reads = al.to_reads(_aln(spark, sf).filter(A.is_primary("flag")))
    cycles = reads.select("mate", F.posexplode(F.split("qual", "")).alias("cycle", "c")).filter("c <> ''")
    return cycles.groupBy("mate", "cycle", (F.ascii("c") - 33).alias("quality")).agg(F.count("*").alias("n"))


CYCLE_QUALITY_HIST = _sql(f""", o AS (SELECT mate, {_ORIENTED} FROM x WHERE is_primary), c AS (SELECT mate, unnest(range(0, length(qual))) AS cycle, qual FROM o)
SELECT mate, CAST(cycle AS INTEGER) AS cycle, CAST(ascii(substring(qual, cycle + 1, 1)) - 33 AS INTEGER) AS quality, count(*) AS n FROM c GROUP BY 1, 2, 3""")

# every covered position on its own, then runs of equal depth by their borders
_DEPTH = """, a AS (SELECT qname, ord, rname, greatest(pos - 1, 0) AS s, is_primary, regexp_extract_all(cigar, '[0-9]+[M=XDN]') AS ops FROM x WHERE cigar <> '*'{where}),
b AS (SELECT *, unnest(range(1, len(ops) + 1)) AS j FROM a),
o AS (SELECT rname, is_primary, s + coalesce(CAST(list_sum(list_transform(list_slice(ops, 1, j - 1), lambda v: CAST(left(v, -1) AS BIGINT))) AS BIGINT), 0) AS o, CAST(left(ops[j], -1) AS BIGINT) AS n, right(ops[j], 1) AS k FROM b),
q AS (SELECT rname, is_primary, k, unnest(range(o, o + n)) AS p FROM o WHERE k IN ('M', '=', 'X')),
d AS (SELECT ref_name, ref_length, p, count(*) FILTER (is_primary) AS pd, count(*) FILTER (NOT is_primary) AS sd, count(*) FILTER (is_primary AND k = 'X') AS md FROM q JOIN refs ON rname = ref_name WHERE p < ref_length GROUP BY 1, 2, 3)
"""


def coverage_depth(spark, sf):
    runs = al.coverage_runs(_aln(spark, sf), fixture(spark, sf, "refs"))
    # positions with depth, from runs: what a dense report would list
    each = runs.select("ref_name", F.explode(F.sequence("start", F.col("stop") - 1)).alias("position"), "primary_depth", "secondary_depth", "mismatch_depth")
    return each


COVERAGE_DEPTH = _sql(_DEPTH.format(where="") + "SELECT ref_name, p AS position, pd AS primary_depth, sd AS secondary_depth, md AS mismatch_depth FROM d", "refs")


def coverage_summary(spark, sf):
    return al.coverage_summary(al.high_pass(al.with_metrics(_aln(spark, sf)), mq=5), fixture(spark, sf, "refs"))


COVERAGE_SUMMARY = _sql(_DEPTH.format(where=" AND NOT unmapped AND mapq >= 5") + """,
c AS (SELECT ref_name, ref_length, count(*) FILTER (is_primary) AS pr, count(*) FILTER (NOT is_primary) AS sr, count(*) FILTER (is_primary AND proper) AS pc,
  count(*) FILTER (NOT is_primary AND proper) AS sc FROM x JOIN refs ON rname = ref_name WHERE NOT unmapped AND mapq >= 5 GROUP BY 1, 2),
t AS (SELECT ref_name, CAST(sum(pd) AS BIGINT) AS pb, CAST(sum(pd + sd) AS BIGINT) AS ab, CAST(sum(md) AS BIGINT) AS mm, count(*) FILTER (pd > 0) AS pp, count(*) AS ap, count(*) FILTER (md > 0) AS mp FROM d GROUP BY 1),
f AS (SELECT ref_name, ref_length, pr, sr, pc, sc, coalesce(pb, 0) AS pb, coalesce(ab, 0) AS ab, coalesce(mm, 0) AS mm, coalesce(pp, 0) AS pp, coalesce(ap, 0) AS ap, coalesce(mp, 0) AS mp FROM c LEFT JOIN t USING (ref_name) WHERE pr > 0)
SELECT ref_name, ref_length, ab AS aligned_bases, trunc(CAST(ap AS DOUBLE) / ref_length * 10000) / 10000 AS aligned_cov_ratio,
  CASE WHEN ab > 0 THEN trunc(CAST(ab - mm AS DOUBLE) / ab * 10000) / 10000 ELSE 0 END AS aligned_cov_identity, trunc(CAST(ab AS DOUBLE) / nullif(ap, 0) * 10000) / 10000 AS aligned_pos_avg_cov,
  ap AS aligned_pos_covered, mp AS aligned_pos_mismatched, pp AS aligned_pos_primary, pr + sr AS aligned_reads, pr AS aligned_reads_primary, sr AS aligned_reads_secondary, mm AS aligned_bases_mismatches,
  pc AS aligned_reads_primary_concordant, sc AS aligned_reads_secondary_concordant, trunc(CAST(ab AS DOUBLE) / ref_length * 10000) / 10000 AS average_coverage,
  trunc(CAST(pb AS DOUBLE) / ref_length * 10000) / 10000 AS average_coverage_primary, trunc(CAST(pr + sr AS DOUBLE) / (ref_length / 1000.0::DOUBLE) * 10000) / 10000 AS rpk FROM f""", "refs")


def coverage_strings(spark, sf):
    return al.depth_strings(al.high_pass(al.with_metrics(_aln(spark, sf)), mq=5), fixture(spark, sf, "refs"))


COVERAGE_STRINGS = _sql(_DEPTH.format(where=" AND NOT unmapped AND mapq >= 5") + """, h AS (SELECT DISTINCT ref_name, ref_length FROM x JOIN refs ON rname = ref_name WHERE NOT unmapped AND mapq >= 5), g AS (SELECT ref_name, unnest(range(0, ref_length)) AS p FROM h)
SELECT ref_name, string_agg(CAST(coalesce(pd, 0) AS VARCHAR), ',' ORDER BY p) AS primary_coverage, string_agg(CAST(coalesce(sd, 0) AS VARCHAR), ',' ORDER BY p) AS secondary_coverage, string_agg(CAST(coalesce(md, 0) AS VARCHAR), ',' ORDER BY p) AS mismatch_coverage
FROM g LEFT JOIN d USING (ref_name, p) GROUP BY 1""", "refs")


def coverage_run_stats(spark, sf):
    return al.run_counters(al.with_metrics(_aln(spark, sf)), fixture(spark, sf, "refs"), al.passes(mq=5))


COVERAGE_RUN_STATS = _sql(""", k AS (SELECT * FROM x WHERE NOT unmapped AND mapq >= 5), h AS (SELECT k.* FROM k JOIN refs ON rname = ref_name)
SELECT (SELECT count(*) FROM aln) AS alignments_seen, (SELECT count(*) FROM k WHERE is_primary) AS passed_primary, (SELECT count(*) FROM k WHERE NOT is_primary) AS passed_secondary,
  (SELECT count(DISTINCT rname) FROM h WHERE is_primary) AS refs_primary, (SELECT count(DISTINCT rname) FROM h WHERE NOT is_primary) AS refs_secondary""", "refs")

# classification of pairs: the first read's reference decides, every third reference has no class
_CLASS = "CASE WHEN CAST(substring(rname, 4) AS BIGINT) % 3 <> 0 THEN concat('c', CAST(CAST(substring(rname, 4) AS BIGINT) % 2 AS STRING)) END"


def _classified(spark, sf):
    """Names get a truth as their second part; records without a place have no reference."""
    d = _aln(spark, sf)
    classes = d.select(F.col("rname").alias("ref_name"), F.expr(_CLASS).alias("classification")).filter("classification IS NOT NULL").distinct()
    number = F.substring("qname", 2, 18).cast("long")
    truth = F.when(number % 4 == 0, "Negative").when(number % 4 == 1, "c0").otherwise("c1")
    named = d.withColumns({"qname": F.concat_ws(":", "qname", truth, F.lit("acc"), F.lit("1")), "rname": F.when(F.col("pos") > 0, F.col("rname"))})
    return evaluation.classify(al.name_runs(named), classes)


def classify_pairs(spark, sf):
    return _classified(spark, sf).groupBy("pool").agg(F.count("*").alias("n"))


_CLASSIFIED = _RUNS + """, z AS (SELECT n.qname, o1, o2, CASE WHEN a.pos = 0 AND t = 'negative' THEN 'unmapped_tn' WHEN a.pos = 0 THEN 'unmapped_fn' WHEN t = 'negative' THEN 'control'
  WHEN CAST(substring(a.rname, 4) AS BIGINT) % 3 <> 0 AND 'c' || CAST(substring(a.rname, 4) AS BIGINT) % 2 = t THEN 'tp' ELSE 'cross' END AS pool
FROM (SELECT *, CASE CAST(substring(qname, 2) AS BIGINT) % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'c0' ELSE 'c1' END AS t FROM n WHERE o1 IS NOT NULL AND o2 IS NOT NULL) AS n JOIN p AS a ON a.qname = n.qname AND a.ord = o1)
"""
CLASSIFY_PAIRS = _sql(_CLASSIFIED + "SELECT pool, count(*) AS n FROM z GROUP BY 1")


def eval_histograms(spark, sf):
    return evaluation.pool_histograms(_classified(spark, sf))


EVAL_HISTOGRAMS = _sql(_CLASSIFIED.replace("FROM x WHERE", "FROM m WHERE") + """, u AS (SELECT pool, p.* FROM z JOIN p ON p.qname = z.qname AND (p.ord = o1 OR p.ord = o2) WHERE pool IN ('tp', 'control', 'cross')),
dup AS (SELECT pool, p.* FROM z JOIN p ON p.qname = z.qname AND p.ord = o1 WHERE o1 = o2 AND pool IN ('tp', 'control', 'cross')),
y AS (SELECT * FROM u UNION ALL SELECT * FROM dup),
v AS (SELECT pool, 'mapq' AS metric, CAST(mapq AS DOUBLE) AS value FROM y UNION ALL SELECT pool, 'align_length', al FROM y UNION ALL SELECT pool, 'percent_identity', pi FROM y
UNION ALL SELECT pool, 'align_score', as_score FROM y UNION ALL SELECT pool, 'as_al', sl FROM y UNION ALL SELECT pool, 'align_proportion', ap FROM y),
c AS (SELECT * FROM (VALUES ('mapq', 60::DOUBLE, 1::DOUBLE), ('align_score', 1000, 1), ('align_length', 1000, 1), ('as_al', 1000, 0.1), ('align_proportion', 1, 0.01), ('percent_identity', 100, 1)) AS t(metric, most, width))
SELECT pool, metric, CAST(round(least(greatest(value, 0), most) / width) AS BIGINT) AS bin, count(*) AS n FROM v JOIN c USING (metric) WHERE value IS NOT NULL GROUP BY 1, 2, 3""")

NAMES = (
    "flag_decode tag_extract qname_tokens cigar_summary ref_span align_metrics filter_lowpass filter_highpass filter_counters sam_to_fastq mate_pairs orphans name_run_pairs "
    "insert_size pair_count global_counters metric_summary report_histogram dynamic_histogram cycle_quality_hist coverage_depth coverage_summary coverage_strings coverage_run_stats classify_pairs eval_histograms"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
