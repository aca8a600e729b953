"""Queries over histograms, curves, lineages, allocations and DNA derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import histograms as H
from ..operators import evaluation, simulate, taxonomy
from .fixtures import fixture, with_sql

BINS = H.Bins(0, 60, 1)
POSITIVES, NEGATIVES = 2000, 2000
THRESHOLDS = [-1.0, 0.0, 10.0, 30.4, 60.0, 100.0]
K = 6

_POOLS = """,
v AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'tp' WHEN toxic = 1 THEN 'control' ELSE 'cross' END AS pool, score FROM scores),
h AS (SELECT pool, CAST(round(least(greatest(score, 0), 60)) AS BIGINT) AS bin, count(*) AS n FROM v GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY pool ORDER BY bin) AS BIGINT) AS run, CAST(sum(n) OVER (PARTITION BY pool) AS BIGINT) AS total FROM h)
"""


def _hist(spark: SparkSession, sf: str) -> DataFrame:
    pool = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "tp").when(F.col("toxic") == 1, "control").otherwise("cross")
    return H.build(fixture(spark, sf, "scores").withColumn("pool", pool), BINS, "pool", value="score")


def _sql(body: str) -> str:
    return with_sql("scores") + _POOLS + body


def hist_build(spark, sf):
    return _hist(spark, sf)


HIST_BUILD = _sql("SELECT pool, bin, n FROM h")


def hist_trim(spark, sf):
    return H.trim(_hist(spark, sf).filter("bin < 50"), BINS, "pool")


HIST_TRIM = _sql("SELECT pool, max(bin) + 1 AS n_bins, CAST(max(bin) AS DOUBLE) AS most FROM h WHERE bin < 50 GROUP BY 1")


def hist_cdf(spark, sf):
    return H.cdf(_hist(spark, sf), "pool")


HIST_CDF = _sql("SELECT pool, bin, n, CAST(run AS DOUBLE) / total AS cdf FROM c")


def hist_inverse_cdf(spark, sf):
    return H.inverse_cdf(_hist(spark, sf), BINS, [0.1, 0.5, 0.9], "pool")


HIST_INVERSE_CDF = _sql("SELECT pool, p, CAST(min(bin) AS DOUBLE) AS value FROM c, (SELECT unnest([0.1::DOUBLE, 0.5, 0.9]) AS p) WHERE CAST(run AS DOUBLE) / total >= p GROUP BY 1, 2")


def hist_percentile(spark, sf):
    d = H.percentile(_hist(spark, sf), BINS, [25.0, 50.0, 75.0, 101.0], "pool")
    return d.withColumn("value", F.round("value", 9))


HIST_PERCENTILE = _sql("""SELECT pool, p, CASE WHEN p <= 100 THEN round(min_by(bin + (p / 100 * total - run + n) / n, bin), 9) END AS value
FROM c, (SELECT unnest([25.0::DOUBLE, 50.0, 75.0, 101.0]) AS p) WHERE p > 100 OR run >= p / 100 * total GROUP BY 1, 2""")


def hist_stats(spark, sf):
    d = H.stats(_hist(spark, sf), BINS, "pool")
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "stdev", "sample_stdev")})


HIST_STATS = _sql("""SELECT pool, CAST(sum(n) AS BIGINT) AS total, round(sum(n * (bin + 0.5::DOUBLE)) / sum(n), 6) AS mean,
  round(sqrt((sum(n * (bin + 0.5::DOUBLE) * (bin + 0.5::DOUBLE)) - sum(n * (bin + 0.5::DOUBLE)) * sum(n * (bin + 0.5::DOUBLE)) / sum(n)) / sum(n)), 6) AS stdev,
  round(sqrt((sum(n * (bin + 0.5::DOUBLE) * (bin + 0.5::DOUBLE)) - sum(n * (bin + 0.5::DOUBLE)) * sum(n * (bin + 0.5::DOUBLE)) / sum(n)) / (sum(n) - 1)), 6) AS sample_stdev,
  max_by(bin, n * 1000 + bin) + 0.5::DOUBLE AS mode, CAST(min(bin) AS DOUBLE) AS observed_least, CAST(max(bin) + 1 AS DOUBLE) AS observed_most FROM h GROUP BY 1""")


def threshold_counts(spark, sf):
    return H.threshold_counts(_hist(spark, sf), BINS, THRESHOLDS, "pool")


_THRESHOLDS = "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in THRESHOLDS) + "]) AS threshold)"
THRESHOLD_COUNTS = _sql(f"SELECT pool, threshold, CAST(coalesce(sum(n) FILTER (bin >= round(threshold)), 0) AS BIGINT) AS n FROM h, {_THRESHOLDS} GROUP BY 1, 2")

_GRID = f"""
, g AS (SELECT bin, coalesce(sum(n) FILTER (pool = 'tp'), 0) AS tp, coalesce(sum(n) FILTER (pool <> 'tp'), 0) AS fp FROM h GROUP BY 1),
k AS (SELECT CAST(greatest({2 * NEGATIVES} + (SELECT coalesce(sum(n), 0) FROM h WHERE pool = 'cross'), 1) AS DOUBLE) AS nn, CAST({2 * POSITIVES} AS DOUBLE) AS pp),
s AS (SELECT bin, row_number() OVER (ORDER BY bin DESC) AS step, CAST(sum(tp) OVER (ORDER BY bin DESC) AS DOUBLE) AS t, CAST(sum(fp) OVER (ORDER BY bin DESC) AS DOUBLE) AS f FROM g),
y AS (SELECT step, f / nn AS fpr, t / pp AS tpr, CASE WHEN t + f > 0 THEN t / (t + f) ELSE 1.0 END AS precision FROM s, k),
l AS (SELECT max(step) AS c, max(fpr) AS f, max(tpr) AS t FROM y),
curve AS (SELECT * FROM y UNION ALL SELECT 0, 0, 0, 1 UNION ALL SELECT c + 1, 1, 1, pp / (pp + nn) FROM l, k WHERE f < 1 OR t < 1)
"""


def roc_curve(spark, sf):
    return H.curve(H.grid_counts(_hist(spark, sf), BINS), POSITIVES, NEGATIVES)


ROC_CURVE = _sql(_GRID + "SELECT CAST(step AS BIGINT) AS step, CAST(fpr AS DOUBLE) AS fpr, CAST(tpr AS DOUBLE) AS tpr, CAST(precision AS DOUBLE) AS precision FROM curve")


def roc_auc(spark, sf):
    return H.areas(roc_curve(spark, sf)).select(F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 9).alias("pr_auc"))


ROC_AUC = _sql(_GRID + """, z AS (SELECT *, lag(fpr) OVER (ORDER BY step) AS f0, lag(tpr) OVER (ORDER BY step) AS t0, lag(precision) OVER (ORDER BY step) AS p0 FROM curve)
SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 9) AS roc_auc, round(sum((tpr - t0) * (precision + p0) / 2), 9) AS pr_auc FROM z""")

GRID101 = [0.6 * i for i in range(101)]


def roc_grid101(spark, sf):
    """Counts and rates at 101 even thresholds over the score range."""
    return H.confusion(_hist(spark, sf), BINS, GRID101, POSITIVES, NEGATIVES).select("threshold", "tp", "fp", "recall", "fpr", "precision")


_CONFUSION = f"""
, tt AS (SELECT threshold, CAST(coalesce(sum(n) FILTER (pool = 'tp' AND bin >= round(threshold)), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (pool <> 'tp' AND bin >= round(threshold)), 0) AS BIGINT) AS fp
  FROM h, {{grid}} GROUP BY 1),
q AS (SELECT *, {2 * POSITIVES} - tp AS fn, {2 * NEGATIVES} + CAST((SELECT coalesce(sum(n), 0) FROM h WHERE pool = 'cross') AS BIGINT) - fp AS tn FROM tt),
r AS (SELECT threshold, tp, fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 1) AS precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall, CAST(fp AS DOUBLE) / nullif(fp + tn, 0) AS fpr,
  CAST(tn AS DOUBLE) / nullif(fp + tn, 0) AS specificity, CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0) AS accuracy, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 1) AS npv,
  CAST(tp + fn AS DOUBLE) / nullif(tp + fp + fn + tn, 0) AS prevalence, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM q)
"""
ROC_GRID101 = _sql(_CONFUSION.format(grid="(SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in GRID101) + "]) AS threshold)") + "SELECT threshold, tp, fp, recall, fpr, precision FROM r")


def confusion_metrics(spark, sf):
    return H.confusion(_hist(spark, sf), BINS, THRESHOLDS, POSITIVES, NEGATIVES)


CONFUSION_METRICS = _sql(_CONFUSION.format(grid=_THRESHOLDS) + "SELECT * FROM r")

def lineage_pivot(spark, sf):
    return taxonomy.lineage_pivot(fixture(spark, sf, "lineage"))


def lineage_table(spark, sf):
    """The pivot with its ids, of which many are missing, as doubles."""
    d = lineage_pivot(spark, sf)
    return d.withColumns({c: F.col(c).cast("double") for c in d.columns if c.endswith("_id")})


# written out from the format, not from the operator: ranks of the table and of the report
_TABLE_RANKS = "realm domain kingdom phylum subphylum class subclass order suborder family subfamily genus subgenus species subspecies".split()
_JSON_RANKS = "realm kingdom phylum class order family genus species".split()
_PIVOT = """, last AS (SELECT accession, max(entry) AS entry FROM lineage GROUP BY 1), n AS (SELECT lineage.* FROM lineage JOIN last USING (accession, entry)),
o AS (SELECT *, row_number() OVER (PARTITION BY accession, rank ORDER BY ordinal DESC) AS r FROM n),
t AS (SELECT accession, min(tax_id) AS tax_id, min(name) AS name, """ + ", ".join(f"max(node_id) FILTER (rank = '{r}' AND r = 1) AS {r}_id, max(node_name) FILTER (rank = '{r}' AND r = 1) AS {r}_name" for r in _TABLE_RANKS) + " FROM o GROUP BY 1)"
LINEAGE_TABLE = with_sql("lineage") + _PIVOT + " SELECT accession, name, CAST(tax_id AS DOUBLE) AS tax_id, " + ", ".join(f"CAST({r}_id AS DOUBLE) AS {r}_id, {r}_name" for r in _TABLE_RANKS) + " FROM t"


def lineage_lookup(spark, sf):
    return taxonomy.lineage_lookup(fixture(spark, sf, "refs"), lineage_pivot(spark, sf), "ref_name")


_PART = "CASE WHEN {i} IS NOT NULL AND {n} IS NOT NULL THEN '\"{k}\":{{\"tax_id\":' || {i} || ',\"name\":\"' || {n} || '\"}}' END"
_JSON = ", ".join([_PART.format(k="organism", i="tax_id", n="name"), *(_PART.format(k=r, i=f"{r}_id", n=f"{r}_name") for r in _JSON_RANKS)])
LINEAGE_LOOKUP = with_sql("lineage", "refs") + _PIVOT + f" SELECT ref_name, ref_length, CASE WHEN accession IS NOT NULL THEN '{{' || concat_ws(',', {_JSON}) || '}}' END AS lineage FROM refs LEFT JOIN t ON accession = ref_name"


def taxonomy_upsert(spark, sf):
    nodes = fixture(spark, sf, "lineage").select("accession", "node_id", "node_name", "rank", "ordinal")
    return taxonomy.upsert(nodes.filter("rank = 'genus'"), nodes.filter("rank IN ('species', 'no rank')"), "accession", "ordinal")


TAXONOMY_UPSERT = with_sql("lineage") + """, u AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY CASE WHEN rank = 'genus' THEN 0 ELSE 1 END DESC, ordinal DESC) AS r FROM lineage WHERE rank IN ('genus', 'species', 'no rank'))
SELECT accession, node_id, node_name, rank, ordinal FROM u WHERE r = 1"""


def allocate_reads(spark, sf):
    return taxonomy.allocate(fixture(spark, sf, "tasks"), 1_000_000)


def allocate_copies(spark, sf):
    return taxonomy.allocate(fixture(spark, sf, "tasks"), 1_000_000, by_copies=True)


_ALLOCATE = " SELECT id, abundance, genome_length, CAST(round({w} / sum({w}) OVER () * 1000000) AS BIGINT) AS reads FROM tasks"
ALLOCATE_READS = with_sql("tasks") + _ALLOCATE.format(w="abundance")
ALLOCATE_COPIES = with_sql("tasks") + _ALLOCATE.format(w="(abundance * CAST(genome_length AS DOUBLE))")


def genome_metrics(spark, sf):
    d = fixture(spark, sf, "seqs")
    return d.groupBy((F.col("doc_id") % 10).alias("genome")).agg(F.sum(S.known_bases("seq")).alias("genome_length"), F.count("*").alias("contigs"))


GENOME_METRICS = with_sql("seqs") + " SELECT doc_id % 10 AS genome, CAST(sum(length(replace(seq, 'N', ''))) AS BIGINT) AS genome_length, count(*) AS contigs FROM seqs GROUP BY 1"


def contig_chunks(spark, sf):
    d = fixture(spark, sf, "seqs").select("doc_id", S.split_contigs("seq", 100, F.col("doc_id") % 2 == 0).alias("c"))
    return d.select("doc_id", F.posexplode("c").alias("chunk", "s")).select("doc_id", "chunk", F.length("s").alias("n"), F.md5("s").alias("digest"))


CONTIG_CHUNKS = with_sql("seqs") + """, c AS (SELECT doc_id, list_filter(string_split(CASE WHEN doc_id % 2 = 0 AND length(seq) >= 100 THEN seq || substring(seq, 1, 100) ELSE seq END, 'N'), lambda s: length(s) >= 100) AS c FROM seqs),
u AS (SELECT doc_id, unnest(range(0, len(c))) AS chunk, c FROM c) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(length(c[chunk + 1]) AS INTEGER) AS n, md5(c[chunk + 1]) AS digest FROM u"""


def reverse_complement(spark, sf):
    return fixture(spark, sf, "seqs").select("doc_id", F.md5(S.reverse_complement("seq")).alias("digest"))


REVERSE_COMPLEMENT = with_sql("seqs") + " SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM seqs"

_KMERS = with_sql("seqs") + f", w AS (SELECT seq, unnest(range(1, greatest(length(seq) - {K - 2}, 1))) AS i FROM seqs), k AS (SELECT substring(seq, i, {K}) AS kmer, count(*) AS n FROM w GROUP BY 1)"
_CODE = f"CAST(list_sum(list_transform(range(1, {K + 1}), lambda j: greatest(instr('ACGT', substring(kmer, j, 1)) - 1, 0) * (4 ** ({K} - j))::BIGINT)) AS BIGINT)"


def _kmers(spark, sf):
    return taxonomy.kmer_counts(fixture(spark, sf, "seqs"), K)


def kmers(spark, sf):
    return _kmers(spark, sf)


KMERS = _KMERS + " SELECT kmer, n FROM k"


def canonical_kmers(spark, sf):
    return _kmers(spark, sf).groupBy(S.canonical("kmer").alias("kmer")).agg(F.sum("n").alias("n"))


CANONICAL_KMERS = _KMERS + " SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1"


def kmer_encode(spark, sf):
    return _kmers(spark, sf).select("kmer", "n", S.encode_kmer("kmer").alias("code"), S.canonical_code("kmer").alias("canonical_code"))


KMER_ENCODE = _KMERS + f", e AS (SELECT kmer, n, {_CODE} AS code, {_CODE.replace('kmer', 'reverse(translate(kmer, $q$ACGT$q$, $q$TGCA$q$))').replace('$q$', chr(39))} AS rc FROM k) SELECT kmer, n, code, least(code, rc) AS canonical_code FROM e"


def kmer_decode(spark, sf):
    return _kmers(spark, sf).select("kmer", S.decode_kmer(S.encode_kmer("kmer"), K).alias("decoded"))


KMER_DECODE = _KMERS + " SELECT kmer, replace(kmer, 'N', 'A') AS decoded FROM k"


ORIENT_K = 9


def strand_orient(spark, sf):
    """All documents against the k-mers of all benchmark texts."""
    return taxonomy.orient(fixture(spark, sf, "seqs"), fixture(spark, sf, "bench"), ORIENT_K)


# k-mers are compared by code, where anything but a base counts as A
STRAND_ORIENT = with_sql("seqs", "bench") + f""", w AS (SELECT doc_id, seq, unnest(range(1, greatest(length(seq) - {ORIENT_K - 2}, 1))) AS i FROM seqs), k AS (SELECT doc_id, substring(seq, i, {ORIENT_K}) AS kmer, count(*) AS n FROM w GROUP BY 1, 2),
b AS (SELECT seq, unnest(range(1, greatest(length(seq) - {ORIENT_K - 2}, 1))) AS i FROM bench), r AS (SELECT DISTINCT replace(substring(seq, i, {ORIENT_K}), 'N', 'A') AS ref FROM b),
s AS (SELECT doc_id, CAST(coalesce(sum(n) FILTER (replace(kmer, 'N', 'A') IN (SELECT ref FROM r)), 0) AS BIGINT) AS forward_hits, CAST(coalesce(sum(n) FILTER (replace(reverse(translate(kmer, 'ACGT', 'TGCA')), 'N', 'A') IN (SELECT ref FROM r)), 0) AS BIGINT) AS reverse_hits FROM k GROUP BY 1)
SELECT q.doc_id, coalesce(forward_hits, 0) AS forward_hits, coalesce(reverse_hits, 0) AS reverse_hits, coalesce(reverse_hits, 0) > coalesce(forward_hits, 0) AS flipped FROM seqs AS q LEFT JOIN s USING (doc_id)"""


def fasta_header(spark, sf):
    d = fixture(spark, sf, "lineage").withColumn("h", S.fasta_header(F.concat(F.lit(">"), "accession", F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("  "), F.coalesce("node_name", F.lit("")), F.lit(" "))).otherwise(F.lit("")))))
    return d.select("accession", "ordinal", "entry", F.col("h.id").alias("id"), F.col("h.desc").alias("desc"))


FASTA_HEADER = with_sql("lineage") + " SELECT accession, ordinal, entry, accession AS id, CASE WHEN ordinal % 2 = 0 THEN nullif(trim(coalesce(node_name, '')), '') END AS desc FROM lineage"


def minimizer(spark, sf):
    """Per document: no other k-mer's hash is below the minimizer's, which is canonical and one of its own.

    The hash is our own, so the query returns these properties."""
    d = taxonomy.kmer_rows(fixture(spark, sf, "seqs"), K)
    least = d.groupBy("doc_id").agg(F.min_by(S.canonical("kmer"), S.kmer_hash("kmer")).alias("m"))
    both = d.join(least, "doc_id").groupBy("doc_id").agg(
        F.count_if(S.is_minimizer_against("kmer", "m")).alias("below"), F.bool_or(S.canonical("kmer") == F.col("m")).alias("own"), F.first(S.canonical("m") == F.col("m")).alias("canonical"), F.count("*").alias("n")
    )
    return both


MINIMIZER = with_sql("seqs") + f" SELECT doc_id, CAST(0 AS BIGINT) AS below, true AS own, true AS canonical, CAST(length(seq) - {K - 1} AS BIGINT) AS n FROM seqs WHERE length(seq) >= {K}"


def simulate_reads(spark, sf):
    """Reads drawn without errors from long sequences: numbers, lengths, and whether both mates lie on
    their contig, the second as its reverse complement."""
    contigs = fixture(spark, sf, "seqs").select(F.col("doc_id").cast("string").alias("contig"), F.explode(S.split_contigs("seq", 1000)).alias("seq"))
    reads = simulate.simulate(contigs, n=10_000, prefix="sim", keyword="TEST", seed=7).withColumn("contig", F.split("r1_id", ":")[2])
    found = reads.join(contigs, "contig").groupBy("r1_id").agg(
        F.bool_or(F.contains("seq", "r1_seq")).alias("first"), F.bool_or(F.contains("seq", S.reverse_complement("r2_seq"))).alias("second"), F.first(F.length("r1_seq") + F.length("r2_qual")).alias("length")
    )
    return found.groupBy("first", "second", "length").agg(F.count("*").alias("reads"))


SIMULATE_READS = "SELECT true AS first, true AS second, CAST(300 AS INTEGER) AS length, CAST(10000 AS BIGINT) AS reads"


def expected_totals(spark, sf):
    return evaluation.expected_totals(fixture(spark, sf, "manifest"))


EXPECTED_TOTALS = with_sql("manifest") + " SELECT CAST(sum(calculated_reads) FILTER (keyword <> 'Negative') AS BIGINT) AS expected_positives, CAST(coalesce(sum(calculated_reads) FILTER (keyword = 'Negative'), 0) AS BIGINT) AS expected_negatives FROM manifest"


def roc_report_auc(spark, sf):
    """Areas over 101 even thresholds with anchors, as a report shows them."""
    return H.even_areas(H.even_curve(_hist(spark, sf), BINS, POSITIVES, NEGATIVES)).select("kind", F.round("area", 9).alias("area"))


ROC_REPORT_AUC = _sql(_CONFUSION.format(grid="(SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in GRID101) + "]) AS threshold)") + """, e AS (SELECT row_number() OVER (ORDER BY threshold) AS step, fpr, recall AS tpr, precision FROM r),
a AS (SELECT min_by(fpr, step) AS f0, min_by(tpr, step) AS t0, max_by(fpr, step) AS f1, max_by(tpr, step) AS t1 FROM e),
p AS (SELECT 'roc' AS kind, step, fpr AS x, tpr AS y FROM e UNION ALL SELECT 'pr', step, tpr, precision FROM e UNION ALL SELECT 'roc', 0, 1, 1 FROM a WHERE f0 < 1 OR t0 < 1
UNION ALL SELECT 'roc', 102, 0, 0 FROM a WHERE f1 > 0 OR t1 > 0 UNION ALL SELECT 'pr', 102, 0, 1 FROM a WHERE t1 > 0),
z AS (SELECT kind, abs(x - lag(x) OVER v) AS dx, y + lag(y) OVER v AS s FROM p WINDOW v AS (PARTITION BY kind ORDER BY step))
SELECT kind, round(sum(dx * s / 2), 9) AS area FROM z GROUP BY 1""")

NAMES = (
    "hist_build hist_trim hist_cdf hist_inverse_cdf hist_percentile hist_stats threshold_counts roc_curve roc_auc roc_grid101 confusion_metrics lineage_pivot lineage_lookup "
    "taxonomy_upsert allocate_reads allocate_copies genome_metrics contig_chunks reverse_complement kmers canonical_kmers kmer_encode kmer_decode strand_orient fasta_header minimizer simulate_reads expected_totals roc_report_auc"
).split()
QUERIES = {n: globals()[n] for n in NAMES} | {"lineage_pivot": lineage_table}
ORACLES = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()} | {"lineage_pivot": LINEAGE_TABLE}
