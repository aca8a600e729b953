"""Evaluation of alignments of simulated reads: truth from read names, pools, histograms, curves.

Aggregates are frames; a report is a dict of plain values, as large as its histograms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as A
from . import alignments as al
from . import histograms as H

# Range and bin width of each measure's histogram in an evaluation.
BINS = {
    "mapq": H.Bins(0, 60, 1),
    "align_score": H.Bins(0, 1000, 1),
    "align_length": H.Bins(0, 1000, 1),
    "as_al": H.Bins(0, 1000, 0.1),
    "align_proportion": H.Bins(0, 1, 0.01),
    "percent_identity": H.Bins(0, 100, 1),
}
POOLS = {"tp": "true_positives", "control": "false_positives_control", "cross": "false_positives_cross"}
#: Which part of a read's name holds the truth.
MODES = {"id": "id", "keyword": "keyword", "accession": "accession"}


def expected_totals(manifest: DataFrame) -> DataFrame:
    """One row (expected_positives, expected_negatives): reads of a manifest by its keyword."""
    negative = F.lower("keyword") == "negative"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("calculated_reads"))), F.lit(0)).cast("long")
    return manifest.agg(total(~negative).alias("expected_positives"), total(negative).alias("expected_negatives"))


def classify(runs: DataFrame, classes: DataFrame, mode: str = "keyword") -> DataFrame:
    """Pairs (qname, r1, r2) with their pool: tp, control, cross, unmapped_tn or unmapped_fn; null if the
    name has fewer than three parts.  The first read's reference decides; an unmapped read has none."""
    pairs = runs.filter("r1 IS NOT NULL AND r2 IS NOT NULL").withColumn("truth", A.qname_tokens("qname")[MODES[mode]])
    named = classes.select(F.col("ref_name").alias("_ref"), F.col("classification").alias("class"))
    d = pairs.join(named, F.col("r1.rname") == F.col("_ref"), "left")
    mapped, negative = F.coalesce(F.col("r1.rname"), F.lit("*")) != "*", F.lower("truth") == "negative"
    pool = F.when(~mapped & negative, "unmapped_tn").when(~mapped, "unmapped_fn").when(negative, "control").when(F.col("class") == F.col("truth"), "tp").otherwise("cross")
    return d.withColumn("pool", F.when(F.col("truth").isNotNull(), pool)).drop("_ref")


def pool_histograms(classified: DataFrame) -> DataFrame:
    """(pool, metric, bin, n): both reads of every mapped pair add to their pool's six histograms."""
    pairs = classified.filter(F.col("pool").isin(*POOLS))
    reads = pairs.select("pool", F.explode(F.array("r1", "r2")).alias("r")).select("pool", "r.*")
    d = al.with_metrics(reads, F.col("l_seq") if "l_seq" in reads.columns else None)
    columns = {"mapq": "mapq", "align_score": "as_score", "align_length": "al", "as_al": "sl", "align_proportion": "ap", "percent_identity": "pi"}
    wide = d.select("pool", *[F.col(c).cast("double").alias(m) for m, c in columns.items()])
    long = wide.unpivot("pool", list(columns), "metric", "value").filter("value IS NOT NULL")
    bin_ = F.coalesce(*[F.when(F.col("metric") == m, b.of(F.col("value"))) for m, b in BINS.items()])
    return long.groupBy("pool", "metric", bin_.alias("bin")).agg(F.count("*").alias("n"))


def histogram_document(counts: dict[int, int], bins: H.Bins) -> dict:
    """A histogram with its empty end cut off, as reports and models store it."""
    last = max([b for b, n in counts.items() if n], default=0)
    return {"min_val": float(bins.least), "max_val": bins.least + last * bins.width, "bin_width": float(bins.width), "counts": [counts.get(i, 0) for i in range(last + 1)]}


def document(name: str, manifest: DataFrame, classified: DataFrame) -> dict:
    """The evaluation as plain values: expected and observed numbers and the histograms of the pools."""
    expected = expected_totals(manifest).first()
    pools = {r["pool"]: r["n"] for r in classified.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    counts: dict[tuple[str, str], dict[int, int]] = {}
    for r in pool_histograms(classified).collect():  # as many rows as histograms have bins
        counts.setdefault((r["pool"], r["metric"]), {})[r["bin"]] = r["n"]
    out = {
        "report_name": name, "total_expected_positives": expected[0], "total_expected_negatives": expected[1], "total_observed": sum(pools.values()),
        "unmapped_true_negatives": pools.get("unmapped_tn", 0), "unmapped_false_negatives": pools.get("unmapped_fn", 0),
    }
    return out | {key: {m: histogram_document(counts.get((pool, m), {}), b) for m, b in BINS.items()} for pool, key in POOLS.items()}


def report_histogram(spark: SparkSession, report: dict, metric: str) -> tuple[DataFrame, H.Bins]:
    """((pool, bin, n), bins) of a measure in a stored evaluation."""
    parts = {pool: report[key][metric] for pool, key in POOLS.items()}
    rows = [(pool, i, n) for pool, h in parts.items() for i, n in enumerate(h["counts"]) if n]
    tp = parts["tp"]
    return spark.createDataFrame(rows, "pool string, bin long, n long"), H.Bins(tp["min_val"], tp["max_val"], tp["bin_width"])


def metric_curves(spark: SparkSession, report: dict, metric: str) -> tuple[DataFrame, DataFrame]:
    """(curve, areas) of a measure over the distinct scores of a stored evaluation."""
    hist, bins = report_histogram(spark, report, metric)
    points = H.curve(H.grid_counts(hist, bins), report["total_expected_positives"], report["total_expected_negatives"])
    return points, H.areas(points)


def metrics_of(report: dict) -> list[str]:
    """Measures that all pools of a stored evaluation hold."""
    return [m for m in BINS if all(m in report[key] for key in POOLS.values())]
