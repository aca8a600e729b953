"""Command line: python -m helixframe.cli <command> --help"""

from __future__ import annotations

import argparse
import json
import math
import os
import shutil

from pyspark.sql import functions as F

from .functions import alignment as A
from .functions import sequence as S
from .operators import alignments as al
from .operators import histograms as H
from .operators import evaluation, reports, simulate, taxonomy
from .session import session
from .sources import reads as R
from .sources import text as T
from .sources.binary_alignments import BinaryAlignments

MEASURES = al.MEASURES


def _sam(spark, path: str):
    """SAM by text; the input order within a name is the order of the file's lines."""
    return T.read_sam(spark, path).withColumn("ord", F.monotonically_increasing_id())


def _bam(spark, path: str):
    spark.dataSource.register(BinaryAlignments)
    d = spark.read.format("binary_alignments").load(path)
    refs = spark.read.format("binary_alignments").option("part", "references").load(path).select("ref_id", F.col("ref_name").alias("rname"))
    tags = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:i:"), c)) for c, t in (("nm", "NM"), ("as_score", "AS"))]))
    return d.join(refs, "ref_id", "left").withColumn("pos", F.col("pos").cast("long") + 1).withColumn("tags", tags).drop("nm", "as_score")


def _limits(args, side: str) -> dict:
    return {m: getattr(args, f"{side}_{m}") for m in MEASURES if getattr(args, f"{side}_{m}") is not None}


def _named(d, id_, seq="seq", qual="qual"):
    return [F.struct(id_(r).alias("id"), F.col(f"{r}{seq}").alias("seq"), F.col(f"{r}{qual}").alias("qual")).alias(r) for r in ("r1", "r2")]


def _measures(d):
    return al.with_metrics(d)


def filter_(spark, args):
    """Poorly aligned pairs to FASTQ; one pass over the records counts and filters."""
    sam = _sam(spark, args.input).filter(A.is_primary("flag"))
    reads = al.to_reads(al.low_pass(_measures(sam), **_limits(args, "max")))
    pairs = al.mate_pairs(reads)
    named = pairs.select(*_named(pairs, lambda r: F.col("qname"), ".seq", ".qual"), F.xxhash64("qname", "pair").alias("ord"))
    R.write_paired(named, f"{args.prefix}.r1.fq.gz", f"{args.prefix}.r2.fq.gz", mode="overwrite")
    counts = {r["outcome"]: r["count"] for r in al.mate_events(reads).groupBy("outcome").count().collect()}
    return {"pairs_seen": sam.count() // 2, "pairs_written": counts.get("pair", 0) // 2, "orphans": counts.get("orphan", 0)}


def coverage(spark, args):
    """{run name}.json: run counters, and for each reference its summary, lineage and depth strings."""
    sam = _measures(_sam(spark, args.input))
    if args.tee:
        spark.read.text(args.input).write.mode("overwrite").text(args.tee)  # all lines, headers too
    refs, limits = T.sam_references(T.read_sam_header(spark, args.input)), _limits(args, "min")
    kept = al.high_pass(sam, **limits)
    out = al.coverage_summary(kept, refs)
    lineage = spark.read.parquet(args.lineage) if args.lineage else None
    out = taxonomy.lineage_lookup(out, lineage, "ref_name") if lineage is not None else out.withColumn("lineage", F.lit(None).cast("string"))
    out = out.join(al.depth_strings(kept, refs), "ref_name", "left")
    stats = al.run_counters(sam, refs, al.passes(**limits)).first()
    run = {"run_name": args.run_name, "total_alignments": stats[0], "passed_primary_alignments": stats[1], "passed_secondary_alignments": stats[2], "num_refs_primary": stats[3], "num_refs_secondary": stats[4]}
    run |= {f"min_{m}": limits.get(m) for m in MEASURES}
    rows = []
    depths = ("primary_coverage", "secondary_coverage", "mismatch_coverage")
    for r in out.orderBy("ref_name").toLocalIterator():  # one reference at a time
        d = r.asDict()
        name, line = d.pop("ref_name"), d.pop("lineage")
        rows.append({name: {k: v for k, v in d.items() if k not in depths} | {"virus_lineage": json.loads(line) if line else None, "x_coverage": {k: d[k] for k in depths}}})
    T.write_document({"1-run_stats": run, "2-coverage_stats": rows}, f"{args.run_name}.json")
    return run


def lineages(spark, args):
    """Parquet tables viral and host of lineages; accessions of an existing table are replaced."""
    ranks = T.read_nodes(spark, args.nodes).select(F.col("tax_id").alias("node_id"), "rank")
    counts = {}
    for part in ("virus", "host"):
        table = taxonomy.lineage_pivot(T.read_taxonomy_report(spark, args.report, part).join(ranks, "node_id", "left"))
        path, fresh = f"{args.db}/{part}", f"{args.db}/.{part}-new"
        if os.path.isdir(path):
            table = taxonomy.upsert(spark.read.parquet(path).withColumn("_o", F.lit(0)), table.withColumn("_o", F.lit(0)), "accession", "_o").drop("_o")
        table.write.mode("overwrite").parquet(fresh)
        shutil.rmtree(path, ignore_errors=True)
        os.rename(fresh, path)
        counts[part] = spark.read.parquet(path).count()
    return {"db": args.db} | counts


def report(spark, args):
    """{run name}.json with counters, summaries and histograms, and with --html a page of them."""
    d = _bam(spark, args.bam)
    inserts = al.insert_sizes(al.name_runs(d), args.mapq, args.insert).select(F.lit(None).cast("int").alias("mate"), F.lit("pe_insert_size").alias("metric"), F.col("insert_size").cast("double").alias("value"))
    values = al.capped_metrics(d, args.length).unionByName(inserts)
    counters, summary, histogram = al.global_counters(d), al.metric_summary(values, "mate", "metric"), al.report_histograms(values, args.length, args.insert)
    name = lambda r: f"r{r['mate']}_{r['metric']}" if r["mate"] else r["metric"]
    stats = {name(r): {k: r[k] for k in ("n", "mean", "median", "stdev", "least", "greatest")} for r in summary.collect()}
    bins: dict[str, dict[int, int]] = {}
    for r in histogram.collect():
        bins.setdefault(name(r), {})[r["bin"]] = r["n"]
    for key, own in stats.items():
        most, width = al.report_ranges(args.length, args.insert)[key.split("_", 1)[1] if key[0] == "r" and key[1].isdigit() else key]
        own["histogram"] = [[i * width, bins.get(key, {}).get(i, 0)] for i in range(math.ceil(most / width - 1e-9))]
    global_stats = {f"r{r['mate']}": {k: v for k, v in r.asDict().items() if k != "mate"} for r in counters.collect()}
    if not global_stats:
        raise SystemExit("no paired records found")
    T.write_document({"global_stats": global_stats, "alignment_stats": stats}, f"{args.run_name}.json")
    if args.html:
        with open(f"{args.run_name}.html", "w", encoding="utf-8") as f:
            f.write(reports.alignment_report(args.run_name, counters, summary, histogram))
    return {"insert_sizes": stats.get("pe_insert_size", {}).get("n", 0)}


def recode(spark, args):
    R.recode(spark, args.in1, args.in2, f"{args.output}.r1.fq.gz", f"{args.output}.r2.fq.gz")
    return {"output": args.output}


def model(spark, args):
    d = _bam(spark, args.bam)
    runs = al.name_runs(d, gated=False, more=("qual",))
    out = simulate.model_document(runs, args.length, args.mapq, args.insert)
    if not sum(out["r1_lengths"]["counts"]):
        raise SystemExit("no pairs found")
    T.write_document(out, args.model)
    return {"total_pairs_scanned": d.select("qname").distinct().count(), "insert_sizes_modeled": sum(out["insert_sizes"]["counts"])}


def _model(args) -> simulate.Model:
    if not args.model:
        return simulate.Model(read_length=args.length)
    return simulate.Model.from_document(T.read_json(args.model), args.length, args.vary_lengths)


def _chunks(spark, fasta: str, circular: bool):
    return T.read_fasta(spark, fasta).select(F.col("id").alias("contig"), F.explode(S.split_contigs("seq", circular=F.lit(circular))).alias("seq"))


def _write_reads(pairs, prefix: str, mode: str) -> None:
    named = pairs.select(*_named(pairs, lambda r: F.regexp_replace(f"{r}_id", "/[12]$", ""), "_seq", "_qual"), F.xxhash64("r1_id").alias("ord"))
    R.write_paired(named, f"{prefix}.r1.fq.gz", f"{prefix}.r2.fq.gz", mode=mode)


def generate(spark, args):
    pairs = simulate.simulate(_chunks(spark, args.fasta, args.circular), args.reads, args.prefix, args.keyword, _model(args), args.sub_rate, args.indel_rate, args.seed)
    _write_reads(pairs, args.prefix, "overwrite")
    return {"reads": args.reads}


def compose(spark, args):
    """Manifest of a composition, and the reads of all its genomes in one pair of outputs."""
    config = T.read_table(spark, args.config, T.COMPOSE)
    measured = []
    for r in config.select("id", "fasta").collect():  # one row for each genome
        m = T.read_fasta(spark, r["fasta"]).agg(F.coalesce(F.sum(S.known_bases("seq")), F.lit(0)).alias("n"), F.count("*").alias("c")).first()
        if not m["n"]:
            raise SystemExit(f"{r['id']}: no known bases in {r['fasta']}")
        measured.append((r["id"], m["n"], m["c"]))
    lengths = spark.createDataFrame(measured, "id string, genome_length long, contigs long")
    # a genome of several contigs is never circular
    known = config.join(lengths, "id").withColumn("circular", F.col("circular") & (F.col("contigs") == 1)).drop("contigs")
    tasks = taxonomy.allocate(known, args.reads, args.abundance == "copies").withColumnRenamed("reads", "calculated_reads")
    T.write_manifest(tasks, f"{args.prefix}.manifest.tsv")
    mode, shape = "overwrite", _model(args)
    for r in tasks.collect():
        if r["calculated_reads"]:
            pairs = simulate.simulate(_chunks(spark, r["fasta"], r["circular"]), r["calculated_reads"], r["id"], r["keyword"], shape, r["sub_rate"], r["indel_rate"], args.seed)
            _write_reads(pairs, args.prefix, mode)
            mode = "append"
    return {"manifest": f"{args.prefix}.manifest.tsv", "reads": args.reads}


def analyze(spark, args):
    """{output}.json and {output}.html: pairs held against the truth in their names."""
    manifest = T.read_table(spark, args.config, "keyword string, calculated_reads long")
    d = _bam(spark, args.bam)
    classified = evaluation.classify(al.name_runs(d, more=("l_seq",)), T.read_reference_map(spark, args.map), args.mode)
    out = evaluation.document(args.output, manifest, classified.cache())
    T.write_document(out, f"{args.output}.json")
    parts = {}
    for metric in evaluation.metrics_of(out):
        hist, bins = evaluation.report_histogram(spark, out, metric)
        known = (out["total_expected_positives"], out["total_expected_negatives"])
        points = H.even_curve(hist, bins, *known)
        parts[metric] = (H.confusion(hist, bins, [bins.least], *known), points, H.even_areas(points))
    with open(f"{args.output}.html", "w", encoding="utf-8") as f:
        f.write(reports.evaluation_report(args.output, out, parts))
    return {k: v for k, v in out.items() if isinstance(v, int)}


def compare(spark, args):
    """{output}.json and {output}.html: curves of several evaluations, for each measure."""
    runs = []
    for r in T.read_table(spark, args.config, T.COMPARE).collect():  # one row for each evaluation
        stored, curves = T.read_json(r["report"]), {}
        for metric in evaluation.metrics_of(stored):
            points, areas = evaluation.metric_curves(spark, stored, metric)
            rows, a = sorted(points.collect(), key=lambda x: x["step"]), areas.first()
            curves[metric] = {"fpr": [x["fpr"] for x in rows], "tpr": [x["tpr"] for x in rows], "precision": [x["precision"] for x in rows], "roc_auc": a["roc_auc"], "pr_auc": a["pr_auc"]}
        runs.append({"id": r["id"], "curves": curves})
    T.write_document(runs, f"{args.output}.json")
    with open(f"{args.output}.html", "w", encoding="utf-8") as f:
        f.write(reports.comparison_report(args.output, runs))
    return {"runs": len(runs)}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="helixframe")
    sub = parser.add_subparsers(dest="command", required=True)

    def add(name, run, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flag, kind, default in options:
            p.add_argument(flag, type=kind, default=default, required=default is ...)
        return p

    for name, run, side, extra in (("filter", filter_, "max", ("--prefix", str, ...)), ("coverage", coverage, "min", ("--run-name", str, ...))):
        p = add(name, run, ("--input", str, ...), extra)
        for m in MEASURES:
            p.add_argument(f"--{side}-{m}", type=float, default=None)
        if name == "coverage":
            p.add_argument("--lineage", default=None)
            p.add_argument("--tee", default=None)
    add("lineages", lineages, ("--report", str, ...), ("--nodes", str, ...), ("--db", str, ...))
    add("report", report, ("--bam", str, ...), ("--run-name", str, ...), ("--mapq", int, 40), ("--insert", int, 1000), ("--length", int, 150)).add_argument("--html", action="store_true")
    add("recode", recode, ("--in1", str, ...), ("--in2", str, ...), ("--output", str, ...))
    add("model", model, ("--bam", str, ...), ("--model", str, ...), ("--mapq", int, 40), ("--insert", int, 1000), ("--length", int, 150))
    made = (("--reads", int, ...), ("--prefix", str, ...), ("--model", str, None), ("--length", int, 150), ("--seed", int, 0))
    p = add("generate", generate, ("--fasta", str, ...), ("--keyword", str, "NONE"), ("--sub-rate", float, 0.0), ("--indel-rate", float, 0.0), *made)
    p.add_argument("-c", "--circular", action="store_true")
    q = add("compose", compose, ("--config", str, ...), *made)
    q.add_argument("--abundance", choices=("reads", "copies"), default="reads")
    for x in (p, q):
        x.add_argument("--vary-lengths", action="store_true")
    add("analyze", analyze, ("--bam", str, ...), ("--config", str, ...), ("--map", str, ...), ("--output", str, ...)).add_argument("--mode", choices=tuple(evaluation.MODES), default="keyword")
    add("compare", compare, ("--config", str, ...), ("--output", str, ...))
    args = parser.parse_args(argv)
    spark = session()
    print(json.dumps(args.run(spark, args)))


if __name__ == "__main__":
    main()
