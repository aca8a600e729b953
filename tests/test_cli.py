"""Commands end to end on small files."""

import gzip
import json

import numpy as np
import pytest

from helixframe import cli
from helixframe.operators import reports
from helixframe.sources import binary_alignments as B


def test_coverage_and_filter(spark, tmp_path, capsys):
    sam = tmp_path / "a.sam"
    sam.write_text("@SQ\tSN:r\tLN:50\n" + "".join(f"q{i}\t{f}\tr\t{5 + i}\t30\t10M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tNM:i:{i}\n" for i in range(3) for f in (67, 131)))
    cli.main(["coverage", "--input", str(sam), "--run-name", str(tmp_path / "run"), "--min-pi", "85"])
    out = json.loads((tmp_path / "run.json").read_text())
    assert out["1-run_stats"]["passed_primary_alignments"] == 4 and out["1-run_stats"]["num_refs_primary"] == 1
    row = out["2-coverage_stats"][0]["r"]
    assert (row["aligned_reads_primary"], row["aligned_bases"], row["aligned_pos_covered"], row["virus_lineage"]) == (4, 40, 11, None)
    assert row["x_coverage"]["primary_coverage"] == ",".join(["0"] * 4 + ["2"] + ["4"] * 9 + ["2"] + ["0"] * 35)
    cli.main(["filter", "--input", str(sam), "--prefix", str(tmp_path / "low"), "--max-pi", "85"])
    assert '"pairs_written": 1' in capsys.readouterr().out
    parts = list((tmp_path / "low.r2.fq.gz").glob("part-*.gz"))
    assert sum(gzip.open(p, "rt").read().count("@q2/2") for p in parts) == 1


def test_report(spark, tmp_path):
    path = str(tmp_path / "a.bam")
    tags = b"NMC\x01ASC\x12"
    B.write_records(path, [("r", 90)], [(f"q{i}", f, 0, 5 + i, 60, [("M", 10)], "ACGTACGTAC", bytes([30] * 10), tags) for i in range(2) for f in (67, 131)])
    cli.main(["report", "--bam", path, "--run-name", str(tmp_path / "rep"), "--html"])
    text = (tmp_path / "rep.html").read_text()
    assert "percent_identity" in text and "<rect" in text
    assert "polyline" in reports.line([(0, 0), (1, 1)])


def test_report_bins_ratios_by_hundredths(spark, tmp_path):
    path = str(tmp_path / "a.bam")
    scores = (2, 5, 9, 10, 16)
    B.write_records(path, [("r", 90)], [(f"q{i}", f, 0, 5 + i, 60, [("M", 10)], "ACGTACGTAC", bytes([30] * 10), b"NMC\x01ASC" + bytes([a])) for i, a in enumerate(scores) for f in (67, 131)])
    shown = {}
    keep = reports.page
    try:
        reports.page = lambda title, parts, data: shown.update({(m, k): c for m, k, c in data}) or keep(title, parts, data)
        cli.main(["report", "--bam", path, "--run-name", str(tmp_path / "rep"), "--html"])
    finally:
        reports.page = keep
    stored = json.loads((tmp_path / "rep.json").read_text())["alignment_stats"]
    assert len(stored["r1_as_al"]["histogram"]) == 201 and len(stored["r2_mapq"]["histogram"]) == 61
    assert sum(n for _, n in stored["r1_as_al"]["histogram"]) == 5 and stored["r1_align_score"]["median"] == 9
    shown = {k: v for k, v in shown.items() if k[0] != "pe_insert_size"}
    assert {m for m, _ in shown} == {"mapq", "align_score", "align_length", "as_al", "align_proportion", "percent_identity"}
    assert [b for b, _ in shown["as_al", 1]] == [int(float(np.float32(a / 10)) / 0.01) for a in scores]  # ratios are 32-bit
    assert [b for b, _ in shown["align_score", 2]] == list(scores)
    assert shown["align_proportion", 1] == [(100, 5)]


def _bam(path):
    """Pairs of known truth: right, wrong, control, unmapped, and one of a short name."""
    ref = ["one", "two"]
    pairs = [("a:K1:x:1", 0), ("a:K1:x:2", 0), ("a:K1:x:3", 1), ("b:negative:y:1", 1), ("b:NEGATIVE:y:2", -1), ("a:K1:x:4", -1), ("short", 0)]
    records = []
    for name, to in pairs:
        for flag, pos in ((67, 5), (131, 205)):
            records.append((name, flag, to, pos if to >= 0 else -1, 60, [("M", 10)] if to >= 0 else [], "ACGTACGTAC", bytes([30 + flag % 2] * 9 + [20]), b"NMC\x01ASC\x12"))
    B.write_records(path, [(r, 900) for r in ref], records, text="@HD\tVN:1.6\n")
    return len(pairs)


def test_analyze_and_compare(spark, tmp_path):
    bam, n = str(tmp_path / "a.bam"), _bam(str(tmp_path / "a.bam"))
    (tmp_path / "manifest.tsv").write_text("id\tkeyword\tcalculated_reads\na\tK1\t4\nb\tNegative\t2\n")
    (tmp_path / "map.tsv").write_text("one\tother\none\tK1\nonly one field\n")
    out = str(tmp_path / "eval")
    cli.main(["analyze", "--bam", bam, "--config", str(tmp_path / "manifest.tsv"), "--map", str(tmp_path / "map.tsv"), "--output", out])
    d = json.loads((tmp_path / "eval.json").read_text())
    assert (d["total_expected_positives"], d["total_expected_negatives"], d["total_observed"]) == (4, 2, n)
    assert (d["unmapped_true_negatives"], d["unmapped_false_negatives"]) == (1, 1)
    assert d["true_positives"]["mapq"]["counts"][60] == 4 and d["true_positives"]["as_al"] == {"min_val": 0.0, "max_val": 1.8, "bin_width": 0.1, "counts": [0] * 18 + [4]}
    assert sum(d["false_positives_cross"]["align_score"]["counts"]) == 2 == sum(d["false_positives_control"]["percent_identity"]["counts"])
    assert "range" in (tmp_path / "eval.html").read_text()
    (tmp_path / "runs.tsv").write_text(f"id\treport\nfirst\t{out}.json\nagain\t{out}.json\n")
    cli.main(["compare", "--config", str(tmp_path / "runs.tsv"), "--output", str(tmp_path / "cmp")])
    runs = json.loads((tmp_path / "cmp.json").read_text())
    assert [r["id"] for r in runs] == ["first", "again"] and len(runs[0]["curves"]) == 6
    c = runs[0]["curves"]["mapq"]  # 4 of 8 reads right; 4 false of 2 * 2 + 2
    assert list(zip(c["fpr"], c["tpr"])) == [(0, 0), (4 / 6, 0.5), (1, 1)]
    assert c["roc_auc"] == pytest.approx(0.5 * 4 / 6 * 0.5 + (1 - 4 / 6) * 0.75)
    assert "again" in (tmp_path / "cmp.html").read_text()


def test_model_generate_compose(spark, tmp_path):
    _bam(str(tmp_path / "a.bam"))
    model = str(tmp_path / "m.json")
    cli.main(["model", "--bam", str(tmp_path / "a.bam"), "--model", model])
    m = json.loads((tmp_path / "m.json").read_text())
    assert m["r1_lengths"]["counts"][10] == 7 and sum(m["insert_sizes"]["counts"]) == m["insert_sizes"]["counts"][210] == 5
    assert len(m["r1_qualities"]) == 150 and m["r1_qualities"][0]["counts"][31] == 7 and m["r2_qualities"][9]["counts"][20] == 7
    rng = np.random.default_rng(1)
    genome = lambda n: "".join(rng.choice(list("ACGT"), n))
    (tmp_path / "g.fa").write_text(">g one\n" + genome(3000) + "\n")
    (tmp_path / "h.fa").write_text(">h1\n" + genome(1500) + "NN\n>h2\n" + genome(1500) + "\n")
    cli.main(["generate", "--fasta", str(tmp_path / "g.fa"), "--reads", "20", "--prefix", str(tmp_path / "out"), "--keyword", "K", "--model", model, "--vary-lengths", "-c"])
    read = lambda p: [x for f in sorted(p.glob("*.gz")) for x in gzip.open(f, "rt").read().splitlines()]
    one, two = read(tmp_path / "out.r1.fq.gz"), read(tmp_path / "out.r2.fq.gz")
    assert len(one) == len(two) == 80 and set(one[1::4]) and {len(x) for x in one[1::4]} == {10}
    assert set(one[3::4]) == {chr(33 + 31) * 9 + chr(33 + 20)}  # qualities of the model, cycle by cycle
    assert [x.split(" ")[0] for x in one[::4]] == [x.split(" ")[0] for x in two[::4]]
    head = "id\tkeyword\tabundance\tfasta\tcircular\tsub_rate\tindel_rate\n"
    (tmp_path / "c.tsv").write_text(f"{head}g\tK\t0.25\t{tmp_path}/g.fa\tyes\t0.0\t0.0\nh\tNEGATIVE\t0.75\t{tmp_path}/h.fa\tTRUE\t0.01\t0.0\n")
    cli.main(["compose", "--config", str(tmp_path / "c.tsv"), "--reads", "40", "--prefix", str(tmp_path / "mix"), "--model", model])
    lines = [x.split("\t") for x in (tmp_path / "mix.manifest.tsv").read_text().splitlines()]
    assert lines[0] == "id keyword abundance sub_rate indel_rate fasta circular genome_length calculated_reads".split()
    assert sorted((x[0], x[6], x[7], x[8]) for x in lines[1:]) == [("g", "true", "3000", "10"), ("h", "false", "3000", "30")]
    one, two = read(tmp_path / "mix.r1.fq.gz"), read(tmp_path / "mix.r2.fq.gz")
    assert len(one) == 160 and sum(":NEGATIVE:" in x for x in one[::4]) == 30 and {len(x) for x in one[1::4]} == {150}
    assert [x.split(" ")[0] for x in one[::4]] == [x.split(" ")[0] for x in two[::4]]
    (tmp_path / "n.fa").write_text(">n\nNNNN\n")
    (tmp_path / "bad.tsv").write_text(f"{head}n\tK\t1\t{tmp_path}/n.fa\tno\t0\t0\n")
    with pytest.raises(SystemExit, match="no known bases"):
        cli.main(["compose", "--config", str(tmp_path / "bad.tsv"), "--reads", "4", "--prefix", str(tmp_path / "bad")])


def test_lineages_replace_accessions(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tgenus\t|\tx\t|\n2\t|\t1\t|\tclass\t|\tx\t|\n2\t|\t1\t|\tspecies\t|\tx\t|\n")
    lineage = [{"name": "G", "tax_id": 1}, {"name": "S", "tax_id": 2}, {"name": "unknown", "tax_id": 9}]
    doc = {"reports": [{"accession": "A", "virus": {"organism_name": "old", "tax_id": 5, "lineage": lineage}}, {"accession": "A", "virus": {"organism_name": "new", "tax_id": 6, "lineage": lineage[1:]}}, {"accession": "B", "virus": {"organism_name": "b", "tax_id": 7}}]}
    for name, tax in (("new", 6), ("newer", 8)):
        doc["reports"][1]["virus"] |= {"organism_name": name, "tax_id": tax}
        (tmp_path / "r.json").write_text(json.dumps(doc))
        cli.main(["lineages", "--report", str(tmp_path / "r.json"), "--nodes", str(tmp_path / "nodes.dmp"), "--db", str(tmp_path / "db")])
        rows = {r.accession: r for r in spark.read.parquet(f"{tmp_path}/db/virus").collect()}
        assert (rows["A"].name, rows["A"].tax_id, rows["A"].species_id, rows["A"].genus_id, rows["A"].class_id) == (name, tax, 2, None, None)
        assert len(rows) == 2 and rows["B"].tax_id == 7
        spark.catalog.clearCache()
