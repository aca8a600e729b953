"""Pairing, coverage, orientation and curves on small tables."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import alignments as al
from helixframe.operators import histograms as H
from helixframe.operators import evaluation, simulate, taxonomy

READS = "qname string, ord long, mate int, seq string, qual string"


def test_mate_outcomes(spark):
    rows = [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 1), ("b", 3, 2), ("c", 1, 2), ("d", 1, 2), ("d", 2, 1), ("d", 3, 1)]
    d = spark.createDataFrame([(*r, "A", "I") for r in rows], READS)
    assert {(r.qname, r.pair) for r in al.mate_pairs(d).collect()} == {("a", 0), ("d", 0)}
    assert {(r.qname, r.ord) for r in al.orphans(d).collect()} == {("b", 3), ("c", 1), ("d", 3)}


def test_coverage_equals_positions(spark):
    rows = [("q", 1, 0, "r", 3, 50, "4M2D3X2N1=", ["NM:i:1"]), ("q", 2, 256, "r", 1, 50, "5M", []), ("p", 1, 0, "r", 8, 50, "10M", []), ("p", 2, 0, "x", 8, 50, "10M", [])]
    d = spark.createDataFrame(rows, "qname string, ord long, flag int, rname string, pos long, mapq long, cigar string, tags array<string>")
    refs = spark.createDataFrame([("r", 14)], "ref_name string, ref_length long")
    got = {}
    for r in al.coverage_runs(d, refs).collect():
        for p in range(r.start, r.stop):
            got[p] = (r.primary_depth, r.secondary_depth, r.mismatch_depth)
    want = {}
    for _, _, flag, ref, pos, _, cigar, _ in rows:
        if ref != "r":
            continue
        p, n = pos - 1, ""
        for c in cigar:
            if c.isdigit():
                n += c
                continue
            for _ in range(int(n)):
                if c in "M=X" and p < 14:
                    a = list(want.get(p, (0, 0, 0)))
                    a[1 if flag & 256 else 0] += 1
                    a[2] += c == "X" and not flag & 256
                    want[p] = tuple(a)
                p += 1
            n = ""
    assert got == want


def test_null_measures_are_neutral_or_failing(spark):
    d = spark.createDataFrame([("q", 1, 0, "r", 3, 50, "10M", ["AS:i:5"])], "qname string, ord long, flag int, rname string, pos long, mapq long, cigar string, tags array<string>")
    m = al.with_metrics(d)
    assert al.low_pass(m, pi=100).count() == 0
    assert al.high_pass(m, pi=100).count() == 1


def test_counters_add_up(spark):
    from helixframe.plans.alignment_queries import global_counters

    for r in global_counters(spark, "/root/testdata/sf0.001").collect():
        assert r.concordant + r.discordant + r.singletons == r.primary_mapped == r.primary_mapq_above_0 + r.primary_mapq_0
        assert r.primary_mapped + r.secondary == r.alignments


def test_orientation(spark):
    reference = spark.createDataFrame([(0, "GATTACA")], "doc_id long, seq string")
    query = spark.createDataFrame([(1, "TGTAATC"), (2, "GATTACA"), (3, "CC")], "doc_id long, seq string")
    assert {r.doc_id: r.flipped for r in taxonomy.orient(query, reference, 4).collect()} == {1: True, 2: False, 3: False}


def test_long_kmers_orient_by_join(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGTN") for _ in range(400))
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reference = spark.createDataFrame([(0, seq[:300])], "doc_id long, seq string")
    query = spark.createDataFrame([(1, back), (2, seq), (3, "CC"), (4, None)], "doc_id long, seq string")
    for k in (5, 13):
        known = {seq[i : i + k].replace("N", "A") for i in range(300 - k + 1)}
        hits = lambda s: sum(s[i : i + k].replace("N", "A") in known for i in range(len(s) - k + 1))
        got = {r.doc_id: (r.forward_hits, r.reverse_hits, r.flipped) for r in taxonomy.orient(query, reference, k).collect()}
        for i, s, r in ((1, back, seq), (2, seq, back), (3, "CC", "GG"), (4, "", "")):
            assert got[i] == (hits(s), hits(r), hits(r) > hits(s))


def test_coverage_in_tiles(spark):
    rng = random.Random(4)
    rows = [(f"q{i}", 1, rng.choice((0, 256, 2)), rng.choice("rs"), rng.randint(1, 95), 50, rng.choice(("9M", "4M3N5X", "7=1X2D3=", "*"))) for i in range(80)]
    d = spark.createDataFrame(rows, "qname string, ord long, flag int, rname string, pos long, mapq long, cigar string")
    refs = spark.createDataFrame([("r", 100), ("s", 60)], "ref_name string, ref_length long")
    for run in (lambda t: al.coverage_runs(d, refs, t), lambda t: al.coverage_summary(d, refs, t)):
        depths = lambda t: sorted(map(str, run(t).collect()))  # noqa: E731, B023
        if "start" in run(7).columns:
            each = lambda t: sorted((r.ref_name, p, *r[3:]) for r in run(t).collect() for p in range(r.start, r.stop))  # noqa: E731, B023
            assert each(7) == each(1 << 20) != []
        else:
            assert depths(7) == depths(1 << 20) != []
    assert sum(r.aligned_reads_primary for r in al.coverage_summary(d, refs).collect()) == sum(r[2] != 256 for r in rows)


def test_substitutions_and_indels(spark):
    rng = np.random.default_rng(1)
    base = np.frombuffer(b"acgtACGT" * 2500, np.uint8)
    out, (subs, ins, dels) = simulate.mutate(base, len(base), 1.0, 0.0, rng)
    upper = np.where(base >= 97, base - 32, base)
    assert subs == len(base) and not (out == upper).any() and ins == dels == 0
    for b in b"ACGT":  # each other base alike
        share = np.unique(out[upper == b], return_counts=True)[1] / (upper == b).sum()
        assert len(share) == 3 and abs(share - 1 / 3).max() < 0.03
    out, (subs, ins, dels) = simulate.mutate(base, len(base) // 2, 0.0, 0.2, rng)
    assert abs(ins / (len(base) // 2) - 0.1) < 0.01 and abs(dels / (len(base) // 2) - 0.1) < 0.02
    assert len(simulate.mutate(base[:10], 50, 0.0, 0.5, rng)[0]) == 50
    kept, counts = simulate.mutate(base[:100], 60, 0.0, 0.0, rng)
    assert kept.tobytes() == upper[:60].tobytes() and counts == (0, 0, 0)


def test_equal_chunks_have_their_weight(spark):
    contigs = spark.createDataFrame([("a", "ACGTA" * 400)] * 2 + [("b", "GGGA" * 1000)], "contig string, seq string")
    reads = simulate.simulate(contigs, 80, "p", "k").collect()
    assert len(reads) == 80 == len({r.r1_id for r in reads}) and sum(":a:" in r.r1_id for r in reads) == 40


def test_pools_of_name_parts(spark):
    schema = "qname string, ord long, flag int, rname string, pos long, mapq long, cigar string, tags array<string>"
    rows = [(f"i1:k1:a1:{n}", n, f, "t", 5, 50, "10M", []) for n in (1, 2) for f in (67, 131)]
    runs = al.name_runs(spark.createDataFrame(rows, schema))
    for mode, truth in (("id", "i1"), ("keyword", "k1"), ("accession", "a1")):
        classes = spark.createDataFrame([("t", truth)], "ref_name string, classification string")
        assert {r.pool for r in evaluation.classify(runs, classes, mode).collect()} == {"tp"}
        other = {"id": "k1", "keyword": "a1", "accession": "i1"}[mode]
        wrong = spark.createDataFrame([("t", other)], "ref_name string, classification string")
        assert {r.pool for r in evaluation.classify(runs, wrong, mode).collect()} == {"cross"}


def test_histogram_rounds_half_away_and_clamps(spark):
    d = spark.createDataFrame([(x,) for x in (-5.0, 0.49999999999999994, 0.5, 99.0)], "value double")
    assert {r.bin: r.n for r in H.build(d, H.Bins(0, 10, 1)).collect()} == {0: 2, 1: 1, 10: 1}
    assert H.Bins(0, 1, 0.01).count == 101


def test_curve_of_a_perfect_score(spark):
    h = spark.createDataFrame([("tp", 50, 4), ("control", 10, 4)], "pool string, bin long, n long")
    row = H.areas(H.curve(H.grid_counts(h, H.Bins(0, 60, 1)), 2, 2)).first()
    assert row.roc_auc == 1.0 and row.pr_auc == 1.0


def test_simulation_is_reproducible_and_exact_in_number(spark):
    contigs = spark.createDataFrame([("a", "ACGT" * 500), ("b", "GGGA" * 250)], "contig string, seq string")
    runs = [simulate.simulate(contigs.repartition(k), 90, "p", "k", seed=5, substitution=0.02, indel=0.01).orderBy("r1_id").collect() for k in (1, 3)]
    assert runs[0] == runs[1]
    assert len(runs[0]) == 90 and {len(r.r1_seq) for r in runs[0]} == {150}
    assert sum(":a:" in r.r1_id for r in runs[0]) == 60


def test_allocation_without_weight(spark):
    d = spark.createDataFrame([("a", 0.0, 5)], "id string, abundance double, genome_length long")
    assert taxonomy.allocate(d, 100).first().reads == 0


def test_dynamic_histogram_covers_all(spark):
    d = spark.range(100).select(F.col("id").cast("double").alias("value"))
    got = {r.bin: r.n for r in al.dynamic_histogram(d).collect()}
    width = 99 * 1.05 / 100  # padded at the top only
    assert sum(got.values()) == 100 and got == {b: sum(int(v / width) == b for v in range(100)) for b in got} and max(got) == 95
    one = spark.createDataFrame([(5.0,), (5.0,)], "value double")
    assert [(r.bin, r.n) for r in al.dynamic_histogram(one).collect()] == [(47, 2)]


def test_reads_do_not_depend_on_tiles(spark, monkeypatch):
    rng = random.Random(6)
    contigs = spark.createDataFrame([(c, "".join(rng.choice("ACGT") for _ in range(n)), r) for c, n, r in (("a", 5000, 60), ("b", 400, 30), ("c", 90, 5))], "contig string, seq string, reads long")
    whole = sorted(map(tuple, simulate.generate(contigs, "p", "k", substitution=0.02, indel=0.02, seed=4).collect()))
    monkeypatch.setattr(simulate, "CHUNK", 7)
    small = simulate._run(contigs.withColumns({"_from": F.lit(0).cast("long"), "_to": F.col("reads")}), None, "p", "k", 0.02, 0.02, 4, tile=300)
    assert sorted(map(tuple, small.collect())) == whole and len(whole) == 95


def test_kmer_counts(spark):
    seqs = ["ACGTNACGTN", "acG", "", None, "A" * 40 + "CGT" * 9, "AC"]
    d = spark.createDataFrame(list(enumerate(seqs)), "doc_id long, seq string")
    for k in (1, 3, 8, 9, 20):
        want = Counter(s[i : i + k] for s in seqs if s for i in range(len(s) - k + 1))
        assert {r.kmer: r.n for r in taxonomy.kmer_counts(d, k).collect()} == want == Counter(r.kmer for r in taxonomy.kmer_rows(d, k).collect())


def test_qualities_are_those_of_single_draws():
    """Reads of several lengths, none included, over a model with fewer cycles than bases."""
    model = simulate.Model(q1=[{10: 1, 20: 3}, {}, {2: 1}, {30: 5, 40: 5}])
    shares = [np.random.default_rng(i).random(n) for i, n in enumerate((0, 1, 7, 3))]
    want = ["".join(chr(33 + int(model.draw(model.q1[min(i, len(model.q1) - 1)], p))) for i, p in enumerate(x)) for x in shares]
    assert simulate._qualities(model.q1, shares) == want
