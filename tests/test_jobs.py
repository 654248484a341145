"""Jobs from files to files, on a small made-up sample."""

import csv
import json
import random

import pytest
from editscan.__main__ import main, parser
from editscan.operators.reads import READS
from editscan.plans import jobs, report
from editscan.sources import alignments, bigwig


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    """40 unpaired records of 50 bases on a contig of 600, with all of its C from 100 to 199 read as T."""
    d, rng = tmp_path_factory.mktemp("sample"), random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(600))
    (d / "g.fa").write_text(f">chr1\n{seq}\n")
    rows, pileup = [], {}
    for i in range(40):
        at = rng.randint(0, 550)
        got = "".join("T" if b == "C" and 100 <= at + k < 200 else b for k, b in enumerate(seq[at : at + 50]))
        for k, (a, b) in enumerate(zip(seq[at:], got)):
            e, c = pileup.get(at + k, (0, 0))
            pileup[at + k] = (e + (a != b), c + 1)
        rows.append((i, f"r{i}", 16 * (i % 2), "chr1", at, 60, "50M", None, -1, 0, got, [30] * 50, {}))
    sizes = spark.createDataFrame([(0, "chr1", 600)], "ord long, chrom string, size long")
    alignments.write_bam(spark.createDataFrame(rows, READS), sizes, str(d / "x.bam"))
    return d, seq, rows, pileup


def values(spark, path):
    return {r["pos"]: r["value"] for r in bigwig.read(spark, path).collect()}


def test_tracks(spark, sample):
    d, _, rows, pileup = sample
    jobs.genome_track(spark, f"{d}/x.bam", f"{d}/e.bw", fasta=f"{d}/g.fa")
    assert values(spark, f"{d}/e.bw") == {p: e for p, (e, _) in pileup.items() if e}
    jobs.genome_track(spark, f"{d}/x.bam", f"{d}/r.bw", fasta=f"{d}/g.fa", mode="ratio", min_coverage=2)
    assert values(spark, f"{d}/r.bw") == pytest.approx({p: e / c for p, (e, c) in pileup.items() if e and c >= 2})
    cuts = {}
    for r in rows:
        p = r[4] + 45 if r[2] & 16 else r[4] + 4
        cuts[p] = cuts.get(p, 0) + 1
    jobs.genome_track(spark, f"{d}/x.bam", f"{d}/c.bw", event="tn5", normalize=True, scale=80)
    assert values(spark, f"{d}/c.bw") == {p: 2.0 * n for p, n in cuts.items()}
    (d / "r.bed").write_text("chr1\t100\t150\nchr9\t1\t5\nchr1\t590\t900\n")
    jobs.genome_track(spark, f"{d}/x.bam", f"{d}/x.bw", fasta=f"{d}/g.fa", regions=f"{d}/r.bed", extend=2)
    want = {}
    for p, (e, _) in pileup.items():
        if 100 <= p < 150 and e:
            for q in range(max(100, p - 2), min(150, p + 3)):
                want[q] = want.get(q, 0) + e
    assert values(spark, f"{d}/x.bw") == want
    for bad in ({"event": "x"}, {"event": "tn5", "mode": "ratio"}, {}):
        with pytest.raises(ValueError):
            jobs.genome_track(spark, f"{d}/x.bam", f"{d}/bad.bw", **bad)


def test_fragment_file(spark, sample):
    d, seq, rows, _ = sample
    jobs.fragment_file(spark, f"{d}/x.bam", f"{d}/g.fa", f"{d}/frags")
    got = [x.split("\t") for p in sorted((d / "frags").glob("part-*")) for x in p.read_text().splitlines()]
    want = {}
    for r in rows:
        edits = "|".join(str(r[4] + k) for k, (a, b) in enumerate(zip(seq[r[4] :], r[10])) if a != b) or "."
        want[r[4], edits] = want.get((r[4], edits), 0) + 1
    assert [(int(g[1]), g[3], int(g[5])) for g in got] == sorted((a, e, n) for (a, e), n in want.items())


def test_quality(spark, sample):
    d, seq, rows, pileup = sample
    (d / "t.bed").write_text("chr1\t300\t300\nchr1\t5\t5\nchr2\t9\t9\n")
    m = jobs.quality(spark, f"{d}/x.bam", f"{d}/g.fa", f"{d}/qc", "s1", tss=f"{d}/t.bed", flank=200)
    edits, sites = sum(e for e, _ in pileup.values()), sum(c for p, (_, c) in pileup.items() if seq[p] in "CG")
    assert (m["editing"]["total_edits"], m["editing"]["total_opportunities"], m["library_layout"]) == (edits, sites, "single")
    assert m["diagnostics"]["aligned_bases"] == 2000 and m["diagnostics"]["non_edit_mismatches"] == 0
    assert m["status"]["tss_annotation"] == {"input_records": 3, "unknown_contig": 1, "outside_contig": 1, "used_records": 1}
    per = [sum(a != b for a, b in zip(seq[r[4] :], r[10])) for r in rows]
    assert m["editing"]["mean_edits_per_fragment"] == pytest.approx(sum(per) / 40)
    assert m["editing"]["median_edits_per_fragment"] == sum(sorted(per)[19:21]) / 2
    assert json.loads((d / "qc/s1.json").read_text()) == m and "<svg" in (d / "qc/s1.html").read_text()
    table = list(csv.DictReader(open(d / "qc/s1.edits_per_fragment.csv")))
    assert len(table) == 101 and sum(int(r["fragments"]) for r in table) == 40 and int(table[0]["fragments"]) == per.count(0)
    assert report.assess(m)["overall"] == "PASS"
    jobs.quality(spark, f"{d}/x.bam", f"{d}/g.fa", f"{d}/qc", "s2")
    main(["compare", "--reports", f"{d}/qc/s1.json", f"{d}/qc/s2.json", "--out", f"{d}/all"])
    both = list(csv.DictReader(open(d / "all/qc_summary.csv")))
    assert [r["sample"] for r in both] == ["s1", "s2"] and [r["tss_status"] for r in both][1] == "not_requested"
    (d / "bad.json").write_text("[]")
    with pytest.raises(ValueError, match="no quality report"):
        report.comparison(spark, [f"{d}/bad.json"])
    with pytest.raises(ValueError, match="no report"):
        report.comparison(spark, [])


def test_assessment():
    m = {"reads": {"total": 10, "passing": 8, "duplicate": 6, "duplicate_rate": 0.6}, "editing": {"total_edits": 3, "total_opportunities": 9, "ct_edits": 1, "ga_edits": 2}}
    a = report.assess(m)
    assert a["overall"] == "PASS" and len(a["notes"]) == 1 and "duplicates" in a["notes"][0]
    for path, value in (("passing", 11), ("passing", None), ("total", 5)):
        assert report.assess({**m, "reads": m["reads"] | {path: value}})["overall"] == "FAIL"
    for path, value in (("total_edits", 10), ("ga_edits", 3), ("total_opportunities", 0)):
        assert report.assess({**m, "editing": m["editing"] | {path: value}})["overall"] == "FAIL"
    assert report.assess({})["overall"] == "FAIL"


def test_said_and_shareable():
    assert [report.said(x, k) for x, k in ((0.1234, "a_rate"), (1234567, ""), (2.5e9, ""), (999, ""), (12000, ""), (None, ""), (float("nan"), ""), (True, ""), ({"a": 1}, ""))] == ["12.34%", "1.23 M", "2.50 B", "999", "12.00 K", "n/a", "n/a", "yes", "a: 1"]
    m = {"provenance": {"bam": "/data/x/a.bam", "command": "run --bam /data/x/a.bam", "win": "C:\\x\\b.fa", "n": 3, "all": ["/", "plain"]}}
    assert report.shareable(m) == {"provenance": {"bam": "a.bam", "command": "run --bam a.bam", "win": "b.fa", "n": 3, "all": ["[root]", "plain"]}} and m["provenance"]["bam"] == "/data/x/a.bam"


def test_portable_page(spark, sample):
    d = sample[0]
    jobs.quality(spark, f"{d}/x.bam", f"{d}/g.fa", f"{d}/qc2", "s3", redact=True, portable=True)
    page = (d / "qc2/s3/report.html").read_text()
    assert str(d) not in page and "x.bam" in page and page.count("<svg") >= 4 and (d / "qc2/s3/data/context.csv").exists()
    assert str(d) in (d / "qc2/s3.json").read_text()


def test_alignment(spark, sample, tmp_path):
    """Converted reference and reads, and the records chosen and restored from an aligner's output."""
    d, seq, *_ = sample
    jobs.converted_index(spark, f"{d}/g.fa", str(tmp_path / "c2t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c2t").glob("part-*")))
    both = [x.split("\n", 1) for x in text.split(">")[1:]]
    assert [(a, b.replace("\n", "")) for a, b in both] == [("fchr1", seq.replace("C", "T")), ("rchr1", seq.replace("G", "A"))]
    for m in (1, 2):
        (tmp_path / f"{m}.fq").write_text(f"@a/{m}\nACGTC\n+\nIIII{m}\n")
    jobs.converted_reads(spark, str(tmp_path / "1.fq"), str(tmp_path / "fq"), str(tmp_path / "2.fq"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "fq").glob("part-*"))).split("\n")
    assert lines[::4][:4] == [f"@a\tYS:Z:ACGTC\tYC:Z:{c}" for c in "ffrr"] and lines[1::4] == ["ATGTT", "ACATC", "ACATC", "ATGTT"]
    jobs.converted_reads(spark, str(tmp_path / "1.fq"), str(tmp_path / "single"))
    single = "".join(p.read_text() for p in sorted((tmp_path / "single").glob("part-*"))).split("\n")
    assert [x[-2:] for x in single[::4][:2]] == ["ct", "ga"]
    rows = []
    for i, at in enumerate((100, 40)):
        own = seq[at : at + 30]
        for c, s in (("ct", own.replace("C", "T")), ("ga", own.replace("G", "A"))):
            rows.append(f"r{i}\t0\t{'fr'[c == 'ga']}chr1\t{at + 1}\t60\t30M\t*\t0\t0\t{s}\t{'I' * 30}\tYS:Z:{own}\tYC:Z:{c}\tAS:i:{30 if c == 'ct' else 25}\tNM:i:9")
    (tmp_path / "x.sam").write_text("@SQ\tSN:fchr1\tLN:600\n" + "\n".join(rows) + "\n")
    jobs.chosen_alignments(spark, str(tmp_path / "x.sam"), f"{d}/g.fa", str(tmp_path / "out.bam"))
    got = alignments.bam(spark, str(tmp_path / "out.bam")).orderBy("file_ord").collect()
    assert [(r["qname"], r["chrom"], r["pos"], r["mapq"], r["seq"]) for r in got] == [(f"r{i}", "chr1", at, 60, seq[at : at + 30]) for i, at in ((1, 40), (0, 100))]
    assert got[0]["tags"] == {"AS": "30", "NM": "0", "MD": "30", "ZC": "0", "ZG": "0"}
    assert alignments.bam_contigs(spark, str(tmp_path / "out.bam")).collect()[0]["chrom"] == "chr1"


def test_motifs_and_footprints(spark, sample, tmp_path):
    d, seq, *_ = sample
    (tmp_path / "m.pfm").write_text("\n".join(" ".join("9" if x == b else "0" for x in seq[250:262]) for b in "ACGT") + "\n")
    (tmp_path / "r.bed").write_text("chr1\t200\t400\n")
    jobs.motif_hits(spark, f"{d}/g.fa", str(tmp_path / "r.bed"), [str(tmp_path / "m.pfm")], str(tmp_path / "hits"))
    hits = [x.split("\t") for p in sorted((tmp_path / "hits").glob("part-*")) for x in p.read_text().splitlines()]
    assert [h[:4] + h[5:] for h in hits] == [["chr1", "250", "262", "m", "+"]]
    sizes = spark.createDataFrame([(0, "chr1", 600)], "ord long, chrom string, size long")
    bigwig.write(spark.range(600).selectExpr("'chr1' as chrom", "id as pos", "if(id between 300 and 309, 0D, 10D) as value"), sizes, str(tmp_path / "t.bw"))
    (tmp_path / "s.bed").write_text("chr1\t300\t310\tm\nchr1\t0\t10\tn\n")
    assert jobs.footprints(spark, str(tmp_path / "t.bw"), str(tmp_path / "s.bed"), str(tmp_path / "f"), n_shuffles=200) == 1
    line = [x for p in sorted((tmp_path / "f").glob("part-*")) for x in p.read_text().splitlines()][0].split("\t")
    assert line[:5] == ["chr1", "300", "310", "m", "20"] and float(line[5]) < 0.05
    w = jobs.training_set(spark, f"{d}/g.fa", str(tmp_path / "t.bw"), str(tmp_path / "r.bed"), 64).orderBy("start").collect()
    assert [r["start"] for r in w] == [200, 264, 328] and w[1]["y"][35:47] == [10.0] + [0.0] * 10 + [10.0]
    assert ["".join("ACGT"[x.index(1)] for x in r["x"]) for r in w] == [seq[a : a + 64] for a in (200, 264, 328)]


def test_options():
    a = parser().parse_args(["track", "--bam", "a", "--out", "b", "--extend", "3", "--normalize"])
    assert (a.extend, a.normalize, a.fasta, a.min_mapq, a.min_coverage) == (3, True, None, 20, 10)
