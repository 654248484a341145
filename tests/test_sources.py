"""File formats: small hand-made files, and round trips of what is written."""

import gzip
import random

import pytest
from editscan.operators.reads import READS
from editscan.sources import alignments, bigwig, sequences, text
from pyspark.errors import PySparkException


def put(tmp_path, name, body, mode="w"):
    p = tmp_path / name
    with open(p, mode) as f:
        f.write(body)
    return str(p)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def read_lines(folder):
    return [x for p in sorted(folder.glob("part-*")) for x in (gzip.open(p, "rt") if p.suffix == ".gz" else open(p)).read().splitlines()]


def test_bed(spark, tmp_path):
    p = put(tmp_path, "a.bed", "# c\ntrack x\nbrowser y\n\nchr1\t5\t9\tb\nchr1\t0\t5\tx\nchr1\t20\t20\nchr2\t1\t3\r\n")
    assert rows(text.bed(spark, p)) == [("chr1", 0, 9), ("chr1", 20, 20), ("chr2", 1, 3)]
    assert [r["name"] for r in text.bed_sites(spark, p).orderBy("site_id").collect()] == ["b", "x", ".", "."]
    assert text.bed(spark, put(tmp_path, "none.bed", "#\n\n")).count() == 0
    for bad in ("chr1\tx\t3\n", "chr1\t5\t3\n", "chr1\t5\n", "chr1\t1.5\t3\n"):
        with pytest.raises(PySparkException):
            text.bed(spark, put(tmp_path, "bad.bed", bad)).collect()


def test_tss(spark, tmp_path):
    p = put(tmp_path, "t.bed", "chr1\t10\t11\t-\nchr1\t10\t13\tn\t0\t-\nchr1\t4\t4\nchr9\t1\t2\n")
    a = text.tss(spark, p)
    assert [tuple(r)[1:] for r in a.orderBy("anchor_id").collect()] == [("chr1", 10, True), ("chr1", 11, True), ("chr1", 4, False), ("chr9", 1, False)]
    sizes = spark.createDataFrame([(0, "chr1", 20)], "ord long, chrom string, size long")
    assert tuple(text.tss_diagnostics(a, sizes, 5).first()) == (4, 1, 1, 2)
    with pytest.raises(PySparkException):
        text.tss(spark, put(tmp_path, "bad.bed", "chr1\t5\t3\n")).collect()


def test_sizes_and_order(spark, tmp_path):
    p = put(tmp_path, "s", "".join(f"c{i}\t{i}\t7\n" for i in range(1000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert [tuple(r) for r in text.chrom_sizes(spark, p).orderBy("ord").collect()] == [(i, f"c{i}", i) for i in range(1000)]
        q = put(tmp_path, "r.fq", "".join(f"@n{i}/1 x\n{'ACGT' * (i % 5)}\n+\n{'@III' * (i % 5)}\n" for i in range(500)))
        got = sequences.fastq(spark, q).orderBy("idx").collect()
        assert [(r["idx"], r["name"], r["seq"], r["qual"]) for r in got] == [(i, f"n{i}/1", "ACGT" * (i % 5), "@III" * (i % 5)) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq(spark, tmp_path):
    p = tmp_path / "r.fq.gz"
    p.write_bytes(gzip.compress(b"@a b\nAC\n+\nI@\n@c\nG\n+\n#\n\n"))
    got = sequences.fastq(spark, str(p), mate=2)
    assert rows(got) == [(0, 2, "a", "AC", "I@"), (1, 2, "c", "G", "#")]
    sequences.write_fastq(got, str(tmp_path / "out"))
    assert read_lines(tmp_path / "out") == ["@a", "AC", "+", "I@", "@c", "G", "+", "#"]
    for bad in ("@a\nAC\n+\n", "@a\nAC\n+\nI\n", "a\nAC\n+\nII\n"):
        with pytest.raises(PySparkException):
            sequences.fastq(spark, put(tmp_path, "bad.fq", bad)).collect()


def test_fasta(spark, tmp_path):
    rng = random.Random(0)
    seqs = {"chrB": "".join(rng.choice("acgtN") for _ in range(2503)), "chrA": "ACGT", "chrC": ""}
    p = put(tmp_path, "g.fa", "".join(f">{k} some text\n" + "".join(v[i : i + 60] + "\n" for i in range(0, len(v), 60)) for k, v in seqs.items()))
    fa = sequences.fasta(spark, p)
    assert [tuple(r) for r in fa.orderBy("ord").collect()] == [(i, k, len(v), v.upper()) for i, (k, v) in enumerate(seqs.items())]
    c = sequences.chunks(fa)
    assert rows(c.select("chrom", "chunk", "start", "size"))[1:] == [("chrB", 0, 0, 2503), ("chrB", 1, 992, 2503), ("chrB", 2, 1992, 2503)]
    b = {(r["chrom"], r["pos"]): r["ref"] for r in sequences.bases(c).collect()}
    assert b == {(k, i): x for k, v in seqs.items() for i, x in enumerate(v.upper())}
    sequences.write_fasta(fa.where("size > 0"), str(tmp_path / "out"))
    again = sequences.fasta(spark, put(tmp_path, "again.fa", "\n".join(read_lines(tmp_path / "out")) + "\n"))
    assert rows(again.select("chrom", "seq")) == rows(fa.where("size > 0").select("chrom", "seq"))
    assert max(map(len, read_lines(tmp_path / "out"))) == 80


def test_motifs(spark, tmp_path):
    p = put(tmp_path, "MA1.1.pfm", "1 2\n3 4\n5 6\n7 8\n")
    q = put(tmp_path, "M2.pfm", ">MA x\nA [ 1 0 ]\nC [ 0 1 ]\nG [ 0 0 ]\nT [ 0 0 ]\n")
    assert text.motif_files(spark, [p, q]) == {"MA1.1": [[1, 3, 5, 7], [2, 4, 6, 8]], "M2": [[1, 0, 0, 0], [0, 1, 0, 0]]}
    with pytest.raises(ValueError, match="four rows"):
        text.motif_files(spark, [put(tmp_path, "bad.pfm", "1 2\n")])
    with pytest.raises(PySparkException):
        text.motif_files(spark, [str(tmp_path / "missing.pfm")])


def some_reads(n=3000):
    rng, out = random.Random(1), []
    for i in range(n):
        k = rng.randint(0, 90)
        seq = "".join(rng.choice("ACGTN") for _ in range(k)) or None
        place = rng.choice(["chr1", "chr2", None])
        tags = {"CB": str(rng.randint(0, 9)), "NM": str(rng.randint(-3, 70000)), "XA": "a,b;"} if i % 3 else {}
        out.append((i, f"r{rng.randint(0, 999)}", rng.choice([0, 16, 99, 147, 4]), place, rng.randint(0, 9000) if place else -1, rng.randint(0, 60), f"{k}M" if place and k else None, place, rng.randint(0, 9000) if place else -1, rng.randint(-500, 500), seq, [rng.randint(0, 41) for _ in range(k)] if seq and i % 5 else None, tags))
    return out


def content(df):
    return sorted((r["qname"], r["flag"], r["chrom"] or "", r["pos"], r["mapq"], r["cigar"] or "", r["next_chrom"] or "", r["next_pos"], r["tlen"], r["seq"] or "", r["qual"] or [], sorted((r["tags"] or {}).items())) for r in df.collect())


def test_bam(spark, tmp_path):
    df = spark.createDataFrame(some_reads(), READS)
    sizes = spark.createDataFrame([(0, "chr2", 10_000), (1, "chr1", 10_000)], "ord long, chrom string, size long")
    path = str(tmp_path / "x.bam")
    alignments.write_bam(df, sizes, path)
    assert [tuple(r) for r in alignments.bam_contigs(spark, path).orderBy("ord").collect()] == [(0, "chr2", 10_000), (1, "chr1", 10_000)]
    whole = alignments.bam(spark, path)
    assert content(whole) == content(df)
    order = [({"chr2": 0, "chr1": 1, None: 2}[r["chrom"]], r["pos"]) for r in whole.orderBy("file_ord").collect()]
    assert order == sorted(order)
    for split in (700, 9_000, 40_000):
        assert rows(alignments.bam(spark, path, split=split).select("file_ord", "qname", "pos")) == rows(whole.select("file_ord", "qname", "pos"))
    with gzip.open(path) as f:
        assert f.read(4) == b"BAM\x01"
    alignments.write_bam(df.limit(0), sizes, str(tmp_path / "none.bam"))
    assert alignments.bam(spark, str(tmp_path / "none.bam")).count() == 0


def test_sam(spark, tmp_path):
    body = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:100\na\t99\tchr1\t5\t60\t4M\t=\t9\t8\tACGT\tII#I\tNM:i:3\tCB:Z:x:y\nb\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"
    p = put(tmp_path, "x.sam", body)
    got = [r.asDict() for r in alignments.sam(spark, p).orderBy("file_ord").collect()]
    assert [v for k, v in got[0].items() if k != "file_ord"] == ["a", 99, "chr1", 4, 60, "4M", "chr1", 8, 8, "ACGT", [40, 40, 2, 40], {"NM": "3", "CB": "x:y"}]
    assert [v for k, v in got[1].items() if k != "file_ord"] == ["b", 4, None, -1, 0, None, None, -1, 0, None, None, {}]
    df = spark.createDataFrame(some_reads(300), READS)
    sizes = spark.createDataFrame([(0, "chr2", 10_000), (1, "chr1", 10_000)], "ord long, chrom string, size long")
    alignments.write_sam(df, sizes, str(tmp_path / "out"))
    lines = read_lines(tmp_path / "out")
    assert lines[:3] == ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr2\tLN:10000", "@SQ\tSN:chr1\tLN:10000"]
    again = put(tmp_path, "again.sam", "\n".join(lines) + "\n")
    assert content(alignments.sam(spark, again)) == content(df)
    assert rows(alignments.sam_contigs(spark, again).select("chrom", "size")) == [("chr1", 10_000), ("chr2", 10_000)]


def test_bigwig(spark, tmp_path):
    sizes = spark.createDataFrame([(0, "chrB", 700_000), (1, "chrA", 50), (2, "empty", 5)], "ord long, chrom string, size long")
    track = spark.range(600_000).selectExpr("'chrB' as chrom", "id as pos", "cast(id % 3 as double) / 2 as value").unionByName(spark.createDataFrame([("chrA", 7, 0.25), ("chrA", 3, -4.0), ("gone", 1, 1.0)], "chrom string, pos long, value double"))
    path = str(tmp_path / "x.bw")
    bigwig.write(track, sizes, path)
    assert rows(bigwig.contigs(spark, path)) == [(0, "chrB", 700_000), (1, "chrA", 50), (2, "empty", 5)]
    got, want = bigwig.read(spark, path), track.where("value <> 0 and chrom <> 'gone'")
    assert got.count() == want.count() == 400_002 and got.exceptAll(want).count() == 0
    bigwig.write(track.limit(0), sizes, str(tmp_path / "none.bw"))
    assert bigwig.read(spark, str(tmp_path / "none.bw")).count() == 0


def test_bigwig_other_sections():
    import struct

    bed = struct.pack("<IIIIIBBH", 4, 0, 0, 0, 0, 1, 0, 2) + struct.pack("<IIfIIf", 3, 6, 1.5, 9, 10, 2.0)
    assert [x.tolist() if hasattr(x, "tolist") else x for x in bigwig._section(bed, "<")] == [4, [3, 4, 5, 9], [1.5, 1.5, 1.5, 2.0]]
    fixed = struct.pack(">IIIIIBBH", 0, 10, 0, 5, 2, 3, 0, 2) + struct.pack(">ff", 1.0, 3.0)
    assert [x.tolist() if hasattr(x, "tolist") else x for x in bigwig._section(fixed, ">")] == [0, [10, 11, 15, 16], [1.0, 1.0, 3.0, 3.0]]


def test_text_sinks(spark, tmp_path):
    sizes = spark.createDataFrame([(0, "chr2", 100), (1, "chr1", 100)], "ord long, chrom string, size long")
    table = spark.createDataFrame([("chr1", 1, 9, "10|20", ".", None, 2), ("chr1", 1, 9, "9", ".", "B", 1), ("chr1", 1, 9, ".", "3", "A", 1), ("chr2", 0, 4, ".", ".", "A", 7)], "chrom string, start long, end long, c2t string, g2a string, barcode string, n long")
    text.write_fragments(table.na.fill("."), sizes, str(tmp_path / "f"), barcode=True, compress=True)
    assert read_lines(tmp_path / "f") == ["chr2\t0\t4\t.\t.\tA\t7", "chr1\t1\t9\t.\t3\tA\t1", "chr1\t1\t9\t9\t.\tB\t1", "chr1\t1\t9\t10|20\t.\t.\t2"]
    sites = spark.createDataFrame([(0, "chr1", 1, 3, "m"), (1, "chr2", 1, 3, ".")], "site_id long, chrom string, start long, end long, name string")
    scored = spark.createDataFrame([(0, 20.0, 1 / 3), (1, 1234567.0, 1.0)], "site_id long, score double, p_value double")
    text.write_footprints(sites, scored, sizes, str(tmp_path / "p"))
    assert read_lines(tmp_path / "p") == ["chr2\t1\t3\t.\t1.23457e+06\t1", "chr1\t1\t3\tm\t20\t0.333333"]
    text.write_bedgraph(spark.createDataFrame([("chr1", 5, 2.0), ("chr2", 9, 0.0), ("chr2", 8, 1.0)], "chrom string, pos long, value double"), sizes, str(tmp_path / "b"))
    assert read_lines(tmp_path / "b") == ["chr2\t8\t9\t1.0", "chr1\t5\t6\t2.0"]
