"""Candidates, caps and restored records on small cases with known answers, and mates and samples against plain Python."""

import hashlib

import pytest
from editscan.operators import candidates, reads
from editscan.operators.reads import READS
from pyspark.sql import functions as F


def record(i, name, flag, chrom, pos, seq, cigar=None, mapq=60, **tags):
    return (i, name, flag, chrom, pos, mapq, cigar or f"{len(seq or '')}M", None, -1, 0, seq, [40] * len(seq or ""), tags)


def chunks(spark, **contigs):
    return spark.createDataFrame([(c, k, 10 * k, s[10 * k : 10 * k + 10]) for c, s in contigs.items() for k in range(-(-len(s) // 10))], "chrom string, chunk long, start long, seq string")


def chosen(spark, rows, width=10, **contigs):
    df = candidates.chosen_records(spark.createDataFrame(rows, READS), chunks(spark, **contigs), width)
    return {r["file_ord"]: r for r in df.collect()}


@pytest.mark.parametrize("chrom, score, want", [("rchr1", 50, 60), ("rchr2", 50, 0), ("rchr2", 47, 3)])
def test_mapq_cap(spark, chrom, score, want):
    rows = [record(0, "r", 0, "fchr1", 0, "ATGTT", YS="ACGTC", YC="ct", AS="50"), record(1, "r", 0, chrom, 0, "ATGTT", YS="ACGTC", YC="ga", AS=str(score))]
    got = chosen(spark, rows, chr1="ACGTC", chr2="ACGTC")
    assert {k: r["mapq"] for k, r in got.items()} == {0: want}


@pytest.mark.parametrize("second, want", [(30, 60), (40, 0)])
def test_cap_looks_at_both_mates(spark, second, want):
    rows = [record(4 * k + m, "p", 65 + 64 * m, f"{c}chr1", [10, at][m], "ATGTT", YS="ACGTC", YC=c, AS="50") for k, (c, at) in enumerate((("f", 30), ("r", second))) for m in (0, 1)]
    got = chosen(spark, rows, chr1="ACGTC" * 12)
    assert {k: r["mapq"] for k, r in got.items()} == {0: want, 1: want}


def test_cap_is_per_record_and_unmapped_rivals_do_not_count(spark):
    rows = [record(0, "a", 65, "fchr1", 0, "ACGTC", mapq=60, YC="f", AS="50"), record(1, "a", 129, "fchr1", 20, "ACGTC", mapq=7, YC="f", AS="50"), record(2, "a", 65, "rchr2", 0, "ACGTC", YC="r", AS="50"), record(3, "a", 129, "rchr2", 20, "ACGTC", YC="r", AS="10")]
    rows += [record(4, "b", 0, "fchr1", 0, "ACGTC", YC="f", AS="41"), record(5, "b", 4, None, -1, "ACGTC", YC="r")]
    got = chosen(spark, rows, chr1="ACGTC" * 12)
    assert {k: r["mapq"] for k, r in got.items()} == {0: 40, 1: 7, 4: 60}


def test_no_primary_scores_zero(spark):
    rows = [record(0, "a", 256, "fchr1", 0, "ACGTC", YC="f", AS="50"), record(1, "a", 4, None, -1, "ACGTC", YC="r")]
    s = candidates.candidate_scores(spark.createDataFrame(rows, READS).withColumn("candidate", F.col("tags")["YC"]).withColumn("score", F.col("tags")["AS"].cast("int")))
    assert {r["candidate"]: (r["score"], r["placement"]) for r in s.collect()} == {"f": (0, []), "r": (-1, [])}


def tags(spark, seq, cigar, width=10, pos=0, **contigs):
    c = next(iter(contigs))
    r = candidates.reference_tags(spark.createDataFrame([(1, c, pos, cigar, seq)], "k long, chrom string, pos long, cigar string, seq string"), chunks(spark, **contigs), ["k"], width).first()
    return r["nm"], r["md"], r["zc"], r["zg"]


def test_reference_tags(spark):
    assert tags(spark, "TACAGTACG", "1S2M1I2M1D1M1N2M1H", chr1="ACGTACGTACGT") == (5, "4^A0C0T0A0", 0, 0)
    assert tags(spark, "gttaa", "1S1M1I1X1D1N1M1H", chr1="CGCCG")[2:] == (1, 2)
    assert tags(spark, "ANGT", "4M", chr1="ACGT") == (1, "1C2", 0, 0)
    assert tags(spark, "ACGTACGTACGT", "12M", pos=4, chr1="ACGTACGTACGTACGTACGT") == (0, "12", 0, 0)
    with pytest.raises(Exception, match="beyond the reference"):
        tags(spark, "ACGTA", "5M", chr1="ACGT")


def test_restored_hits(spark):
    ref = {"chr1": "ACGTACGTACGT"}
    line = dict(YS="ATGT", NM="0", MD="4", SA="rchr1,1,-,4M,60,0;", XA="fchr1,+1,4M,0;", XS="3")
    got = chosen(spark, [record(0, "r", 0, "fchr1", 0, "ATGT", **line), record(1, "s", 16, "fchr1", 0, "ATGT", **line)], **ref)
    assert got[0]["tags"] == {"NM": "1", "MD": "1C2", "ZC": "1", "ZG": "0", "SA": "chr1,1,-,4M,60,1;", "XA": "chr1,+1,4M,1;", "XS": "3"} and got[0]["chrom"] == "chr1"
    assert got[1]["seq"] == "ACAT" and got[1]["tags"]["MD"] == "2G1"


def test_split_hits_are_capped(spark):
    rows = [record(0, "r", 0, "fchr1", 0, "ACGT", YS="ACGT", YC="f", AS="9", SA="fchr1,5,+,4M,50,0;rchr1,1,+,4M,2,0;"), record(1, "r", 0, "rchr1", 4, "ACGT", YS="ACGT", YC="r", AS="5")]
    assert chosen(spark, rows, chr1="ACGTACGTACGT")[0]["tags"]["SA"] == "chr1,5,+,4M,4,0;chr1,1,+,4M,2,0;"


def test_restored_edges(spark):
    got = chosen(spark, [record(0, "a", 16, "fchr1", 0, "AAAA", "2H4M1H", YS="AACATTG"), record(1, "b", 4, None, -1, "CGCC", YS="CGCC", ZC="99", NM="99"), record(2, "c", 0, "fchr1", 0, None, "4M", YS="ACGT", ZG="99"), record(3, "d", 0, "rchr1", 0, "ACGT", NM="7", SA="fchr1,1,+,4M,60,0;")], chr1="ACGT")
    assert (got[0]["seq"], got[0]["tags"]) == ("ATGT", {"NM": "1", "MD": "1C2", "ZC": "1", "ZG": "0"})
    assert got[1]["tags"] == got[2]["tags"] == got[3]["tags"] == {} and got[3]["seq"] == "ACGT"
    with pytest.raises(Exception, match="no sequence of this length"):
        chosen(spark, [record(0, "a", 0, "fchr1", 0, "ACGT", YS="ACG")], chr1="ACGT")


def test_zip_mates(spark):
    side = lambda names: spark.createDataFrame([(i, n, "ACGT") for i, n in enumerate(names)], "idx long, name string, seq string")
    assert [r["name"] for r in candidates.zip_mates(side(["a/1", "b"]), side(["a/2", "b"])).orderBy("idx").collect()] == ["a", "b"]
    for other in (["a"], ["a", "c"]):
        with pytest.raises(Exception, match="mate files differ"):
            candidates.zip_mates(side(["a", "b"]), side(other)).collect()


def test_keyed_sample(spark):
    names = [f"f{i}" for i in range(500)]
    want = {n for n in names if int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8, key=b"k").digest(), "big") < 0.25 * 2**64}
    got = reads.sample_by_keyed_name(spark.createDataFrame([(n,) for n in names], "qname string"), 0.25, "k")
    assert {r["qname"] for r in got.collect()} == want and 80 < len(want) < 170
