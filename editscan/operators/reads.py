"""Filters, counters and checks on alignment records (file_ord, qname, flag, chrom, pos, mapq, cigar, next_chrom, next_pos, tlen, seq, qual, tags)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import EXCLUDED_FLAGS, cigar_sum, has, ref_end

READS = "file_ord long, qname string, flag int, chrom string, pos long, mapq int, cigar string, next_chrom string, next_pos long, tlen long, seq string, qual array<int>, tags map<string,string>"


def passing(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """Primary, mapped, unique records of at least min_mapq (inclusive)."""
    return flag_passing(reads).where(F.col("mapq") >= min_mapq)


def flag_passing(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("flag").bitwiseAND(EXCLUDED_FLAGS) == 0)


def mate_can_pair() -> Column:
    return has(F.col("flag"), 1) & ~has(F.col("flag"), 8) & F.col("next_chrom").eqNullSafe(F.col("chrom"))


def cut_site(plus_shift: int = 4, minus_shift: int = -5) -> Column:
    """5' end, shifted: start + plus_shift, or on the reverse strand end + minus_shift (end is exclusive)."""
    return F.when(has(F.col("flag"), 16), ref_end(F.col("pos"), F.col("cigar")) + minus_shift).otherwise(F.col("pos") + plus_shift)


def read_counters(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """One row of overlapping counts; total includes unplaced records, low_mapq no unmapped ones."""
    flag, ok = F.col("flag"), (F.col("flag").bitwiseAND(EXCLUDED_FLAGS) == 0) & (F.col("mapq") >= min_mapq)
    n = lambda c, name: F.count_if(c).alias(name)
    return reads.agg(F.count("*").alias("total"), n(has(flag, 4), "unmapped"), n(has(flag, 1024), "duplicate"), n(has(flag, 256), "secondary"), n(has(flag, 2048), "supplementary"), n(has(flag, 512), "qcfail"), n(~has(flag, 4) & (F.col("mapq") < min_mapq), "low_mapq"), n(ok, "passing"), n(ok & has(flag, 2), "proper_pair"))


def cigar_diagnostics(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """Summed CIGAR bases of passing records; skipped reference (N) is no part of the span."""
    s = lambda kinds, name: F.coalesce(F.sum(cigar_sum(F.col("cigar"), kinds)), F.lit(0)).alias(name)
    return passing(reads, min_mapq).agg(s("MIS=X", "query_bases"), s("MD=X", "reference_span"), s("I", "inserted"), s("D", "deleted"), s("S", "soft_clipped"))


def index_stats(reads: DataFrame) -> DataFrame:
    """Records by contig; the row with a null contig has those without a place."""
    return reads.groupBy("chrom").agg(F.count("*").alias("n"))


def library_layout(reads: DataFrame, n: int = 10_000) -> DataFrame:
    """paired if any of the first n records is."""
    return reads.orderBy("file_ord").limit(n).agg(F.when(F.max(F.col("flag").bitwiseAND(1)) == 1, "paired").otherwise("single").alias("layout"))


def contig_check(contigs: DataFrame, reference: DataFrame) -> DataFrame:
    """Contigs (chrom, size) that the reference lacks or has at another length; raise if any are left."""
    return contigs.select("chrom", "size").join(reference.select("chrom", "size"), ["chrom", "size"], "left_anti")


def require_contigs(contigs: DataFrame, reference: DataFrame) -> None:
    bad = [r["chrom"] for r in contig_check(contigs, reference).orderBy("chrom").limit(5).collect()]
    if bad:
        raise ValueError(f"contigs missing from the reference or of another length: {', '.join(map(str, bad))}")


def sample_by_name(reads: DataFrame, fraction: float, seed: str = "0") -> DataFrame:
    """Keeps a name, with all its records, if its hash is below the fraction: 32 bits of md5(seed:name)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("qname"))), 1, 8), 16, 10).cast("bigint")
    return reads.where(h < int(fraction * 2**32))


def sample_by_keyed_name(reads: DataFrame, fraction: float, key: str = "") -> DataFrame:
    """As sample_by_name with a keyed blake2b of 64 bits, which needs Python."""
    @F.pandas_udf("boolean")
    def keep(names: pd.Series) -> pd.Series:
        top = fraction * 2**64
        return names.map(lambda s: int.from_bytes(hashlib.blake2b((s or "").encode(), digest_size=8, key=key.encode()).digest(), "big") < top)

    return reads.where(keep("qname"))
