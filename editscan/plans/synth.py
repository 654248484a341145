"""The driver's tables projected to alignment records by integer arithmetic: test input, arbitrary and not biological."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIZE = 20_000
_REF = "substr('ACGT', cast(1 + (((p*7919 + ch*104729) % 10007) * ((p*31+17) % 1009)) % 4 as int), 1)"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt by order once, which serves the distinct lines as well as their mates.
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("bigint").alias("ok"), F.col("l_linenumber").cast("bigint").alias("ln")).repartition("ok").distinct()
    d = li.where("ok is not null and ln is not null").withColumn("g", F.expr("(ln - 1) div 2")).withColumn("mated", F.count("*").over(Window.partitionBy("ok", "g")) == 2)
    d = d.selectExpr("ok", "ln", "mated", "ok % 4 as ch", "ok * 4 + g as f", "(ln - 1) % 2 as m", "(ok*7919 + g*613) % 19800 as p0", "(ok*31) % 60 as gap", "(ok*ln*7) % 61 as mapq", "(ok*13 + ln) % 17 = 0 as dup")
    return d.withColumn("pos", F.expr("p0 + m * gap")).withColumn("file_ord", F.expr("ok * 100 + ln"))


_FLAG = "cast(1 + if(mated, 2 + if(m = 0, 32, 0), 8) + if(m = 1, 16 + 128, 64) + if(dup, 1024, 0) as int)"
_MORE = f"cast({_FLAG} | if((ok*5+ln) % 19 = 0, 256, 0) | if((ok*7+ln) % 23 = 0, 2048, 0) | if((ok*11+ln) % 31 = 0, 512, 0) | if((ok*3+ln) % 29 = 0, 4, 0) as int)"
_QUAL = "transform(sequence(0L, 39L), i -> case (ok*13 + ln*7 + i*11) % 8 when 0 then 2 when 1 then 12 when 2 then 23 when 3 then 23 else 37 end)"
_BASE = f"""transform(sequence(0L, 39L), i -> (pos + i)) ps"""
_CIGARS = "case (ok + ln) % 5 when 2 then '5S35M' when 3 then '20M2D20M' when 4 then '18M2I20M' else '40M' end"


def reads(spark: SparkSession, sf_dir: str, varied: bool = False) -> DataFrame:
    """Records of 40 bases, mates where both lines of an order exist; ``varied`` adds flags and CIGARs."""
    k = keys(spark, sf_dir)
    # Bases as digits 0 to 3, the reference's first, so that each is worked out once.
    ref = "((((pos+i)*7919 + ch*104729) % 10007) * (((pos+i)*31+17) % 1009)) % 4"
    base = "case when (ok*7 + ln*5 + i*3) % 23 = 0 then (ok+i) % 4 when b in (1, 2) and (f*31 + (pos+i)*17) % 10 < 3 then if(b = 1, 3, 0) else b end"
    seq = f"translate(array_join(cast(transform(transform(sequence(0L, 39L), i -> {ref}), (b, i) -> {base}) as array<string>), ''), '0123', 'ACGT')"
    return k.selectExpr(
        "file_ord", "concat('f', f) as qname", f"{_MORE if varied else _FLAG} as flag", "concat('chr', ch + 1) as chrom", "pos", "cast(mapq as int) as mapq", f"{_CIGARS if varied else repr('40M')} as cigar",
        "if(mated, concat('chr', ch + 1), null) as next_chrom", "if(mated, p0 + (1 - m) * gap, null) as next_pos", "if(mated, (gap + 40) * if(m = 0, 1, -1), 0) as tlen",
        f"{seq} as seq", f"{_QUAL} as qual", "if(ok % 7 = 0, map(), map('CB', concat('BC', ok % 5))) as tags",
    )


def reference_bases(spark: SparkSession) -> DataFrame:
    return spark.range(4 * SIZE).selectExpr(f"id div {SIZE} as ch", f"id % {SIZE} as p").selectExpr("concat('chr', ch + 1) as chrom", "p as pos", f"{_REF} as ref")


def chunks(spark: SparkSession, width: int = 1000, more: int = 8) -> DataFrame:
    c = spark.range(4 * SIZE // width).selectExpr(f"id div {SIZE // width} as ch", f"id % {SIZE // width} as chunk")
    seq = f"array_join(transform(sequence(greatest(chunk*{width} - {more}, 0L), least(chunk*{width} + {width + more}, {SIZE}L) - 1), p -> {_REF}), '')"
    return c.selectExpr("concat('chr', ch + 1) as chrom", "chunk", f"greatest(chunk*{width} - {more}, 0L) as start", f"{seq} as seq", f"{SIZE}L as size")


def sizes(spark: SparkSession) -> DataFrame:
    return spark.range(4).selectExpr("id as ord", "concat('chr', id + 1) as chrom", f"{SIZE}L as size")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some overlap, some touch, and the first of each 400 suppliers is empty."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("cast(s_suppkey as bigint) s").distinct().selectExpr("concat('chr', s % 4 + 1) as chrom", "(s*977) % 19000 as start", "(s*977) % 19000 + (s*37) % 400 as end", "s as region_id")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("cast(s_suppkey as bigint) s").distinct().selectExpr("s as anchor_id", "concat('chr', s % 4 + 1) as chrom", "(s*1511) % 20000 as center", "s % 2 = 1 as is_minus")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("cast(s_suppkey as bigint) s").distinct().selectExpr("s as site_id", "concat('chr', s % 4 + 1) as chrom", "(s*733) % 19990 as start", "(s*733) % 19990 + 5 + s % 10 as end")


def candidate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates a mate on converted contigs of either prefix; about a third of the reads tie or land elsewhere, and some mates are unmapped or secondary."""
    k = keys(spark, sf_dir).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("c"))
    return k.selectExpr("file_ord * 2 + c as file_ord", "concat('f', f) as qname", "if(c = 0, 'f', 'r') as candidate", f"cast({_FLAG} | if((ok*3 + ln + c) % 29 = 0, 4, 0) | if((ok*5 + ln + c) % 19 = 0, 256, 0) as int) as flag", "concat(if((ok div 4 + c) % 2 = 0, 'f', 'r'), 'chr', ch + 1) as chrom", "pos + if(ok % 3 = 0, c * 7, 0) as pos", "'40M' as cigar", "mapq", "(ok*ln*13 + c*((ok % 5) * 3)) % 41 as score")
