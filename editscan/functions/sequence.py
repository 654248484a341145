"""Sequences, CIGAR strings and coordinates as column expressions. Coordinates are 0-based, half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
#: unmapped, secondary, quality-failed, duplicate, supplementary
EXCLUDED_FLAGS = 0x4 | 0x100 | 0x200 | 0x400 | 0x800


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTNacgtn", "TGCANtgcan"))


def convert_c_to_t(s: Column) -> Column:
    return F.translate(s, "Cc", "Tt")


def convert_g_to_a(s: Column) -> Column:
    return F.translate(s, "Gg", "Aa")


def is_edit(ref: Column, base: Column) -> Column:
    return ((ref == "C") & (base == "T")) | ((ref == "G") & (base == "A"))


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def cigar_ops(cigar: Column) -> Column:
    """array<struct<op, n>>; empty for null, empty or ``*``."""
    lens = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    kinds = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(kinds, lens, lambda o, n: F.struct(o.alias("op"), n.cast("bigint").alias("n")))


def cigar_sum(cigar: Column, kinds: str) -> Column:
    """Bases in operations of the given kinds."""
    return F.aggregate(cigar_ops(cigar), F.lit(0).cast("bigint"), lambda a, x: a + F.when(F.contains(F.lit(kinds), x["op"]), x["n"]).otherwise(0))


def ref_end(pos: Column, cigar: Column) -> Column:
    return pos + cigar_sum(cigar, "MDN=X")


def hard_clip(cigar: Column, end: bool = False) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cigar, r"(\d+)H$" if end else r"^(\d+)H", 1), F.lit("")), F.lit("999999999")).cast("bigint"), F.lit(0).cast("bigint"))


def aligned_pairs(cigar: Column) -> Column:
    """array<struct<q, r>>: query and reference offsets of M, = and X bases."""
    empty = F.array().cast("array<struct<q:bigint,r:bigint>>")

    def step(acc, x):
        match = F.contains(F.lit("M=X"), x["op"])
        here = F.when(match & (x["n"] > 0), F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(x["n"] - 1, F.lit(0))), lambda i: F.struct((acc["q"] + i).alias("q"), (acc["r"] + i).alias("r")))).otherwise(empty)
        q = acc["q"] + F.when(F.contains(F.lit("MIS=X"), x["op"]), x["n"]).otherwise(0)
        r = acc["r"] + F.when(F.contains(F.lit("MDN=X"), x["op"]), x["n"]).otherwise(0)
        return F.struct(q.alias("q"), r.alias("r"), F.concat(acc["out"], here).alias("out"))

    zero = F.lit(0).cast("bigint")
    general = F.aggregate(cigar_ops(cigar), F.struct(zero.alias("q"), zero.alias("r"), empty.alias("out")), step)["out"]
    # One run of matches, by far the most common, needs no fold.
    whole = F.regexp_extract(F.coalesce(cigar, F.lit("")), r"^(\d+)[M=X]$", 1)
    n = F.nullif(whole, F.lit("")).cast("bigint")
    simple = F.transform(F.sequence(zero, n - 1), lambda i: F.struct(i.alias("q"), i.alias("r")))
    return F.when(n > 0, simple).otherwise(general)


def cigar_blocks(cigar: Column) -> Column:
    """array<struct<op, n, q, r, j>>: each operation with the query, reference and aligned (M, =, X) bases before it."""
    empty = F.array().cast("array<struct<op:string,n:bigint,q:bigint,r:bigint,j:bigint>>")
    zero = F.lit(0).cast("bigint")

    def step(acc, x):
        add = lambda kinds: F.when(F.contains(F.lit(kinds), x["op"]), x["n"]).otherwise(0)
        here = F.struct(x["op"].alias("op"), x["n"].alias("n"), acc["q"].alias("q"), acc["r"].alias("r"), acc["j"].alias("j"))
        return F.struct((acc["q"] + add("MIS=X")).alias("q"), (acc["r"] + add("MDN=X")).alias("r"), (acc["j"] + add("M=X")).alias("j"), F.concat(acc["out"], F.array(here)).alias("out"))

    return F.aggregate(cigar_ops(cigar), F.struct(zero.alias("q"), zero.alias("r"), zero.alias("j"), empty.alias("out")), step)["out"]


def matched_blocks(cigar: Column) -> Column:
    """array<struct<n, q, r>> of the runs of M, = and X bases."""
    zero = F.lit(0).cast("bigint")
    run = lambda n, q, r: F.struct(n.alias("n"), q.alias("q"), r.alias("r"))
    general = F.transform(F.filter(cigar_blocks(cigar), lambda x: F.contains(F.lit("M=X"), x["op"]) & (x["n"] > 0)), lambda x: run(x["n"], x["q"], x["r"]))
    # One run of matches, by far the most common, needs no fold.
    n = F.nullif(F.regexp_extract(F.coalesce(cigar, F.lit("")), r"^(\d+)[M=X]$", 1), F.lit("")).cast("bigint")
    return F.when(n > 0, F.array(run(n, zero, zero))).otherwise(general)


def one_hot(seq: Column) -> Column:
    """A row of four per base in the order A, C, G, T; any other base is all zero."""
    return F.transform(F.filter(F.split(F.upper(seq), ""), lambda b: b != ""), lambda b: F.array(*[(b == x).cast("int") for x in BASES]))


def conv_length(n: Column, kernel: int, stride: int = 1, padding: int = 0) -> Column:
    """Output length of a convolution."""
    return F.floor((n + 2 * padding - (kernel - 1) - 1) / stride).cast("bigint") + 1


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
