"""Registered queries over the projected records, and independently written SQL of the plain form of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as fx
from ..operators import candidates, footprint, fragments, intervals, motif, profile, qc, reads, summary, tracks, windows
from . import synth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- SQL building blocks: naive forms, straight from the raw tables.
_REF = "substr('ACGT', CAST(1 + (((p*7919 + ch*104729) % 10007) * ((p*31+17) % 1009)) % 4 AS INT), 1)"
_FLAG = "1 + CASE WHEN mated THEN 2 + CASE WHEN m = 0 THEN 32 ELSE 0 END ELSE 8 END + CASE WHEN m = 1 THEN 144 ELSE 64 END + CASE WHEN dup THEN 1024 ELSE 0 END"
_R = f"""k AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) ok, CAST(l_linenumber AS BIGINT) ln FROM lineitem),
r0 AS (SELECT *, ok % 4 ch, 'chr' || (ok % 4 + 1) chrom, ok*4 + (ln-1)//2 f, (ln-1) % 2 m, (ok*7919 + ((ln-1)//2)*613) % 19800 p0, (ok*31) % 60 gap, (ok*ln*7) % 61 mapq, (ok*13+ln) % 17 = 0 dup, ok*100+ln file_ord, count(*) OVER (PARTITION BY ok, (ln-1)//2) = 2 mated FROM k),
r AS (SELECT *, p0 + m*gap pos, {_FLAG} flag, 'f' || f qname FROM r0),
v AS (SELECT *, (flag | CASE WHEN (ok*5+ln) % 19 = 0 THEN 256 ELSE 0 END | CASE WHEN (ok*7+ln) % 23 = 0 THEN 2048 ELSE 0 END | CASE WHEN (ok*11+ln) % 31 = 0 THEN 512 ELSE 0 END | CASE WHEN (ok*3+ln) % 29 = 0 THEN 4 ELSE 0 END) vflag, (ok+ln) % 5 cg FROM r),
pass AS (SELECT * FROM r WHERE mapq >= 20 AND NOT dup)"""
_B = f"""{_R},
b0 AS (SELECT ok, ln, ch, chrom, f, file_ord, i, pos + i p, CASE (ok*13 + ln*7 + i*11) % 8 WHEN 0 THEN 2 WHEN 1 THEN 12 WHEN 2 THEN 23 WHEN 3 THEN 23 ELSE 37 END q FROM pass, generate_series(0, 39) g(i)),
b1 AS (SELECT *, {_REF} rb FROM b0 WHERE q >= 20),
b AS (SELECT *, CASE WHEN (ok*7 + ln*5 + i*3) % 23 = 0 THEN substr('ACGT', CAST(1 + (ok+i) % 4 AS INT), 1) WHEN (f*31 + p*17) % 10 < 3 AND rb = 'C' THEN 'T' WHEN (f*31 + p*17) % 10 < 3 AND rb = 'G' THEN 'A' ELSE rb END base FROM b1),
fb AS (SELECT ch, chrom, f, p, any_value(rb) rb, min(base) base FROM (SELECT *, max(q) OVER (PARTITION BY chrom, f, p) mq FROM b) WHERE q = mq GROUP BY ch, chrom, f, p HAVING min(base) = max(base)),
e AS (SELECT *, (rb = 'C' AND base = 'T') OR (rb = 'G' AND base = 'A') ed FROM fb),
st AS (SELECT chrom, f, count(*) FILTER (ed AND rb = 'C') ct, count(*) FILTER (ed AND rb = 'G') ga, count(*) FILTER (ed) edits, count(*) FILTER (rb IN ('C','G')) editable, count(*) FILTER (rb <> base AND NOT ed) other FROM e GROUP BY chrom, f),
g AS (SELECT ch, 'chr' || (ch+1) chrom, p, {_REF} ref FROM generate_series(0, 3) c(ch), generate_series(0, 19999) d(p))"""
_S = "s AS (SELECT DISTINCT CAST(s_suppkey AS BIGINT) s FROM supplier), rg AS (SELECT 'chr' || (s % 4 + 1) chrom, (s*977) % 19000 a, (s*977) % 19000 + (s*37) % 400 z, s region_id FROM s)"
_MG = f"{_S}, mg AS (SELECT chrom, min(a) a, max(z) z FROM (SELECT *, sum(CASE WHEN pz IS NULL OR a > pz THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY a, z ROWS UNBOUNDED PRECEDING) i FROM (SELECT *, max(z) OVER (PARTITION BY chrom ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pz FROM rg)) GROUP BY chrom, i)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame, digits: int = 9) -> DataFrame:
    """Integers as BIGINT, doubles rounded: the types that both engines are compared in."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") or t.startswith("decimal") else F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _merged(s, d):
    return intervals.merge(synth.regions(s, d))


# --- intervals and reads


@query(f"WITH {_MG} SELECT chrom, a AS start, z AS \"end\" FROM mg")
def interval_merge(s, d):
    return longs(_merged(s, d))


@query(f"WITH {_R}, {_S} SELECT file_ord, region_id FROM r JOIN rg ON r.chrom = rg.chrom AND r.pos < rg.z AND rg.a < r.pos + 40 WHERE rg.a < rg.z")
def interval_overlap_reads(s, d):
    r = synth.reads(s, d).select("file_ord", "chrom", F.col("pos").alias("r_start"), fx.ref_end(F.col("pos"), F.col("cigar")).alias("r_end"))
    return intervals.overlap_join(r, synth.regions(s, d), ("r_start", "r_end"), ("start", "end")).select("file_ord", "region_id")


@query(f"WITH {_R}, {_S} SELECT file_ord, region_id FROM r JOIN rg ON r.chrom = rg.chrom AND r.pos >= rg.a AND r.pos < rg.z")
def point_in_region(s, d):
    return intervals.points_in(synth.reads(s, d).select("file_ord", "chrom", "pos"), synth.regions(s, d)).select("file_ord", "region_id")


@query(f"WITH {_R} SELECT file_ord FROM v WHERE mapq >= 20 AND vflag & 3844 = 0")
def read_filter(s, d):
    return reads.passing(synth.reads(s, d, varied=True)).select("file_ord")


@query(f"""WITH {_R}, o AS (SELECT file_ord, i, cg FROM v, generate_series(0, 41) g(i))
SELECT file_ord, CAST(CASE cg WHEN 2 THEN i + 5 WHEN 3 THEN CASE WHEN i < 20 THEN i ELSE i - 2 END WHEN 4 THEN CASE WHEN i < 18 THEN i ELSE i + 2 END ELSE i END AS BIGINT) q, CAST(i AS BIGINT) r FROM o
WHERE CASE cg WHEN 2 THEN i < 35 WHEN 3 THEN i < 20 OR i BETWEEN 22 AND 41 WHEN 4 THEN i < 38 ELSE i < 40 END""")
def cigar_aligned_pairs(s, d):
    return synth.reads(s, d, varied=True).select("file_ord", F.explode(fx.aligned_pairs(F.col("cigar"))).alias("a")).select("file_ord", "a.q", "a.r")


@query(f"WITH {_R} SELECT file_ord, pos + CASE cg WHEN 2 THEN 35 WHEN 3 THEN 42 WHEN 4 THEN 38 ELSE 40 END AS ref_end FROM v")
def ref_end(s, d):
    return synth.reads(s, d, varied=True).select("file_ord", fx.ref_end(F.col("pos"), F.col("cigar")).alias("ref_end"))


@query(f"WITH {_R} SELECT file_ord, (row_number() OVER (PARTITION BY chrom, qname ORDER BY file_ord) - 1) // 2 AS pair FROM pass")
def mate_pairing(s, d):
    return fragments.pair_by_arrival(reads.passing(synth.reads(s, d))).select("file_ord", "pair")


@query(f"WITH {_B} SELECT chrom, 'f' || f AS qname, p AS pos, base FROM fb")
def mate_base_merge(s, d):
    return fragments.merged_bases(synth.reads(s, d)).select("chrom", "qname", "pos", "base")


@query(f"WITH {_B}, o AS (SELECT count(*) n, min(base) <> max(base) x, min(q) = max(q) y FROM b GROUP BY chrom, f, p) SELECT count(*) FILTER (n = 2) overlap_positions, count(*) FILTER (n = 2 AND x) conflicts, count(*) FILTER (n = 2 AND x AND y) equal_quality_conflicts FROM o")
def overlap_diagnostics(s, d):
    return fragments.overlap_diagnostics(synth.reads(s, d))


@query(f"WITH {_R} SELECT count(*) total, count(*) FILTER (vflag & 4 > 0) unmapped, count(*) FILTER (vflag & 1024 > 0) duplicate, count(*) FILTER (vflag & 256 > 0) secondary, count(*) FILTER (vflag & 2048 > 0) supplementary, count(*) FILTER (vflag & 512 > 0) qcfail, count(*) FILTER (vflag & 4 = 0 AND mapq < 20) low_mapq, count(*) FILTER (vflag & 3844 = 0 AND mapq >= 20) passing, count(*) FILTER (vflag & 3844 = 0 AND mapq >= 20 AND vflag & 2 > 0) proper_pair FROM v")
def read_counters(s, d):
    return reads.read_counters(synth.reads(s, d, varied=True))


@query(f"WITH {_R} SELECT CAST(sum(40) AS BIGINT) query_bases, CAST(sum(CASE cg WHEN 2 THEN 35 WHEN 3 THEN 42 WHEN 4 THEN 38 ELSE 40 END) AS BIGINT) reference_span, CAST(sum(CASE cg WHEN 4 THEN 2 ELSE 0 END) AS BIGINT) inserted, CAST(sum(CASE cg WHEN 3 THEN 2 ELSE 0 END) AS BIGINT) deleted, CAST(sum(CASE cg WHEN 2 THEN 5 ELSE 0 END) AS BIGINT) soft_clipped FROM v WHERE mapq >= 20 AND vflag & 3844 = 0")
def cigar_diagnostics(s, d):
    return longs(reads.cigar_diagnostics(synth.reads(s, d, varied=True)))


@query(f"WITH {_R} SELECT chrom, count(*) n FROM r GROUP BY chrom")
def index_stats(s, d):
    return reads.index_stats(synth.reads(s, d))


@query(f"WITH {_R} SELECT CASE WHEN max(flag & 1) = 1 THEN 'paired' ELSE 'single' END layout FROM (SELECT * FROM r ORDER BY file_ord LIMIT 10000)")
def library_layout(s, d):
    return reads.library_layout(synth.reads(s, d))


@query(f"WITH {_R} SELECT file_ord FROM r WHERE CAST('0x' || substr(md5('0:' || qname), 1, 8) AS BIGINT) < CAST(floor(0.25 * 4294967296) AS BIGINT)")
def name_sample_md5(s, d):
    return reads.sample_by_name(synth.reads(s, d), 0.25).select("file_ord")


@query()
def name_sample_keyed(s, d):
    return reads.sample_by_keyed_name(synth.reads(s, d), 0.25).select("file_ord")


@query("SELECT chrom, size FROM (VALUES ('chr1', CAST(19999 AS BIGINT)), ('chr9', CAST(5 AS BIGINT))) t(chrom, size)")
def contig_check(s, d):
    asked = s.createDataFrame([("chr1", 19999), ("chr2", 20000), ("chr9", 5)], "chrom string, size long")
    return reads.contig_check(asked, synth.sizes(s))


@query(f"WITH {_R} SELECT file_ord FROM r WHERE flag & 1 > 0 AND flag & 8 = 0 AND mated")
def mate_can_pair(s, d):
    return synth.reads(s, d).where(reads.mate_can_pair()).select("file_ord")


# --- tracks


@query(f"WITH {_B} SELECT chrom, p AS pos, base, rb AS ref, count(*) n FROM e WHERE ed GROUP BY ALL")
def edit_calls(s, d):
    b = fragments.merged_bases(synth.reads(s, d), chunks=synth.chunks(s), ref_in=("C", "G"))
    return b.where(fx.is_edit(F.col("ref"), F.col("base"))).groupBy("chrom", "pos", "base", "ref").agg(F.count("*").alias("n"))


@query(f"WITH {_B} SELECT chrom, p AS pos, count(*) AS value FROM e WHERE ed GROUP BY chrom, p")
def edit_count_track(s, d):
    return tracks.edit_counts(synth.reads(s, d), synth.chunks(s))


@query(f"WITH {_B}, {_MG} SELECT e.chrom, p AS pos, count(*) AS value FROM e JOIN mg ON e.chrom = mg.chrom AND p >= a AND p < z WHERE ed GROUP BY ALL")
def edit_count_regions(s, d):
    return tracks.edit_counts(synth.reads(s, d), synth.chunks(s), regions=_merged(s, d))


def _extended(base: str) -> str:
    return f", t AS ({base}), x AS (SELECT t.chrom, y AS pos, value FROM t JOIN mg ON t.chrom = mg.chrom AND p >= a AND p < z, generate_series(greatest(p - 3, a), least(p + 3, z - 1)) u(y)) SELECT chrom, pos, CAST(sum(value) AS BIGINT) AS value FROM x GROUP BY chrom, pos"


@query(f"WITH {_B}, {_MG}" + _extended("SELECT chrom, p, count(*) value FROM e WHERE ed GROUP BY ALL"))
def edit_count_extended(s, d):
    return tracks.extend(tracks.in_regions(edit_count_regions(s, d), _merged(s, d)), 3)


@query(f"WITH {_B} SELECT chrom, p AS pos, count(*) AS coverage FROM e WHERE base IN ('A','C','G','T') GROUP BY chrom, p")
def coverage_track(s, d):
    return tracks.base_counts(synth.reads(s, d), synth.chunks(s)).where("coverage > 0").select("chrom", "pos", "coverage")


@query(f"WITH {_B} SELECT chrom, p AS pos, round(CAST(count(*) FILTER (ed) AS DOUBLE) / count(*), 9) AS value FROM e GROUP BY chrom, p HAVING count(*) >= 2 AND count(*) FILTER (ed) > 0")
def edit_ratio_track(s, d):
    return longs(tracks.edit_ratio(synth.reads(s, d), synth.chunks(s), min_coverage=2))


@query(f"WITH {_B}, t AS (SELECT chrom, p, count(*) n FROM e WHERE ed GROUP BY ALL) SELECT chrom, p AS pos, round(n * 1e6 / (SELECT CAST(sum(n) AS BIGINT) FROM t), 9) AS value FROM t")
def edit_count_normalized(s, d):
    return longs(tracks.normalize(edit_count_track(s, d)))


_CUT = "SELECT chrom, CASE WHEN flag & 16 > 0 THEN pos + 40 {} ELSE pos {} END p, pos ra, pos + 40 rz FROM pass"


@query(f"WITH {_R}, c AS ({_CUT.format('- 5', '+ 4')}) SELECT chrom, p AS pos, count(*) AS value FROM c WHERE p BETWEEN 0 AND 19999 GROUP BY ALL")
def tn5_cut_track(s, d):
    return tracks.cut_counts(synth.reads(s, d), synth.sizes(s))


@query(f"WITH {_R}, c AS ({_CUT.format('- 1', '+ 0')}) SELECT chrom, p AS pos, count(*) AS value FROM c GROUP BY ALL")
def tn5_cut_raw_ends(s, d):
    return tracks.cut_counts(synth.reads(s, d), synth.sizes(s), plus_shift=0, minus_shift=-1)


@query(f"WITH {_R}, {_MG}, c AS ({_CUT.format('- 5', '+ 4')}) SELECT c.chrom, p AS pos, count(*) AS value FROM c JOIN mg ON c.chrom = mg.chrom AND ra < z AND a < rz AND p >= a AND p < z GROUP BY ALL")
def tn5_cut_regions(s, d):
    return tracks.cut_counts_in(synth.reads(s, d), _merged(s, d))


@query(f"WITH {_R}, {_MG}, c AS ({_CUT.format('- 5', '+ 4')})" + _extended("SELECT chrom, p, count(*) value FROM c GROUP BY ALL"))
def tn5_cut_extended(s, d):
    return tracks.extend(tracks.in_regions(tn5_cut_track(s, d), _merged(s, d)), 3)


# --- fragment table

_FT = _B.replace("FROM pass, generate_series(0, 39)", "FROM u, generate_series(0, 39)").replace("pass AS (SELECT * FROM r WHERE mapq >= 20 AND NOT dup)", "u AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY f) k2, min(mapq) OVER (PARTITION BY f) mm FROM r WHERE NOT dup AND mated) WHERE k2 = 2 AND mm >= 20)")


def _table_sql(barcode: str) -> str:
    return f"""WITH {_FT}, w AS (SELECT f, string_agg(CAST(p AS VARCHAR), '|' ORDER BY p) FILTER (rb = 'C') c2t, string_agg(CAST(p AS VARCHAR), '|' ORDER BY p) FILTER (rb = 'G') g2a FROM e WHERE ed GROUP BY f),
x AS (SELECT chrom, u.f, min(pos) a, max(pos) + 40 z, min({barcode}) bc FROM u GROUP BY ALL)
SELECT chrom, a AS start, z AS "end", coalesce(c2t, '.') c2t, coalesce(g2a, '.') g2a, coalesce(bc, '.') barcode, count(*) n FROM x LEFT JOIN w ON x.f = w.f GROUP BY ALL"""


@query(_table_sql("NULL"))
def fragment_table(s, d):
    return fragments.fragment_table(synth.reads(s, d), synth.chunks(s))


@query(_table_sql("CASE WHEN ok % 7 = 0 THEN NULL ELSE 'BC' || (ok % 5) END"))
def fragment_table_barcode(s, d):
    return fragments.fragment_table(synth.reads(s, d), synth.chunks(s), barcode_tag="CB")


# --- quality control


def _stats(s, d):
    return qc.fragment_stats(synth.reads(s, d), synth.chunks(s))


@query(f"WITH {_R}, x AS (SELECT count(*) n FROM pass GROUP BY chrom, f) SELECT count(*) fragments, count(*) FILTER (n = 2) from_pairs, count(*) FILTER (n = 1) single FROM x")
def fragment_counts(s, d):
    return fragments.fragment_counts(synth.reads(s, d))


@query(f"WITH {_B} SELECT CAST(sum(edits) AS BIGINT) edited, CAST(sum(editable) AS BIGINT) editable, CAST(sum(other) AS BIGINT) other_mismatches, round(CAST(sum(edits) AS DOUBLE) / sum(editable), 9) rate FROM st")
def global_edit_rate(s, d):
    return longs(qc.global_rate(_stats(s, d)))


@query(f"WITH {_B} SELECT CAST(i AS BIGINT) bin, (SELECT count(*) FROM st WHERE least(edits, 100) = i) n FROM generate_series(0, 100) h(i)")
def edits_per_fragment_hist(s, d):
    return qc.edits_histogram(_stats(s, d))


@query(f"WITH {_B} SELECT round(avg(edits), 9) mean, CAST(median(edits) AS DOUBLE) median FROM st")
def edits_per_fragment_summary(s, d):
    return longs(fragments.weighted_summary(_stats(s, d).groupBy("edits").agg(F.count("*").alias("n")), "edits"))


@query(f"WITH {_B} SELECT CAST(i AS BIGINT) bin, (SELECT count(*) FROM st WHERE editable > 0 AND least(edits * 200 // editable, 199) = i) n FROM generate_series(0, 199) h(i)")
def edit_rate_hist(s, d):
    return qc.rate_histogram(_stats(s, d))


@query(f"WITH {_B} SELECT round(avg(CAST(edits AS DOUBLE) / editable), 9) mean, round((median(least(edits * 200 // editable, 199)) + 0.5) / 200, 9) median FROM st WHERE editable > 0")
def edit_rate_summary(s, d):
    return longs(qc.rate_summary(_stats(s, d)))


@query(f"WITH {_B} SELECT ct, ga, count(*) n FROM st GROUP BY ct, ga")
def edit_directions(s, d):
    return qc.directions(_stats(s, d))


@query(f"""WITH {_B}, l AS (SELECT * FROM (VALUES ('0', 0, 0), ('1-10', 1, 10), ('11-25', 11, 25), ('26-50', 26, 50), ('51-100', 51, 100), ('101+', 101, 1000000)) t(stratum, lo, hi))
SELECT stratum, count(editable) fragments, count(editable) FILTER (edits = 0) zero_edit FROM l LEFT JOIN st ON editable BETWEEN lo AND hi GROUP BY stratum""")
def zero_edit_strata(s, d):
    return qc.zero_edit_strata(_stats(s, d))


def _window_sql(half: int) -> str:
    seq = " || ".join(_REF.replace("p*", f"(p{o:+d})*") for o in range(-half, half + 1))
    return f"""WITH {_B}, o AS (SELECT *, {seq} w0 FROM e WHERE rb IN ('C','G') AND base IN ('A','C','G','T') AND p >= {half} AND p + {half} < 20000),
wn AS (SELECT *, CASE WHEN rb = 'G' THEN reverse(translate(w0, 'ACGT', 'TGCA')) ELSE w0 END win FROM o)"""


_CTX = _window_sql(1) + ", cx AS (SELECT win context, count(*) FILTER (ed) edits, count(*) opportunities FROM wn GROUP BY win)"
_MOTIF = _window_sql(5) + """, lt AS (SELECT i - 5 AS o, substr(win, CAST(i + 1 AS INT), 1) base, ed FROM wn, generate_series(0, 10) h(i)),
mc AS (SELECT CAST(h.i - 5 AS BIGINT) AS "offset", bs.base, count(lt.base) FILTER (ed) AS events, count(lt.base) AS background FROM generate_series(0, 10) h(i) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) bs(base) LEFT JOIN lt ON lt.o = h.i - 5 AND lt.base = bs.base GROUP BY ALL)"""


def _sites(s, d):
    return qc.site_counts(synth.reads(s, d), synth.chunks(s))


@query(_CTX + " SELECT context, edits, opportunities, round(CAST(edits AS DOUBLE) / opportunities, 9) fraction FROM cx")
def context_bias(s, d):
    return longs(qc.context_bias(_sites(s, d), synth.chunks(s)))


@query(_CTX + " SELECT context, round(CAST(edits AS DOUBLE) / opportunities, 9) fraction, round(bl, 9) baseline, round(CAST(edits AS DOUBLE) / opportunities / bl, 9) fold FROM cx, (SELECT CAST(sum(edits) AS DOUBLE) / sum(opportunities) bl FROM cx) ORDER BY CAST(edits AS DOUBLE) / opportunities DESC, context LIMIT 1")
def context_top(s, d):
    return longs(qc.context_top(qc.context_bias(_sites(s, d), synth.chunks(s))))


@query(_MOTIF + ' SELECT "offset", base, events, background FROM mc')
def motif_pfm(s, d):
    return qc.motif_counts(_sites(s, d), synth.chunks(s))


@query(_MOTIF + ', fq AS (SELECT "offset", base, CAST(events AS DOUBLE) / nullif(sum(events) OVER (PARTITION BY "offset"), 0) ef, CAST(background AS DOUBLE) / nullif(sum(background) OVER (PARTITION BY "offset"), 0) bf FROM mc) SELECT "offset", base, round(ef, 9) event_freq, round(bf, 9) background_freq, round(ef / nullif(bf, 0), 9) fold FROM fq')
def motif_enrichment(s, d):
    return longs(qc.motif_enrichment(motif_pfm(s, d)))


@query(_MOTIF + ', fq AS (SELECT "offset", base, coalesce(CAST(events AS DOUBLE) / nullif(sum(events) OVER (PARTITION BY "offset"), 0), 0) p FROM mc) SELECT "offset", base, round(p * (2 + sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) OVER (PARTITION BY "offset")), 7) bits FROM fq')
def motif_bits(s, d):
    return longs(qc.motif_bits(motif_pfm(s, d)), 7)


_LEN = f"WITH {_R}, t AS (SELECT gap + 40 l FROM pass WHERE mated AND m = 0)"


@query(_LEN + " SELECT l AS length, count(*) n FROM t GROUP BY l")
def fragment_length_freq(s, d):
    return fragments.fragment_lengths(synth.reads(s, d))


@query(_LEN + " SELECT round(avg(l), 9) mean, CAST(median(l) AS DOUBLE) median FROM t")
def fragment_length_summary(s, d):
    return longs(fragments.weighted_summary(fragment_length_freq(s, d), "length"))


# --- profiles, footprints, motifs, windows

_TSS = f"""WITH {_R}, {_S}, an AS (SELECT s anchor_id, 'chr' || (s % 4 + 1) chrom, (s*1511) % 20000 center, s % 2 = 1 is_minus FROM s), ok AS (SELECT * FROM an WHERE center - 500 >= 0 AND center + 500 <= 20000)"""
_PROF = _TSS + f""", c AS ({_CUT.format('- 1', '+ 0')}), h AS (SELECT CASE WHEN is_minus THEN 99 - (p - center + 500)//10 ELSE (p - center + 500)//10 END bin FROM c JOIN ok ON c.chrom = ok.chrom AND p >= center - 500 AND p < center + 500),
pr AS (SELECT CAST(i AS BIGINT) bin, (SELECT count(*) FROM h WHERE bin = i) n FROM generate_series(0, 99) u(i)), bk AS (SELECT (avg(n) FILTER (bin < 10) + avg(n) FILTER (bin >= 90)) / 2 bg FROM pr)"""


@query(_TSS + " SELECT anchor_id, center, is_minus FROM ok")
def tss_sites(s, d):
    return profile.usable_anchors(synth.anchors(s, d), synth.sizes(s), 500).select("anchor_id", "center", "is_minus")


@query(_PROF + " SELECT bin, CAST((bin - 50) * 10 + 5 AS DOUBLE) AS position, n AS insertions, round(CAST(n AS DOUBLE) / (SELECT count(*) FROM ok), 9) mean, CASE WHEN bg > 0 THEN round(n / bg, 9) END normalized FROM pr, bk")
def tss_profile(s, d):
    return longs(profile.anchor_profile(synth.reads(s, d), synth.anchors(s, d), synth.sizes(s), 500))


@query(_PROF + " SELECT round(max(n / bg), 9) score, 'ok' status, CAST(sum(n) AS BIGINT) insertions FROM pr, bk")
def tss_score(s, d):
    return longs(profile.anchor_score(profile.anchor_profile(synth.reads(s, d), synth.anchors(s, d), synth.sizes(s), 500)))


_FOOT = f"""WITH {_R}, {_S}, si AS (SELECT s site_id, 'chr' || (s % 4 + 1) chrom, (s*733) % 19990 a, 5 + s % 10 l FROM s), c AS ({_CUT.format('- 5', '+ 4')}), t AS (SELECT chrom, p, count(*) v FROM c WHERE p BETWEEN 0 AND 19999 GROUP BY ALL),
w AS (SELECT site_id, l, x, coalesce(v, 0) v FROM (SELECT *, unnest(range(0, 3*l)) x FROM si WHERE a - l >= 0 AND a + 2*l <= 20000) q LEFT JOIN t ON t.chrom = q.chrom AND t.p = a - l + x),
sc AS (SELECT site_id, l, CAST(sum(CASE WHEN x // l = 1 THEN -v ELSE v END) AS BIGINT) total FROM w GROUP BY ALL)"""


def _foot(s, d):
    return footprint.windows(synth.sites(s, d), tn5_cut_track(s, d), synth.sizes(s))


@query(_FOOT + " SELECT site_id, round(CAST(total AS DOUBLE) / l, 9) score FROM sc")
def footprint_score(s, d):
    return longs(footprint.scores(_foot(s, d)).select("site_id", "score"))


@query(_FOOT + """, sh AS (SELECT w.site_id, l, k, v, row_number() OVER (PARTITION BY w.site_id, k ORDER BY md5('0|' || w.site_id || '|' || k || '|' || x), x) - 1 y FROM w, generate_series(0, 49) u(k)),
st AS (SELECT site_id, k, sum(CASE WHEN y // l = 1 THEN -v ELSE v END) t2 FROM sh GROUP BY ALL)
SELECT sc.site_id, round(CAST(total AS DOUBLE) / l, 9) score, CASE WHEN total <= 0 THEN 1.0 ELSE round((SELECT count(*) FROM st WHERE st.site_id = sc.site_id AND t2 >= total) + 1, 0) / 51.0 END::DOUBLE p_value FROM sc""".replace("1.0 ELSE round((SELECT", "1.0::DOUBLE ELSE round(((SELECT").replace("+ 1, 0) / 51.0 END::DOUBLE", "+ 1)::DOUBLE / 51.0::DOUBLE, 9) END"))
def footprint_pvalue(s, d):
    return longs(footprint.p_values(_foot(s, d), 50))


@query()
def footprint_pvalue_seeded(s, d):
    return footprint.exact_p_values(_foot(s, d), 1000)


_TILES = f"WITH {_S}, tl AS (SELECT DISTINCT chrom, a + 32*i AS a FROM rg, generate_series(0, 20) u(i) WHERE a + 32*i + 64 <= z)"


def _tiles(s, d):
    return windows.tiles(synth.regions(s, d), 64, 32).distinct()


@query(_TILES + ' SELECT chrom, a AS start, a + 64 AS "end" FROM tl')
def window_tiles(s, d):
    return _tiles(s, d)


@query(_TILES.replace("WITH ", f"WITH {_R}, ") + f""", c AS ({_CUT.format('- 5', '+ 4')}), t AS (SELECT chrom, p, count(*) v FROM c GROUP BY ALL)
SELECT q.chrom, a AS start, string_agg(CAST(coalesce(v, 0) AS VARCHAR), ',' ORDER BY x) AS y FROM (SELECT *, unnest(range(0, 64)) x FROM tl) q LEFT JOIN t ON t.chrom = q.chrom AND t.p = a + x GROUP BY q.chrom, a""")
def window_targets(s, d):
    return windows.targets(_tiles(s, d), tn5_cut_track(s, d)).select("chrom", "start", F.array_join(F.transform("y", lambda v: v.cast("string")), ",").alias("y"))


@query(f"WITH {_B} SELECT chrom, CAST(p // 1000 AS BIGINT) chunk, CAST(count(*) FILTER (ref = 'A') AS BIGINT) a, count(*) FILTER (ref = 'C') c, count(*) FILTER (ref = 'G') g, count(*) FILTER (ref = 'T') t FROM g GROUP BY ALL")
def one_hot_rows(s, d):
    rows = synth.chunks(s, more=0).select("chrom", "chunk", F.explode(fx.one_hot(F.col("seq"))).alias("x"))
    return longs(rows.groupBy("chrom", "chunk").agg(*[F.sum(F.get("x", F.lit(i))).alias(n) for i, n in enumerate("acgt")]))


@query("SELECT CAST(n AS BIGINT) AS n, CAST(n - 4 AS BIGINT) AS unpadded, CAST(n AS BIGINT) AS padded FROM generate_series(5, 64) g(n)")
def conv_lengths(s, d):
    return s.range(5, 65).select(F.col("id").alias("n"), fx.conv_length(F.col("id"), 5).alias("unpadded"), fx.conv_length(F.col("id"), 5, padding=2).alias("padded"))


@query("SELECT CAST(2114 AS BIGINT) AS input_length, CAST(1000 AS BIGINT) AS output_length")
def bpnet_lengths(s, d):
    a, b = windows.profile_lengths(1000)
    return s.createDataFrame([(a, b)], "input_length long, output_length long")


_MOTIF_COUNTS = {"m1": [[90, 4, 3, 3], [3, 90, 4, 3], [5, 5, 5, 85], [4, 3, 90, 3], [90, 4, 3, 3], [25, 25, 25, 25]]}


def _pwm_values() -> str:
    rows = []
    for name, counts in _MOTIF_COUNTS.items():
        import math

        m = motif.log_odds(counts)
        cut = int(round(motif.threshold(m, 5e-3) * 1000))
        rows += [f"('{name}', {i}, '{b}', {math.floor(x * 1000)}, {cut})" for i, row in enumerate(m) for b, x in zip("ACGT", row)]
    return ", ".join(rows)


@query(f"""WITH {_B}, pw AS (SELECT * FROM (VALUES {_pwm_values()}) t(motif, i, base, sc, cutoff)),
o AS (SELECT g.chrom, g.p - pw.i AS a, motif, '+' strand, sc, cutoff FROM g JOIN pw ON g.ref = pw.base UNION ALL SELECT g.chrom, g.p - (5 - pw.i), motif, '-', sc, cutoff FROM g JOIN pw ON translate(g.ref, 'ACGT', 'TGCA') = pw.base)
SELECT chrom, a AS start, a + 6 AS "end", motif, CAST(sum(sc) AS BIGINT) score, strand FROM o WHERE a >= 0 AND a + 6 <= 20000 GROUP BY chrom, a, motif, strand, cutoff HAVING sum(sc) >= cutoff""")
def motif_scan(s, d):
    # Windows that begin in a chunk's own 1000 bases; its overlap only completes them.
    own = synth.chunks(s, more=8)
    hits = motif.scan(own.select("chrom", "start", "seq"), motif.pwm_table(s, _MOTIF_COUNTS, 5e-3))
    return hits.distinct()


# --- candidates

_FLG = "(flag | CASE WHEN (ok*3 + ln + c) % 29 = 0 THEN 4 ELSE 0 END | CASE WHEN (ok*5 + ln + c) % 19 = 0 THEN 256 ELSE 0 END)"
_CAND = f"""WITH {_R}, cr AS (SELECT qname, CASE c WHEN 0 THEN 'f' ELSE 'r' END candidate, file_ord*2 + c fo, {_FLG} fl, CASE WHEN (ok // 4 + c) % 2 = 0 THEN 'f' ELSE 'r' END || chrom contig, pos + CASE WHEN ok % 3 = 0 THEN c*7 ELSE 0 END ps, mapq, (ok*ln*13 + c*((ok % 5)*3)) % 41 sc FROM r, generate_series(0, 1) u(c)),
cs AS (SELECT qname, candidate, CAST(coalesce(sum(CASE WHEN fl & 4 > 0 THEN -1 ELSE sc END) FILTER (fl & 2304 = 0), 0) AS BIGINT) score, min(fo) first_ord, coalesce(string_agg((fl & 192) || ':' || substr(contig, 2) || ':' || ps || ':' || (fl & 16), ';' ORDER BY fl & 192, ps) FILTER (fl & 2308 = 0), '') pl FROM cr GROUP BY ALL),
bs AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY qname ORDER BY score DESC, first_ord) = 1),
cap AS (SELECT bs.qname, bs.candidate, CASE WHEN max(cs.score) IS NOT NULL THEN greatest(bs.score - max(cs.score), 0) END lead FROM bs LEFT JOIN cs ON cs.qname = bs.qname AND cs.candidate <> bs.candidate AND cs.pl <> '' AND cs.pl <> bs.pl GROUP BY bs.qname, bs.candidate, bs.score)"""


def _scores(s, d):
    return candidates.candidate_scores(synth.candidate_records(s, d))


@query(_CAND + " SELECT qname, candidate, score, first_ord FROM cs")
def candidate_score(s, d):
    return _scores(s, d).select("qname", "candidate", "score", "first_ord")


@query(_CAND + " SELECT qname, candidate, score FROM bs")
def candidate_best(s, d):
    return candidates.best_candidates(_scores(s, d)).select("qname", "candidate", "score")


@query(_CAND + " SELECT fo AS file_ord, qname, candidate, CAST(CASE WHEN lead IS NULL THEN mapq ELSE least(mapq, lead) END AS BIGINT) mapq FROM cr JOIN cap USING (qname, candidate)")
def candidate_mapq_cap(s, d):
    r = synth.candidate_records(s, d)
    return longs(candidates.capped_mapq(r, candidates.best_candidates(candidates.candidate_scores(r))).select("file_ord", "qname", "candidate", "mapq"))


def _fastq(s, d):
    return synth.reads(s, d).selectExpr("file_ord as idx", "if((flag & 64) > 0, 1, 2) as mate", "concat(qname, if((flag & 64) > 0, '/1', '/2')) as name", "seq", "cast(null as string) as qual")


_FQ = _B.replace("FROM pass, generate_series", "FROM r, generate_series").replace("WHERE q >= 20)", ")") + ", fq AS (SELECT file_ord, ln, 'f' || f qname, string_agg(base, '' ORDER BY i) seq FROM b GROUP BY file_ord, ln, f)"


@query(f"WITH {_FQ} SELECT file_ord AS idx, qname AS name, c AS candidate, CASE WHEN (ln % 2 = 1) = (c = 'f') THEN replace(seq, 'C', 'T') ELSE replace(seq, 'G', 'A') END converted, seq AS original FROM fq, (VALUES ('f'), ('r')) u(c)")
def dual_conversion(s, d):
    return candidates.dual_conversion(_fastq(s, d)).select("idx", "name", "candidate", "converted", "original")


@query(f"WITH {_FQ} SELECT file_ord, CASE WHEN ln % 2 = 0 THEN substr(reverse(translate(seq, 'ACGT', 'TGCA')), 3, 37) ELSE substr(seq, 3, 37) END seq FROM fq")
def restore_sequence(s, d):
    r = synth.reads(s, d).select("file_ord", "flag", F.concat(F.lit("f"), "chrom").alias("chrom"), F.lit("2H37M1H").alias("cigar"), F.col("seq").alias("original"))
    return candidates.restored(r).select("file_ord", "seq")


def _reference_tags(s, d):
    return candidates.reference_tags(synth.reads(s, d, varied=True), synth.chunks(s), ["file_ord"])


_AR = f"""WITH {_FQ}, vv AS (SELECT v.file_ord, v.ch, v.pos, v.cg, fq.seq FROM v JOIN fq ON v.file_ord = fq.file_ord),
al AS (SELECT file_ord, cg, ch, pos, i, pos + i p, substr(seq, CAST(1 + CASE cg WHEN 2 THEN i + 5 WHEN 3 THEN CASE WHEN i < 20 THEN i ELSE i - 2 END WHEN 4 THEN CASE WHEN i < 18 THEN i ELSE i + 2 END ELSE i END AS INT), 1) base FROM vv, generate_series(0, 41) h(i) WHERE CASE cg WHEN 2 THEN i < 35 WHEN 3 THEN i < 20 OR i BETWEEN 22 AND 41 WHEN 4 THEN i < 38 ELSE i < 40 END),
ar AS (SELECT *, {_REF} rb FROM al)"""


@query(_AR + " SELECT file_ord, CAST(count(*) FILTER (base <> rb) + CASE WHEN any_value(cg) IN (3, 4) THEN 2 ELSE 0 END AS BIGINT) nm, count(*) FILTER (rb = 'C' AND base = 'T') zc, count(*) FILTER (rb = 'G' AND base = 'A') zg FROM ar GROUP BY file_ord")
def conversion_counts(s, d):
    return _reference_tags(s, d).select("file_ord", "nm", "zc", "zg")


# What md lists: mismatches, and the two deleted bases where 20 are aligned; x is what stands aligned up to and with it.
@query(_AR + f""", dl AS (SELECT DISTINCT file_ord, ch, pos + k p, k FROM al, generate_series(20, 21) u(k) WHERE cg = 3),
ev AS (SELECT file_ord, CASE WHEN cg = 3 AND i > 20 THEN i - 2 ELSE i END j, 1 x, rb s FROM ar WHERE base <> rb UNION ALL SELECT file_ord, 20, 0, '^' || string_agg({_REF}, '' ORDER BY k) FROM dl GROUP BY file_ord),
ru AS (SELECT *, j - coalesce(lag(j + x) OVER (PARTITION BY file_ord ORDER BY j, x), 0) run FROM ev),
to_ AS (SELECT file_ord, count(*) n FROM ar GROUP BY file_ord),
sm AS (SELECT file_ord, string_agg(CAST(run AS BIGINT) || s, '' ORDER BY j, x) md, max(j + x) upto FROM ru GROUP BY file_ord)
SELECT to_.file_ord, coalesce(md, '') || CAST(n - coalesce(upto, 0) AS BIGINT) AS md FROM to_ LEFT JOIN sm USING (file_ord)""")
def md_strings(s, d):
    return _reference_tags(s, d).select("file_ord", "md")


@query(f"""WITH {_B}, sq AS (SELECT chrom, string_agg(ref, '' ORDER BY p) seq FROM g GROUP BY chrom) SELECT 'f' || chrom AS chrom, replace(seq, 'C', 'T') AS seq FROM sq UNION ALL SELECT 'r' || chrom, replace(seq, 'G', 'A') FROM sq""")
def converted_reference(s, d):
    whole = synth.chunks(s, more=0).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("chunk", "seq"))).alias("a")).select("chrom", F.array_join(F.transform("a", lambda x: x["seq"]), "").alias("seq"))
    return candidates.converted_reference(whole)


@query(f"WITH {_R} SELECT 'a' AS sample, count(*) AS reads, CAST(NULL AS BIGINT) AS passing FROM r UNION ALL SELECT 'b', NULL, count(*) FROM pass")
def qc_summary_union(s, d):
    r = synth.reads(s, d)
    return summary.union_reports([r.agg(F.lit("a").alias("sample"), F.count("*").alias("reads")), reads.passing(r).agg(F.lit("b").alias("sample"), F.count("*").alias("passing"))])
