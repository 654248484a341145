"""Dual-conversion candidates: the reads' two conversions, the better alignment and its restored record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES, cigar_blocks, convert_c_to_t, convert_g_to_a, hard_clip, has, reverse_complement

#: Tags of the aligner that hold no longer once the sequence is back, and the candidates' own marks.
STALE = ("YS", "YC", "NM", "MD", "ZC", "ZG", "SA", "XA")
WIDTH = 1000


def dual_conversion(fastq: DataFrame) -> DataFrame:
    """fastq (idx, mate, name, seq, qual) as both candidates: f converts C to T in the first mate and G to A in the second, r the other way."""
    ct = lambda f: F.when((F.col("mate") == 1) == F.lit(f), convert_c_to_t(F.col("seq"))).otherwise(convert_g_to_a(F.col("seq")))
    one = lambda f: fastq.select("idx", "mate", F.regexp_replace("name", "/[12]$", "").alias("name"), F.lit("f" if f else "r").alias("candidate"), ct(f).alias("converted"), F.col("seq").alias("original"), F.coalesce("qual", F.expr("repeat('I', length(seq))")).alias("qual"))
    return one(True).unionByName(one(False))


def zip_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by position; a missing partner or differing names raise."""
    name = lambda c: F.regexp_replace(c, "/[12]$", "")
    j = first.select("idx", F.col("name").alias("name1"), F.col("seq").alias("seq1")).join(second.select("idx", F.col("name").alias("name2"), F.col("seq").alias("seq2")), "idx", "full")
    bad = F.col("name1").isNull() | F.col("name2").isNull() | (name(F.col("name1")) != name(F.col("name2")))
    return j.select("idx", F.when(bad, F.raise_error(F.lit("mate files differ"))).otherwise(name(F.col("name1"))).alias("name"), "seq1", "seq2")


def original_contig(chrom: Column) -> Column:
    """The contig of a converted one: less the prefix f or r."""
    return F.regexp_replace(chrom, "^[fr]", "")


def candidate_scores(records: DataFrame) -> DataFrame:
    """records (file_ord, qname, candidate, flag, chrom, pos, cigar, score) by qname and candidate: score, first_ord and placement.

    Score: summed over primary records, -1 for an unmapped one, 0 for a null. Placement: the
    mapped primary records' places on original contigs, by mate; empty where none is mapped.
    """
    flag = F.col("flag")
    primary = flag.bitwiseAND(0x900) == 0
    place = F.struct(flag.bitwiseAND(0xC0).alias("mate"), original_contig(F.col("chrom")).alias("chrom"), "pos", flag.bitwiseAND(16).alias("strand"), "cigar")
    worth = F.when(has(flag, 4), -1).otherwise(F.coalesce("score", F.lit(0)))
    return records.groupBy("qname", "candidate").agg(F.coalesce(F.sum(F.when(primary, worth)), F.lit(0)).cast("bigint").alias("score"), F.min("file_ord").alias("first_ord"), F.sort_array(F.collect_list(F.when(primary & ~has(flag, 4), place))).alias("placement"))


def best_candidates(scores: DataFrame) -> DataFrame:
    """Per read the candidate of the highest score, the first seen on ties; ``cap``: its lead over the best rival, null without one.

    Rivals are the other candidates that are placed, and elsewhere. A read has a handful of
    candidates, so they meet in one row.
    """
    order = F.struct((-F.col("score")).alias("s"), "first_ord", "candidate", "placement")
    c = scores.groupBy("qname").agg(F.array_sort(F.collect_list(order)).alias("all")).withColumn("top", F.get("all", F.lit(0)))
    rivals = F.filter("all", lambda x: (x["candidate"] != F.col("top.candidate")) & (F.size(x["placement"]) > 0) & (x["placement"] != F.col("top.placement")))
    rival = -F.get(rivals, F.lit(0))["s"]
    score = -F.col("top.s")
    return c.select("qname", F.col("top.candidate").alias("candidate"), score.alias("score"), F.col("top.first_ord").alias("first_ord"), F.greatest(score - rival, F.when(rival.isNotNull(), F.lit(0))).alias("cap"))


def capped_mapq(records: DataFrame, best: DataFrame) -> DataFrame:
    """The best candidates' records, each one's mapq at most the read's cap; never raised. Where records have tags, so do the hits listed in SA."""
    r = records.join(best.select("qname", "candidate", "cap"), ["qname", "candidate"])
    low = lambda q: F.when(F.col("cap").isNull(), q).otherwise(F.least(q, F.col("cap")))
    out = r.withColumn("mapq", low(F.col("mapq")).cast(records.schema["mapq"].dataType))
    if "tags" in records.columns:
        fields = lambda h: F.split(h, ",")
        hit = lambda h: F.concat_ws(",", F.transform(fields(h), lambda x, i: F.when(i == 4, low(x.cast("bigint")).cast("string")).otherwise(x)))
        sa = F.concat(F.array_join(F.transform(_hits("SA"), hit), ";"), F.lit(";"))
        held = F.map_filter("tags", lambda k, _: k != "SA")
        out = out.withColumn("tags", F.when(F.col("tags")["SA"].isNotNull() & F.col("cap").isNotNull(), F.map_concat(held, F.create_map(F.lit("SA"), sa))).otherwise(F.col("tags")))
    return out.select(*records.columns)


def restored(records: DataFrame) -> DataFrame:
    """Records (flag, chrom, cigar, original, ...) with their contig's candidate prefix off and the original sequence back: reverse complement on the reverse strand, hard clips cut."""
    return records.withColumn("seq", _oriented(F.col("original"), has(F.col("flag"), 16), F.col("cigar"))).withColumn("chrom", original_contig(F.col("chrom"))).drop("original")


def _oriented(original: Column, reverse: Column, cigar: Column) -> Column:
    s = F.when(reverse, reverse_complement(original)).otherwise(original)
    a, b = hard_clip(cigar), hard_clip(cigar, end=True)
    return F.substr(s, (a + 1).cast("int"), (F.length(s) - a - b).cast("int"))


def _hits(tag: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col("tags")[tag], F.lit("")), ";"), lambda h: h != "")


def reference_tags(spans: DataFrame, chunks: DataFrame, by: list[str], width: int = WIDTH) -> DataFrame:
    """by, nm, md, zc and zg of spans (*by, chrom, pos, cigar, seq): edit distance, mismatch string, C to T and G to A against the reference.

    chunks: (chrom, chunk, start, seq), pieces of ``width`` bases. Only the stretches that an
    alignment matches or deletes are looked up, so skipped reference costs nothing. An alignment
    that leaves its contig raises; so does a contig that the reference lacks.
    """
    s = spans.withColumn("b", cigar_blocks(F.col("cigar")))
    used = F.filter("b", lambda x: F.contains(F.lit("MD=X"), x["op"]) & (x["n"] > 0))
    at = s.select(*by, "chrom", F.explode(F.transform(used, lambda x: F.struct((F.col("pos") + x["r"]).alias("lo"), (F.col("pos") + x["r"] + x["n"]).alias("hi"), x["r"].alias("r")))).alias("x")).select(*by, "chrom", "x.*")
    at = at.withColumn("chunk", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    lo, hi = F.greatest("lo", F.col("chunk") * width), F.least("hi", (F.col("chunk") + 1) * width)
    piece = F.upper(F.substr("_s", (lo - F.col("_a") + 1).cast("int"), (hi - lo).cast("int")))
    got = at.join(chunks.select("chrom", "chunk", F.col("start").alias("_a"), F.col("seq").alias("_s")), ["chrom", "chunk"], "left").select(*by, "r", "chunk", F.coalesce(piece, F.lit("")).alias("s"))
    refs = got.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("r", "chunk", "s"))).alias("refs"))
    j = s.join(refs, by, "left").withColumn("seq", F.upper("seq"))

    def stretch(x):
        text = F.array_join(F.transform(F.filter("refs", lambda p: p["r"] == x["r"]), lambda p: p["s"]), "")
        return F.when(F.length(text) == x["n"], text).otherwise(F.raise_error(F.concat(F.lit("alignment beyond the reference: "), "chrom", F.lit(":"), F.col("pos").cast("string"))).cast("string"))

    none = F.array().cast("array<struct<j:bigint,kind:int,ref:string,base:string>>")
    full = F.transform(used, lambda x: F.struct(x["op"].alias("op"), x["n"].alias("n"), x["j"].alias("j"), F.when(x["op"] == "D", F.lit("")).otherwise(F.substr("seq", (x["q"] + 1).cast("int"), x["n"].cast("int"))).alias("own"), stretch(x).alias("ref")))
    letter = lambda c, i: F.substr(c, (i + 1).cast("int"), F.lit(1))

    def events(x):
        each = F.transform(F.sequence(F.lit(0).cast("bigint"), x["n"] - 1), lambda i: F.struct((x["j"] + i).alias("j"), F.lit(1).alias("kind"), letter(x["ref"], i).alias("ref"), letter(x["own"], i).alias("base")))
        differ = F.filter(each, lambda e: (e["ref"] != e["base"]) | ~e["base"].isin(*BASES))
        gone = F.array(F.struct(x["j"].alias("j"), F.lit(0).alias("kind"), F.concat(F.lit("^"), x["ref"]).alias("ref"), F.lit(None).cast("string").alias("base")))
        return F.when(x["op"] == "D", gone).when((x["own"] == x["ref"]) & x["own"].rlike("^[ACGT]*$"), none).otherwise(differ)

    j = j.withColumn("full", full).withColumn("events", F.flatten(F.transform("full", events)))
    # A run between events is what is aligned from the one before on; a deletion takes no aligned base.
    step = lambda a, e: F.struct((e["j"] + e["kind"]).cast("bigint").alias("upto"), F.concat(a["md"], (e["j"] - a["upto"]).cast("string"), e["ref"]).alias("md"))
    said = F.aggregate("events", F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit("").alias("md")), step)
    total = lambda kinds: F.aggregate(F.filter("b", lambda x: F.contains(F.lit(kinds), x["op"])), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    count = lambda f: F.size(F.filter("events", f)).cast("bigint")
    nm = count(lambda e: e["kind"] == 1) + total("ID")
    md = F.concat(said["md"], (total("M=X") - said["upto"]).cast("string"))
    change = lambda a, b: count(lambda e: (e["ref"] == a) & (e["base"] == b))
    return j.select(*by, nm.alias("nm"), md.alias("md"), change("C", "T").alias("zc"), change("G", "A").alias("zg"))


def restored_records(records: DataFrame, chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """The aligner's records (operators.reads.READS) as records on the original reference.

    Contigs lose their prefix. Where the tag YS has the original sequence, SEQ is it again, NM,
    MD, ZC and ZG are counted anew for mapped records with a sequence, and the hits in SA and XA
    get original contigs and edit distances; without it those lists go. YS, YC and the aligner's
    NM, MD, ZC and ZG always go. A record without a sequence stays without; an original of
    another length than the sequence raises.
    """
    ys = F.col("tags")["YS"]
    seq = _oriented(ys, has(F.col("flag"), 16), F.col("cigar"))
    whole = F.when(ys.isNull() | F.col("seq").isNull(), F.col("seq")).when(F.length(seq) == F.length("seq"), seq).otherwise(F.raise_error(F.concat(F.lit("no sequence of this length: "), "qname")).cast("string"))
    r = records.withColumns({"seq": whole, "chrom": original_contig(F.col("chrom")), "next_chrom": original_contig(F.col("next_chrom"))})

    f = lambda h, i: F.get(F.split(h, ","), F.lit(i))
    place = lambda h, pos, strand, cigar: F.struct(original_contig(f(h, 0)).alias("chrom"), (F.abs(pos.cast("bigint")) - 1).alias("pos"), cigar.alias("cigar"), _oriented(ys, strand == "-", cigar).alias("seq"), h.alias("hit"))
    split = F.transform(_hits("SA"), lambda h: place(h, f(h, 1), f(h, 2), f(h, 3)))
    other = F.transform(_hits("XA"), lambda h: place(h, f(h, 1), F.substring(f(h, 1), 1, 1), f(h, 2)))
    own = F.when(~has(F.col("flag"), 4) & F.col("seq").isNotNull(), F.array(F.struct("chrom", "pos", "cigar", "seq", F.lit("").alias("hit")))).otherwise(F.array().cast("array<struct<chrom:string,pos:bigint,cigar:string,seq:string,hit:string>>"))
    named = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), x.alias("x"))
    kinds = F.concat(*[F.transform(a, named(k)) for k, a in (("own", own), ("SA", split), ("XA", other))])
    spans = r.where(ys.isNotNull()).select("file_ord", F.explode(kinds).alias("k")).select("file_ord", "k.kind", "k.nth", "k.x.*")
    tags = spans.select("file_ord", "kind", "nth", "chrom", "hit").join(reference_tags(spans, chunks, ["file_ord", "kind", "nth"], width), ["file_ord", "kind", "nth"])
    parts = F.split("hit", ",")
    hit = F.concat_ws(",", F.transform(parts, lambda x, i: F.when(i == 0, F.col("chrom")).when(i == F.size(parts) - 1, F.col("nm").cast("string")).otherwise(x)))
    tags = tags.withColumn("said", hit)
    of = lambda c: F.max(F.when(F.col("kind") == "own", F.col(c)))
    listed = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("nth", F.col("said").alias("s"))))), lambda x: F.concat(x["s"], F.lit(";"))), "")
    made = tags.groupBy("file_ord").agg(*[of(c).alias(c) for c in ("nm", "md", "zc", "zg")], listed("SA").alias("sa"), listed("XA").alias("xa"))
    j = r.join(made, "file_ord", "left")
    entry = lambda k, c: F.when(F.length(F.col(c).cast("string")) > 0, F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")))
    new = F.filter(F.array(*[entry(k.upper(), k) for k in ("sa", "xa", "nm", "md", "zc", "zg")]), lambda e: e.isNotNull())
    kept = F.coalesce(F.map_filter("tags", lambda k, _: ~k.isin(*STALE)), F.create_map().cast("map<string,string>"))
    return j.withColumn("tags", F.map_concat(kept, F.map_from_entries(new))).select(*records.columns)


def chosen_records(records: DataFrame, chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """From all candidates' records (operators.reads.READS, tags YC and AS) the better ones, capped and restored. Names are to be of one read each."""
    r = records.withColumn("candidate", F.coalesce(F.col("tags")["YC"], F.lit(""))).withColumn("score", F.col("tags")["AS"].cast("bigint"))
    best = best_candidates(candidate_scores(r))
    return restored_records(capped_mapq(r, best).select(*records.columns), chunks, width)


def converted_reference(reference: DataFrame) -> DataFrame:
    """chrom, seq as contigs f (C to T) and r (G to A)."""
    return reference.select(F.concat(F.lit("f"), "chrom").alias("chrom"), convert_c_to_t(F.col("seq")).alias("seq")).unionAll(reference.select(F.concat(F.lit("r"), "chrom").alias("chrom"), convert_g_to_a(F.col("seq")).alias("seq")))
