"""The ten registered queries, each on its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, langid, line_dedup, mixing, neighbours, ngram_join, packing, pii, quality, suffix_tree
from .common import crc_mod, read, stage, words_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a tree of those whose crc32 of the id is not 2 modulo 7; see suffix_tree.suffix_tree_scores for nulls and repeated rows."""
    docs = read(spark, sf_dir, "documents")
    return suffix_tree.suffix_tree_scores(docs, crc_mod("doc_id", 7) != 2)


def op2_ngram_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at 4-word shingles and a similarity of 0.85; see ngram_join.ngram_jaccard_components."""
    docs = read(spark, sf_dir, "documents")
    return ngram_join.ngram_jaccard_components(docs, k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all embeddings for each vec_id divisible by 50; see neighbours.nearest_neighbours."""
    return neighbours.nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents; see quality.quality_rules."""
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at the contract's weights; a null text has no words; see mixing.fair_targets and mixing.mix_sources."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("size"), "source")
    return mixed(stage(docs, "sizes")).select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs (size, source, ...) with source_size, target and repeats, at the contract's weights."""
    # Sources are held by a marked name, since null is a source too.
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(mixing.fair_targets(sizes), "targets")
    quotas = {"" if r["source"] is None else "=" + r["source"]: int(r["target"]) for r in targets.collect()}
    used = mixing.mix_sources(docs.withColumn("sources", F.array(name)), quotas)
    return used.drop("sources").join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 as chains of replies; see conversation_digests."""
    both = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digests(rows)


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as chains of replies, formatted and read back.

    Turns go by number, nulls first, then by role and text; repeated rows are turns each. Null
    conv_ids are one conversation; null role or text is empty; no rows give none.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    nodes = rows.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    nodes = stage(nodes.select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")), "messages")
    made = chat.format_reply_trees(nodes).select("tree", "formatted", chat.read_back(F.col("formatted")).alias("t"))
    mask = made.select("tree", "formatted", "t", chat.loss_mask(F.col("t")).alias("mask"))
    loss = F.array_join(F.transform("mask", lambda s: chat.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    turns = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = mask.withColumn("loss", loss)
    return out.select(F.col("tree").alias("conv_id"), F.size("t").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' languages, learned from those whose crc32 of the id is not 0 modulo 5; see langid.fit and langid.predict."""
    docs = read(spark, sf_dir, "documents")
    return identified(docs, crc_mod("doc_id", 5) == 0)


def identified(docs: DataFrame, held_out) -> DataFrame:
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), model, keep=("doc_id", "held_out"))


def op8_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 1024 ids; see packing.pack_documents."""
    docs = read(spark, sf_dir, "documents")
    return packing.pack_documents(docs, VOCABULARY, carry=(F.crc32("ids").alias("ids_crc32"),))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' spans as counts, digest and text; see pii.find_personal_data."""
    found = pii.find_personal_data(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    n = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[n(k) for k in pii.BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op10_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' texts without lines that more than a fifth of their host's pages have; null urls are one host, null pages have no lines; see line_dedup.drop_site_boilerplate."""
    pages = read(spark, sf_dir, "pages").select("page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.html_text(F.col("html")).alias("text"))
    return line_dedup.drop_site_boilerplate(pages, "host", "text")


QUERIES = {f.__name__: f for f in (op1_suffix_tree_scores, op2_ngram_jaccard_components, op3_nearest_neighbours, op4_quality_rules, op5_source_mix, op6_reply_trees, op7_language_id, op8_minimum_bin_slack, op9_personal_data, op10_site_lines)}

_OP5 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM s),
-- Each k: the k sources of least cap/weight stop at their caps.
r AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k FROM w),
lv AS (SELECT a.k, CAST((SELECT sum(source_size) FROM r) - coalesce((SELECT sum(3 * b.source_size) FROM r b WHERE b.k < a.k), 0) AS BIGINT) AS rest, CAST((SELECT sum(b.w) FROM r b WHERE b.k >= a.k) AS BIGINT) AS rw, 3 * a.source_size AS top, a.w FROM r a),
pick AS (SELECT * FROM lv WHERE top * rw > rest * w ORDER BY k LIMIT 1),
t AS (SELECT r.source, r.source_size, CASE WHEN p.k IS NULL OR r.k < p.k THEN CAST(3 * r.source_size AS DOUBLE) ELSE CAST(r.w * p.rest AS DOUBLE) / p.rw END AS target FROM r LEFT JOIN pick p ON true),
m AS (SELECT d.*, t.source_size, t.target, CAST(CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS BIGINT) AS rounds, CAST(CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) % t.source_size ELSE 0 END AS BIGINT) AS more,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source, source_size, target, CAST(size * (rounds + CASE WHEN 2 * upto - size <= 2 * more THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""

_OP6 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text))),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) AS n, length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS rn FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  -- '<turn ' role '>' newline text '</turn>' newline: 16 characters a turn, and one more for each escaped one.
  CAST(sum(16 + n + rn) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP10 = r"""
WITH h AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', ''), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'),
    '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|aside|main|form|pre)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x, row_number() OVER () AS rid FROM pages),
p AS (SELECT rid, page_id, host, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text FROM h),
l AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
b AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
bad AS (SELECT b.host, b.bare FROM b JOIN n ON b.host IS NOT DISTINCT FROM n.host WHERE bare <> '' GROUP BY b.host, b.bare, n.pages HAVING count(DISTINCT rid) >= 3 AND count(DISTINCT rid) > n.pages * 0.2),
k AS (SELECT b.*, bad.bare IS NOT NULL AS gone FROM b LEFT JOIN bad ON b.host IS NOT DISTINCT FROM bad.host AND b.bare = bad.bare),
g AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped FROM k GROUP BY rid)
SELECT p.page_id, p.host, g.text, CAST(coalesce(g.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n_dropped, 0) AS BIGINT) AS n_dropped FROM p LEFT JOIN g ON p.rid = g.rid
"""

ORACLE_SQL = {"op5_source_mix": _OP5, "op6_reply_trees": _OP6, "op10_site_lines": _OP10}
