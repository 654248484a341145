"""Site-relative line deduplication, in DataFrame functions only.

For each host: pages that contain a line, over all pages of the host. Lines above the ratio are
boilerplate and go. A host can have no more than (its lines / its pages) / ratio such lines, so
these, and no others, travel to its pages as one array, and no page is taken apart and put
together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dot; null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    return F.nullif(F.regexp_replace(h, r"\.$", ""), F.lit(""))


def html_text(html: Column) -> Column:
    """Text lines of HTML: scripts, styles and comments go, block tags end a line, entities are read."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|aside|main|form|pre)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def drop_site_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = 0.2, min_pages: int = 3) -> DataFrame:
    """pages with ``text`` less its boilerplate lines, and n_lines and n_dropped (long).

    A line (trimmed of ASCII white space, not empty) is boilerplate if at least ``min_pages``
    pages of its host contain it and they are more than ``ratio`` of the host's pages. Other
    lines stay as they are, blank ones included. Null host: a host of its own. Null text: stays
    null, no lines, but the page counts for its host. Repeated rows are pages of their own. Other
    columns are kept; the two new ones replace any of their names.
    """
    key = F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit(""))
    bare = F.filter(F.transform(F.split(F.col(text), "\n"), _bare), lambda x: x != "")
    lines = pages.select(key.alias("_h"), F.explode(F.array_distinct(F.transform(bare, lambda x: F.xxhash64(x)))).alias("line"))
    counts = lines.groupBy("_h", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    hosts = pages.select(key.alias("_h")).groupBy("_h").agg(F.count("*").alias("pages"))
    # Only lines above the ratio come together: a host's lines a page over the ratio at most.
    boiler = counts.join(hosts, "_h").where(F.col("n") > F.col("pages") * ratio).groupBy("_h").agg(F.collect_list("line").alias("_b"))
    # Staged, its size is known: where it is small Spark broadcasts it and the texts stay where they are, else it joins by shuffle.
    # The given columns travel as one, so that none can clash with those made here.
    rows = pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias("row"), key.alias("_h"), F.col(text).alias("_t"))
    out = rows.join(stage(boiler, "boilerplate"), "_h", "left")
    lines = F.split("_t", "\n")
    stays = F.filter(lines, lambda x: ~F.array_contains("_b", F.xxhash64(_bare(x))) | (_bare(x) == ""))
    n = lambda c: F.coalesce(F.size(F.filter(c, lambda x: _bare(x) != "")), F.lit(0)).cast("long")
    hit = F.col("_b").isNotNull() & F.col("_t").isNotNull()
    out = out.withColumn("_s", F.when(hit, F.array_join(stays, "\n")).otherwise(F.col("_t")))
    out = out.withColumn("_n", F.when(F.col("_t").isNotNull(), n(lines)).otherwise(0).cast("long"))
    out = out.withColumn("_d", F.when(hit, F.col("_n") - n(F.split("_s", "\n"))).otherwise(0).cast("long"))
    rest = [F.col("_s").alias(c) if c == text else F.col("row")[c].alias(c) for c in pages.columns if c not in {"n_lines", "n_dropped"}]
    return out.select(*rest, F.col("_n").alias("n_lines"), F.col("_d").alias("n_dropped"))
