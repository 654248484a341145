"""A corpus pipeline of five stages over documents, each reading what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editscan.llm import langid, line_dedup, ngram_join, packing
from editscan.llm.common import shared_dir, words_of
from editscan.llm.queries import VOCABULARY, mixed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: The least share of a text's evidence that its language must hold.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the language they are predicted in, which is their lang from here on.

    Those go in which no language is found (no text, no letter) or none has half of the evidence.
    Labels that are null teach nothing; without any label no language is known and all rows go.
    Null ids and repeated rows stay as they are; ties between languages go to the first by code
    point; other columns than those of documents are dropped.
    """
    found = langid.predict(docs.select(*COLUMNS), langid.fit(docs), keep=tuple(COLUMNS))
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


#: The share of a source's documents above which a line is boilerplate: of the given tables' lines the shared one is in 8.6 % or more of every source's documents, and no other in over 4.8 %.
BOILERPLATE = 0.07


def line_dedup_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that more than BOILERPLATE of a source's documents have, the source being the site.

    n_chars follows a text that lost a line. A document left without a word stays, with that
    text. A null source is a source; a null text stays null and counts as a document; repeated
    rows count each; other columns than those of documents are dropped; no rows give none.
    """
    out = line_dedup.drop_site_boilerplate(docs, "source", "text", ratio=BOILERPLATE)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents linked at 5-word shingles and a similarity of 0.8.

    Null and wordless texts are linked with nothing and stay. Of rows with one id, or none, as
    many stay as came first of a group, by the order of their values, so of repeated rows with
    words one stays; no rows give none.
    """
    return ngram_join.one_of_each_component(docs.select(*COLUMNS), ngram_join.ngram_jaccard_components(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it, up to three times.

    A null text has no words; a document without words costs nothing and is taken as its place
    in the order says. A null source is a source; ties in the order go to the smaller document;
    repeated rows are documents each; no rows give none.
    """
    used = mixed(docs.select(*COLUMNS, F.size(words_of(F.col("text"))).cast("long").alias("size"))).where("repeats > 0")
    return used.withColumn("_k", F.explode(F.sequence(F.lit(1), "repeats"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: pieces with their ids' checksum and their place. Null text is the end id alone; null ids and repeated rows are packed each; no rows give none."""
    return packing.pack_documents(docs, VOCABULARY, carry=(F.crc32("ids").alias("ids_crc32"),))


STAGES = [("language ID", language_id), ("line dedup", line_dedup_by_source), ("n-gram Jaccard join", near_duplicates), ("mixing", source_mix), ("packing", pack)]

#: Language ID, near-duplicate components and packing by a tokenizer have no form in SQL; tests/llm/test_pipeline.py holds each stage as wired here against a brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages over documents, each stage's rows written to the shared folder and read again; an empty table gives no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage_) in enumerate(STAGES[:-1]):
        path = f"{shared_dir(spark)}/editscan/pipeline-{k}-{uuid.uuid4().hex}"
        stage_(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
