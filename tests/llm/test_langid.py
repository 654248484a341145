"""Predictions against brute force; no language is left out silently or loses its words to a larger one."""

import brute
import duckdb
import pytest
from editscan.llm import langid


def test_too_many_languages_is_an_error(spark):
    docs = spark.createDataFrame([(i, f"l{i}", f"word{i} word{i}") for i in range(3)], "doc_id long, lang string, text string")
    assert langid.fit(docs, max_langs=3).langs == ["l0", "l1", "l2"]
    with pytest.raises(ValueError):
        langid.fit(docs, max_langs=2)


def test_predictions(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, lang, text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()
    rows += [(10**6, None, "zzqx zzqy zz"), (10**6 + 1, None, "12 --"), (10**6 + 2, "en", None)]
    train = [r for r in rows if brute.crc(r[0], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for limits in ({}, {"max_words": 900, "max_grams": 300}):
        model = langid.fit(spark.createDataFrame(train, docs.schema), **limits)
        got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
        for (i, _, _), (lang, score) in zip(rows, brute.languages([r[1:] for r in train], [r[2] for r in rows], **limits)):
            assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-9)


def test_small_languages_keep_their_words(spark):
    docs = [(i, "big", " ".join(f"big{k} big{k}" for k in range(i, i + 40))) for i in range(200)] + [(900 + i, "tiny", "kala kala maja maja") for i in range(3)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, lang string, text string"), max_words=5, max_grams=5)
    assert {"kala", "maja"} <= set(model.words) and len(model.words) <= 10


def test_rows_without_ids_teach_in_part(spark):
    docs = [(None, "a", f"wort{chr(97 + i % 20)}{chr(97 + i // 20)} " * 2) for i in range(400)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, lang string, text string"), max_docs=100)
    assert 40 < len(model.words) < 200
