"""Each registered query over whole tables, against brute force or its SQL."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from editscan.llm import queries


def docs_of(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_op1(spark, medium):
    want = brute.unigram(docs_of(medium))
    got = rows(queries.op1_suffix_tree_scores(spark, medium))
    assert len(got) == len(want)
    for r in got:
        held, n, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) * 0.99


def test_op2(spark, medium):
    want = brute.components(docs_of(medium), 4, 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(queries.op2_ngram_jaccard_components(spark, medium))}
    assert got == want


def test_op3(spark, medium):
    e = duckdb.sql(f"SELECT vec_id, embedding FROM '{medium}/embeddings.parquet'").fetchall()
    ids, m = np.array([i for i, _ in e]), np.array([v for _, v in e], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    got, hits, n = defaultdict(list), 0, 0
    for r in rows(queries.op3_nearest_neighbours(spark, medium).orderBy("query_id", "rank")):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q, found in got.items():
        sims = m @ m[ids == q][0]
        sims[ids == q] = -2
        best = set(ids[np.lexsort((ids, -sims))[:5]].tolist())
        hits, n = hits + len(best & {i for i, _ in found}), n + 5
        assert len(found) == 5 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - sims[ids == i][0]) < 1e-12 for i, s in found)
    assert hits / n >= 0.9


def test_op4(spark, medium):
    text = dict(docs_of(medium))
    got = rows(queries.op4_quality_rules(spark, medium))
    assert len(got) == len(text)
    for r in got:
        w, chars, symbols, dup, rep = brute.statistics(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (w, chars, symbols, dup, rep)
        assert r["base_failed"] == (w < 10 or 100 * rep > 20 * w)
        assert not (r["base_failed"] and r["kept"])
    assert sum(r["kept"] for r in got) > 0.5 * sum(not r["base_failed"] for r in got)


def test_op4_verdicts(spark, medium):
    """Every verdict and distance against brute force, in the small groups of the given table and in large made ones."""
    from editscan.llm import quality

    given = duckdb.sql(f"SELECT doc_id, lang, source, text FROM '{medium}/documents.parquet' ORDER BY doc_id").fetchall()
    made = [(10**6 + i, "xx", "one" if i % 3 else "two", t) for i, (_, _, _, t) in enumerate(given) if t]
    rows_ = given + made + [(2 * 10**6, "xx", "one", "### " * 300), (2 * 10**6 + 1, None, None, given[0][3])]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows_, "doc_id long, lang string, source string, text string")).collect()}
    want = dict(zip([r[0] for r in rows_], brute.kept([r[1:] for r in rows_])))
    assert sum(len([r for r in rows_ if r[1:3] == g]) > 250 for g in {r[1:3] for r in rows_}) >= 2
    for i, (keep, d2) in want.items():
        assert got[i]["kept"] == keep
        if d2 is not None:
            assert got[i]["distance2"] == pytest.approx(d2, rel=1e-6, abs=1e-9)
    assert not got[2 * 10**6]["kept"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, medium, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{medium}/{t}.parquet'")
    df = queries.QUERIES[name](spark, medium)
    cols = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(want)


def test_op5_near_targets(spark, medium):
    got = rows(queries.op5_source_mix(spark, medium))
    by = defaultdict(int)
    for r in got:
        by[r["source"], r["target"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    largest = max(r["size"] for r in got)
    assert all(abs(n - t) <= largest for (_, t), n in by.items())


def test_op7(spark, medium):
    want = duckdb.sql(f"SELECT doc_id, lang FROM '{medium}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in rows(queries.op7_language_id(spark, medium))}
    assert len(got) == len(want)
    held = [(got[i]["lang_pred"], lang) for i, lang in want if brute.crc(i, 5) == 0]
    assert all(got[i]["held_out"] == (brute.crc(i, 5) == 0) and 0 <= got[i]["score"] <= 1 for i, _ in want)
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_op8(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in docs_of(small)}
    got, seqs = rows(queries.op8_minimum_bin_slack(spark, small)), defaultdict(list)
    parts = defaultdict(list)
    for r in got:
        x = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(x) == r["length"] and zlib.crc32(x.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        assert sum(n for _, n in parts[i]) == len(x) and sorted(a for a, _ in parts[i]) == list(np.cumsum([0, *(n for _, n in sorted(parts[i]))])[:-1])
    for s in seqs.values():
        assert [a for a, _ in sorted(s)] == list(np.cumsum([0, *(n for _, n in sorted(s))])[:-1]) and sum(n for _, n in s) <= 1024
    assert sum(len(x) for x in ids.values()) / (1024 * len(seqs)) > 0.97


def test_op9(spark, medium):
    text = dict(docs_of(medium))
    got = rows(queries.op9_personal_data(spark, medium))
    assert len(got) == len(text)
    for r in got:
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == brute.personal_row(text[r["doc_id"]])
        assert set(f"{k}:{a}:{b}" for k, a, b in brute.personal(text[r["doc_id"]])) <= set(r["spans"].split(","))


def test_op6_loss_text(spark, small):
    conv = defaultdict(list)
    for c, t, r, x in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{small}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        conv[c].append((r, x))
    conv[-7] = [(r, r"\### Assistant: </turn> ok") for r in ("user", "assistant")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = rows(queries.op6_reply_trees(spark, small))
    assert len(got) == len(conv)
    for r in got:
        c = conv[r["conv_id"]]
        loss = "".join(x for role, x in c if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(c), sha("".join(f"{a}\n{x}\n" for a, x in c)), len(loss), sha(loss))
