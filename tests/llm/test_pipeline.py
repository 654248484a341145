"""The pipeline as wired: each stage against brute force on its own input, and run() against the stages one after another."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from editscan.llm.queries import VOCABULARY

WEIGHTS = (5, 2, 1)


def rows(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def in_a_language(docs):
    found = brute.languages([(d[2], d[1]) for d in docs], [d[1] for d in docs])
    return [(*d[:2], lang, *d[3:]) for d, (lang, score) in zip(docs, found) if lang != "und" and score >= 0.5]


def without_site_lines(docs):
    bare = lambda x: x.strip(" \t\n\r\x0b\f")
    pages, seen = Counter(d[3] for d in docs), Counter()
    for d in docs:
        seen.update((d[3], x) for x in {bare(x) for x in (d[1] or "").split("\n")} if x)
    out = []
    for i, text, lang, source, n in docs:
        lines = text.split("\n")
        kept = [x for x in lines if not (bare(x) and seen[source, bare(x)] >= 3 and seen[source, bare(x)] > 0.07 * pages[source])]
        new = "\n".join(kept)
        out.append((i, new, lang, source, len(new) if len(kept) < len(lines) else n))
    return out


def first_of_groups(docs):
    group = brute.components([d[:2] for d in docs], 5, 4, 5)
    return [d for d in docs if group[d[0]][1] == d[0]]


def mixed(docs):
    size = {d[0]: len(brute.WORD.findall(d[1])) for d in docs}
    total = Counter()
    for d in docs:
        total[d[3]] += size[d[0]]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, capped = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rest * weight[s] > 3 * total[s] * free}
        if not over:
            break
        capped |= over
    out = []
    for s in names:
        words = 3 * total[s] if s in capped else rest * weight[s] // free
        rounds, more = divmod(words, total[s]) if total[s] else (0, 0)
        upto = 0
        for d in sorted((d for d in docs if d[3] == s), key=lambda d: hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()):
            upto += size[d[0]]
            out += [d] * (rounds + (total[s] > 0 and 2 * upto - size[d[0]] <= 2 * more))
    return out


BRUTE = [in_a_language, without_site_lines, first_of_groups, mixed]


def packs_exactly(docs, got):
    """Every copy of a document is covered once by its pieces, and sequences have no gap or overflow."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x, *_ in docs}
    tokens, want, seqs = Counter(), Counter(), defaultdict(list)
    for d in docs:
        want.update({(d[0], k): 1 for k in range(len(ids[d[0]]))})
    for r in got:
        x = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(x) == r["length"] > 0 and zlib.crc32(x.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        tokens.update({(r["doc_id"], k): 1 for k in range(r["start"], r["start"] + r["length"])})
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert tokens == want
    for s in map(sorted, seqs.values()):
        assert [a for a, _ in s] == np.cumsum([0, *(n for _, n in s)])[:-1].tolist() and sum(n for _, n in s) <= 1024
    return len(seqs)


@pytest.fixture(scope="module")
def stages(spark, medium, tmp_path_factory):
    """What each stage was given and what it made."""
    d, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{medium}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, medium)
        made.write.parquet(f"{d}/{k}")
        made = spark.read.parquet(f"{d}/{k}")
        out.append((name, docs, made))
        docs = made
    return out


@pytest.mark.parametrize("k", range(4))
def test_stage(stages, k):
    _, given, made = stages[k]
    got, want = Counter(rows(made)), Counter(BRUTE[k](rows(given)))
    assert got == want
    assert made.columns[:5] == corpus_pipeline.COLUMNS and got


def test_packing_stage(stages):
    _, given, made = stages[4]
    docs, got = rows(given), [r.asDict() for r in made.collect()]
    n = packs_exactly(docs, got)
    assert sum(r["length"] for r in got) / (1024 * n) > 0.97


def test_run(spark, medium, stages):
    got = corpus_pipeline.run(spark, medium)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(tuple(r) for r in got.select("doc_id", "doc_tokens").where("start = 0").collect()) == Counter(tuple(r) for r in stages[4][2].select("doc_id", "doc_tokens").where("start = 0").collect())
    packs_exactly(rows(stages[3][2]), [r.asDict() for r in got.select(*key, "sequence_id", "offset").collect()])


def test_language_stage_rejects(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").limit(200)
    more = spark.createDataFrame([(-1, None, "de", "a", None), (-2, "", None, None, 0), (-3, "12 !! \n", "en", "a", 7), (-4, "\u0436", None, None, 1)], docs.schema)
    given = docs.unionByName(more)
    got = rows(corpus_pipeline.language_id(spark, given, medium))
    assert Counter(got) == Counter(in_a_language(rows(given))) and 195 <= len(got) <= 201


def test_language_stage_uses_predictions(spark):
    """A text in a language it is not labelled with gets its own; one of words that all languages share alike goes."""
    words = {"aa": "apa banta cerra dirra", "bb": "uvo wexo yzo zuvo", "cc": "illi jinni killi linni"}
    docs = [(i, " ".join([words[k]] * 5 + ["same"]), k, "s", 1) for k in words for i in range(30)]
    docs += [(500, words["aa"], "bb", "s", 1), (501, "same", None, None, None), (502, "same", "cc", "s", 1)]
    got = {r[0]: r for r in rows(corpus_pipeline.language_id(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)), ""))}
    assert got[500][2] == "aa" and 501 not in got and len(got) >= 31


def test_edges(spark, tmp_path):
    """Nulls in every column, repeated rows, an empty table and other columns, through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, score int, size string, _h int"
    text = "one two three four five six seven eight nine ten"
    given = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (2, None, None, None, None), (3, "", "en", None, 0), (4, "un deux trois quatre " * 3, "fr", "b", 5), (5, "line\n" * 2000 + "x", "en", "a", None)]
    for more in (given, []):
        docs = spark.createDataFrame([(*r, "r", 1, "s", 2) for r in more], schema)
        spark.createDataFrame([(*r, "r", 1, "s", 2) for r in more], schema).write.parquet(f"{tmp_path}/{len(more)}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, "")
            made.write.parquet(f"{tmp_path}/{len(more)}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{len(more)}/{k}")
            assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
        assert (docs.count() > 0) == bool(more)
        assert (corpus_pipeline.run(spark, f"{tmp_path}/{len(more)}").count() > 0) == bool(more)


def test_stages_do_something(stages):
    docs = [rows(given) for _, given, _ in stages]
    assert {d[1] for d in docs[1]} != {d[1] for d in docs[2]} and len(docs[3]) < len(docs[2]) and len(docs[4]) != len(docs[3])
