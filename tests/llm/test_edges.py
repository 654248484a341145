"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools
import random

import brute
import pytest
from editscan.llm import chat, langid, line_dedup, mixing, neighbours, ngram_join, packing, pii, quality, suffix_tree
from editscan.llm.queries import VOCABULARY, conversation_digests, mixed
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, n int, size string"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, None, None, None, None, "x", 1, "s"), (2, "", "en", "a", 0, None, None, None), (3, " \t\n", None, "a", 3, None, 1, None), (4, LONG, "en", None, len(LONG), None, 1, None), (5, "one two", "en", "a", 7, None, 1, None), (5, "one two", "en", "a", 7, None, 1, None), (None, "one two", "en", "a", 7, None, 1, None), (6, "ONE  two", "fr", "b", 8, None, 1, None), (7, "!!! 123", "fr", "b", 7, None, 1, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_tree(docs, none):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = suffix_tree.suffix_tree_scores(docs, train).collect()
    assert len(got) == len(ROWS)
    one = {r["doc_id"]: r for r in got}
    assert one[1]["n_tokens"] == 1 and one[4]["n_tokens"] == 30_001 and one[None]["held_out"]
    assert suffix_tree.suffix_tree_scores(none, train).count() == 0
    untrained = suffix_tree.suffix_tree_scores(docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["score"] == pytest.approx(r["base_score"]) for r in untrained)


def test_ngram_join(docs, none):
    got = ngram_join.ngram_jaccard_components(docs, k=4, num=85)
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got.collect())
    assert rows == [(-1, 1, 5), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 29_997, 4), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 7)]
    assert ngram_join.ngram_jaccard_components(none).count() == 0
    kept = ngram_join.one_of_each_component(docs, got)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 7]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_finds_chains(spark, seed):
    """Near copies at random distances, so that groups hang together by chains and pairs near the threshold."""
    rng, rows = random.Random(seed), []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.randint(30, 60))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            cut = rng.randint(0, 4)
            rows.append((len(rows), " ".join(w[: len(w) - cut])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85).collect()}
    assert got == brute.components(rows, 4, 85, 100)


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (50, [1e-30, 1e-30]), (9, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("shard", F.lit(1))
    got = [tuple(r) for r in neighbours.nearest_neighbours(v, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 3), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3)]
    assert got[0][3] == 1.0 and got[3][3] == 0.0 and got[2][3] == pytest.approx(0.5**0.5)
    assert neighbours.nearest_neighbours(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_quality(docs, none):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert got[1]["n_words"] == 0 and not got[1]["kept"] and got[4]["n_words"] == 30_000 and got[4]["n_repeat_words"] == 0
    assert quality.quality_rules(docs).count() == len(ROWS) and quality.quality_rules(none).count() == 0


def test_repeat_words(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.with_statistics(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()}
    assert got == {i: brute.statistics(t)[4] for i, t in rows}


def test_mixing(docs, none):
    got = mixed(docs.withColumn("size", F.lit(2))).collect()
    assert len(got) == len(ROWS) and all(0 <= r["repeats"] <= 3 for r in got)
    assert mixed(none.withColumn("size", F.lit(2))).count() == 0


def test_min_cost_flow():
    flow = mixing.min_cost_flow([(("a",), 10), (("a", "b"), 10), ((), 5)], {"a": 12, "b": 25})
    assert sum(f.get("a", 0) for f in flow) == 12 and sum(f.get("b", 0) for f in flow) == 25
    assert sum(flow[0].values()) <= 30 and flow[2] == {}


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_the_cheapest_of_the_largest(seed):
    """Overlapping sources: total and repetition cost against all integral flows."""
    rng = random.Random(seed)
    names, costs = ["a", "b"], (0, 1, 3)
    patterns = [(tuple(p), rng.randint(0, 3)) for p in (["a"], ["a", "b"], ["b"])[: rng.randint(1, 3)]]
    quotas = {s: rng.randint(0, 7) for s in names}
    price = lambda used, words: sum(costs[u // words] for u in range(used))
    best = None
    ways = [[dict(zip(p, use)) for use in itertools.product(range(3 * n + 1), repeat=len(p)) if sum(use) <= 3 * n] for p, n in patterns]
    for flow in itertools.product(*ways):
        if all(sum(f.get(s, 0) for f in flow) <= quotas[s] for s in names):
            got = (-sum(sum(f.values()) for f in flow), sum(price(sum(f.values()), n) for f, (_, n) in zip(flow, patterns) if n))
            best = got if best is None else min(best, got)
    flow = mixing.min_cost_flow(patterns, quotas)
    assert all(sum(f.get(s, 0) for f in flow) <= quotas[s] for s in names)
    assert (-sum(sum(f.values()) for f in flow), sum(price(sum(f.values()), n) for f, (_, n) in zip(flow, patterns) if n)) == best


def test_mix_of_overlapping_sources(spark):
    """What each membership pattern gives is what the flow says, to half a document; quotas are met from shared documents first used once."""
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 9), [["x"], ["x", "y"], ["y"], ["y", "x", "y"], []][i % 5]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    words = {}
    for _, n, s in rows:
        words[tuple(sorted(set(s)))] = words.get(tuple(sorted(set(s))), 0) + n
    quotas = {"x": words["x",] + words["x", "y"] // 2, "y": words["y",] + words["x", "y"] // 4}
    got, most = {}, 0
    for r in mixing.mix_sources(docs, quotas).collect():
        p = tuple(sorted(set(r["sources"])))
        got[p] = got.get(p, 0) + r["size"] * r["repeats"]
        most = max(most, r["repeats"])
    assert most == 1 and got[()] == 0
    order = sorted(words)
    flow = dict(zip(order, mixing.min_cost_flow([(p, words[p]) for p in order], quotas)))
    assert all(abs(got[p] - sum(flow[p].values())) <= 9 for p in order)
    assert {s: sum(f.get(s, 0) for f in flow.values()) for s in quotas} == quotas and min(flow["x", "y"].values()) > 0


def test_repeated_and_null_nodes(spark):
    schema = "tree string, node long, parent long, role string, text string, score double, k int, up int, leaf string"
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "r", 1.0), ("t", None, 1, "user", "lost", 1.0), (None, 1, None, "user", "n", None), (None, 2, 1, None, None, None)]
    got = {r["tree"]: r for r in chat.format_reply_trees(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {"t": 2, None: 2}
    assert got["t"]["formatted"] == "<turn user>\nq</turn>\n<turn assistant>\nr</turn>\n"


def test_targets_at_the_edges(spark):
    got = {r["source"]: r["target"] for r in mixing.fair_targets(spark.createDataFrame([(None, 10), ("a", 0), ("b", None), ("c", 30)], "source string, source_size long")).collect()}
    assert got["a"] == got["b"] == 0 and got["c"] + got[None] == pytest.approx(40)
    assert mixing.fair_targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_chat(spark):
    rows = [(None, 1, "user", "a"), (1, None, None, None), (1, 1, "assistant", r"\l \\l <\ >"), (1, 1, "assistant", "</turn>\n<turn user>\n"), (2, 1, "user", ""), (2, 1, "user", "")]
    got = {r["conv_id"]: r for r in conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {None: 1, 1: 3, 2: 2}
    assert got[1]["loss_chars"] == len(rows[2][3]) + len(rows[3][3])
    assert conversation_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_reply_trees(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 9.0), ("t", 4, 3, "user", "more", 9.0), ("u", 1, 2, "user", "loop", 1.0), ("u", 2, 1, "user", "loop", 1.0), ("u", 3, 2, "user", "below", 1.0), ("u", 9, 77, "user", "orphan", None)]
    got = chat.format_reply_trees(spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double"), best=1)
    made = {r["tree"]: r for r in got.select("*", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert [(x["role"], x["text"]) for x in made["t"]["t"]] == [("user", "q"), ("assistant", "good"), ("user", "more")]
    assert [x["text"] for x in made["u"]["t"]] == ["orphan"]


def test_langid(docs, none, spark):
    m = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, m).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[7]["lang_pred"] == "und" and got[4]["lang_pred"] == "en" and got[1]["score"] == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}
    assert langid.predict(none, m).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs, VOCABULARY).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 1 and len([r for r in got if r["doc_id"] == 5]) == 2
    assert all(len(r["ids"]) == 4 * r["length"] for r in got)
    assert packing.pack_documents(none, VOCABULARY).count() == 0


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    enc, rng = packing.encoder(VOCABULARY), random.Random(0)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x24F), rng.randrange(0x4E00, 0x4F00), 0x1F600, 10, 32, 0x3000])) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for x in [*texts, "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|", "x<|endoftext|><|endoftext|>\ny", "it's  I'll \n\n x"]:
        assert enc(x) == t.encode(x, add_special_tokens=False).ids
    assert 50256 in enc("a <|endoftext|> b")


@pytest.mark.parametrize("seed", range(30))
def test_a_window_is_filled_closest_to_capacity(seed):
    """The longest length is taken, and no choice of the others fills the window better."""
    rng = random.Random(seed)
    capacity = rng.randint(5, 40)
    counts = {rng.randint(1, capacity): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
    took = packing.fill(counts, capacity)
    longest = max(counts)
    sums = {longest}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n - (x == longest) + 1) if s + k * x <= capacity}
    assert took[longest] >= 1 and all(0 < n <= counts[x] for x, n in took.items())
    assert sum(x * n for x, n in took.items()) == max(sums)


def test_plan_uses_each_piece_once():
    rng = random.Random(0)
    hist = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(40)}
    fill, seen = {}, {}
    for x, low, high, per, seq, at in packing.plan(hist, 64):
        assert low == seen.get(x, 0)
        seen[x] = high
        for r in range(low, high):
            fill[seq + (r - low) // per] = fill.get(seq + (r - low) // per, 0) + x
    assert seen == hist and max(fill.values()) <= 64


def test_pii(spark, none):
    texts = [None, "", "1" * 20_000, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1", "\U0001f600 x@y.com +1 (017) 555-7713", "4111 1111 1111 1111 4111-1111-1111-1112", "12 " * 3000 + "1 2", "jane (at) mail (dot) com"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == brute.personal(texts[r["doc_id"]])
    assert pii.find_personal_data(none).count() == 0


def test_line_dedup(spark):
    rows = [(i, "h", f"menu\n\nown {i}") for i in range(4)] + [(9, None, None), (10, None, "menu"), (11, "h", None)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string").withColumn("_b", F.lit(1)).withColumn("n_lines", F.lit("old"))
    got = {r["page_id"]: r for r in line_dedup.drop_site_boilerplate(df, "host", "text").collect()}
    assert got[0]["text"] == "\nown 0" and (got[0]["n_lines"], got[0]["n_dropped"]) == (2, 1)
    assert got[9]["text"] is None and got[10]["text"] == "menu" and got[11]["n_dropped"] == 0
    assert line_dedup.drop_site_boilerplate(df.limit(0), "host", "text").count() == 0
