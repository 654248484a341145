"""Language identification, word first, with backoff to character n-grams.

A known word scores its log frequency in each language. An unseen word falls back to its
character n-grams of the longest length any of which is known, then to shorter ones.
The model is fitted on a bounded, hash-chosen sample of the labelled rows (``max_docs`` a
language, at most ``max_words`` and ``max_grams`` entries a language), so its size has a proven bound.
"""

from __future__ import annotations

import math
import re

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, release, slices, stage, words_of

UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


@dataclass
class Model:
    """Words and n-grams as rows of log frequencies, a column per language."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    longest: int


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", max_docs: int = 8000, max_langs: int = 200, max_words: int = 30_000, max_grams: int = 15_000, least: int = 2, longest: int = 4) -> Model:
    """Learns from rows with a language and a text; null languages and texts teach nothing, and no rows give an empty model.

    The sample takes about ``max_docs`` documents of each language, by hash of id and text. Of
    each language's words and n-grams seen ``least`` times or more in the sample, the
    ``max_words`` and ``max_grams`` most frequent are known (ties by code point); the method
    backs off from the others. More than ``max_langs`` languages are an error: none is left out.
    """
    src = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 20)).alias("h"))
    n = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs + 1).collect()}
    if len(n) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs, none is left out")
    langs = sorted(n)
    if not langs:
        return Model([], {}, np.empty((0, 0)), {}, np.empty((0, 0)), longest)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(math.ceil(min(1.0, max_docs / n[k]) * (1 << 20))))])
    sample = src.where(F.col("h") < share[F.col("lang")])
    word = F.regexp_replace(F.lower("w"), r"^[^\p{L}]+|[^\p{L}]+$", "")
    words = sample.select("lang", F.explode(words_of(F.col("text"))).alias("w")).select("lang", word.alias("w")).where("w <> ''").groupBy("w", "lang").agg(F.count("*").alias("n"))
    words = stage(words, "words")

    def top(counts: DataFrame, key: str, most: int) -> tuple[dict[str, int], np.ndarray]:
        each = Window.partitionBy("lang").orderBy(F.desc("n"), key)
        often = counts.groupBy(key).agg(F.sum("n").alias("all")).where(F.col("all") >= least).select(key)
        chosen = counts.join(often, key, "left_semi").withColumn("r", F.row_number().over(each)).where(F.col("r") <= most).select(key).distinct()
        best = counts.join(chosen, key, "left_semi").toArrow()
        index = {w: i for i, w in enumerate(sorted(set(best.column(key).to_pylist())))}
        c = np.zeros((len(index), len(langs)))
        for w, k, m in zip(*(best.column(x).to_pylist() for x in (key, "lang", "n"))):
            c[index[w], langs.index(k)] = m
        return index, np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * (len(c) + 1)))

    marked = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    # Spark hands a lambda of two arguments an element's place, so the length is bound from outside.
    piece = lambda g: lambda i: F.substring(marked, i, F.lit(g))
    cut = lambda g: F.when(F.length(marked) >= g, F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (g - 1), F.lit(1))), piece(g))).otherwise(F.array().cast("array<string>"))
    grams = words.select("lang", "n", F.explode(F.flatten(F.array(*[cut(g) for g in range(1, longest + 1)]))).alias("g")).groupBy("g", "lang").agg(F.sum("n").alias("n"))
    return Model(langs, *top(words, "w", max_words), *top(stage(grams, "grams"), "g", max_grams), longest)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log frequencies of words, a row each and a column per language, centred; 0 for a word without evidence."""
    out = np.zeros((len(words), len(model.langs)))
    at, known, owner, flat = [], [], [], []
    get = model.grams.get
    for k, w in enumerate(words):
        w = _EDGE.sub("", w.lower())
        i = model.words.get(w)
        if i is not None:
            at.append(k)
            known.append(i)
        elif w:
            m = f"^{w}$"
            for g in range(min(model.longest, len(m)), 0, -1):
                found = [i for i in map(get, [m[j : j + g] for j in range(len(m) - g + 1)]) if i is not None]
                if found:
                    owner += [k] * len(found)
                    flat += found
                    break
    if at:
        out[at] = model.word_logs[known]
    if flat:
        owner = np.array(owner)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first]] = np.add.reduceat(model.gram_logs[flat], first, axis=0) / np.diff(first, append=len(owner))[:, None]
    return out - out.mean(axis=1, keepdims=True) if len(words) and len(model.langs) else out


class _Index(dict):
    """Numbers words as they are met; ``fresh`` holds those not scored yet."""

    fresh: list

    def __missing__(self, w):
        self[w] = k = len(self)
        self.fresh.append(w)
        return k


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row's ``keep`` columns with lang_pred and score.

    ``und`` with score 0 if the text is null or has no letter (or nothing was learned). Score: the
    language's share of the softmax of the words' summed evidence, 0 to 1. Ties: the first language by code
    point. Null ids stay null; repeated rows are each predicted; other columns are ignored.
    """
    src = docs.select(F.col(text).cast("string").alias("_t"), *keep)
    sent, ddl = docs.sparkSession.sparkContext.broadcast(dict(vars(model))), ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])
    schema = _arrow_schema(docs.sparkSession, ddl)

    def run(batches):
        m = Model(**sent.value)
        langs, index = m.langs, _Index()
        index.fresh, table = [], np.zeros((0, len(langs)))
        for b in slices(batches, 2000):
            out, texts = [], b.column(0).to_pylist()
            for a in range(0, len(texts), 500):
                ids = [None if not langs or t is None or not _LETTER.search(t) else list(map(index.__getitem__, t.encode().split())) for t in texts[a : a + 500]]
                table = np.concatenate([table, word_scores([w.decode() for w in index.fresh], m)])
                index.fresh = []
                for x in ids:
                    if x is None:
                        out.append((UND, 0.0))
                        continue
                    total = table[x].sum(axis=0)
                    best = int(total.argmax())
                    out.append((langs[best], float(1 / np.exp(np.minimum(0, total - total[best])).sum())))
                if len(index) > 200_000:
                    index, table = _Index(), table[:0]
                    index.fresh = []
            pred, score = zip(*out) if out else ([], [])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(list(pred), pa.string()), pa.array(list(score), pa.float64())], names=schema.names)
        del index, table, m
        release()

    return src.mapInArrow(run, ddl)
