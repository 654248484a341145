"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Text statistics are transformed to a vector. Per language and source, deterministic starts are
improved by concentration steps towards the minimum covariance determinant: of each start, the
share ``h`` of documents nearest in Mahalanobis distance gives the next mean and covariance.
Distances are binned on a fixed logarithmic scale, so that one aggregation per step, whose state
has a bounded number of bins a group, serves for ranks and moments alike, and no group is
gathered in one task. Of the starts the smallest determinant wins.

Every group is estimated, whatever its size. An estimate counts ``prior`` documents besides its
own that are spread like its language's (and the language's, like all documents'), so a small
source is judged by its language, a large one by itself, and nothing switches in between.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, words_of

P = 5
_X = [f"x{i}" for i in range(P)]
#: Least standard deviations: without them statistics that most documents share exactly would reject every other value.
FLOOR = (0.5, 0.1, 0.5, 0.8, 0.8)


def text_statistics(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols and n_dup_lines of a text whose words are in _w."""
    t, w = F.coalesce(text, F.lit("")), F.col("_w")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")]


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """Adds the text statistics and n_repeat_words; null text counts as empty.

    A window's hash stands for its five words. Repeated windows' places are sorted, and each adds
    the words that the window before it did not cover.
    """
    d = docs.withColumn("_w", words_of(F.col(text)))
    d = d.withColumn("_h", F.when(F.size("_w") >= 5, F.transform(F.sequence(F.lit(0), F.size("_w") - 5), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(5)]))))
    d = d.select(*docs.columns, *text_statistics(F.col(text)), F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.col("_h")).alias("_h"))
    # Windows in order of hash; a place counts where its hash equals the one before or after. Only texts in which a hash occurs twice are sorted.
    d = d.withColumn("_p", F.when(F.col("_h").isNotNull(), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col("_p")
    twice = F.filter(F.zip_with(p, F.zip_with(F.slice(p, 2, F.size(p)), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), p), lambda b, a: F.struct(b["h"].alias("after"), a["h"].alias("before"))), lambda x, n: F.when((x["h"] == n["after"]) | (x["h"] == n["before"]), x["i"])), lambda i: i.isNotNull())
    d = d.withColumn("_at", F.when(p.isNotNull(), F.sort_array(twice)))
    add = F.aggregate(F.col("_at"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda acc, i: F.struct((acc["n"] + i + 5 - F.greatest(i, acc["upto"])).alias("n"), (i + 5).alias("upto")))["n"]
    return d.withColumn("n_repeat_words", F.coalesce(add, F.lit(0)).cast("long")).drop("_h", "_p", "_at")


def chi2_cdf(x: float, k: int) -> float:
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


SALTS = 64


def _salted(small: DataFrame) -> DataFrame:
    """Rows a group for each salt, so that a group with most of the documents is joined in many tasks where the table is not broadcast."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to mean m* and Cholesky factor l*."""
    for i in range(P):
        y = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"y{j}") for j in range(i)), F.lit(0.0))
        df = df.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)), F.lit(0.0))).drop(*[f"y{i}" for i in range(P)])


def _factor(df: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l* of covariance a* and its log determinant; the floors are added to the diagonal."""
    for i in range(P):
        for j in range(i + 1):
            s = F.col(f"a{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s + FLOOR[i] ** 2, F.lit(FLOOR[i] ** 2))) if i == j else s / F.col(f"l{j}{j}"))
    return df.withColumn("logdet", sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0)))


_MOMENTS = [*[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i in range(P) for j in range(i + 1)]]


def _moments(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, and sums of the vectors and of their products."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)], *[F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)])


def _shrunk(df: DataFrame, tree: DataFrame, cols: list[str], prior: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Averages ``cols`` of groups (g, *on, n), each with ``prior`` rows of its parent's shrunk averages besides; tree: (g, parent, level)."""
    # Staged, since every level reads it: one small row a group.
    df, out, above = stage(df, "averages"), None, None
    for level in range(3):
        at = df.join(tree.where(F.col("level") == level).select("g", "parent"), "g")
        if above is not None:
            at = at.join(above.select(F.col("g").alias("parent"), *on, *[F.col(c).alias(f"_{c}") for c in cols]), ["parent", *on])
            at = at.select("g", *on, *[((F.col("n") * F.col(c) + prior * F.col(f"_{c}")) / (F.col("n") + prior)).alias(c) for c in cols])
        above = at.select("g", *on, *cols)
        out = above if out is None else out.unionByName(above)
    return out


def _shape(averages: DataFrame) -> DataFrame:
    """Mean and covariance of averaged moments s*, q*."""
    return averages.select("g", "start", *[F.col(f"s{i}").alias(f"m{i}") for i in range(P)], *[(F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}")).alias(f"a{i}{j}") for i in range(P) for j in range(i + 1)])


_D_BINS = 64


def minimum_covariance_determinant(vectors: DataFrame, tree: DataFrame, h: float = 0.75, steps: int = 4, prior: float = 50.0) -> DataFrame:
    """Per group g: mean m*, Cholesky factor l* (consistent at the normal).

    vectors: (g, salt, x0..x4), a row for each group that a document is of, its own and those above;
    tree: (g, parent, level), level 0 the root. An empty table gives an empty result.
    """
    # Start 0: medians and median absolute deviations; start 1: spatial signs about the medians.
    long = vectors.select("g", "salt", F.posexplode(F.array(*_X)).alias("k", "x"))
    place = lambda df, x, by: _quantile(df.withColumn("bin", F.floor(F.col(x) * 128).cast("long")), by, 0.5)
    wide = lambda df, name: df.groupBy("g").agg(F.max("all").alias("n"), *[F.max(F.when(F.col("k") == i, F.col("v"))).alias(f"{name}{i}") for i in range(P)])
    med = place(long, "x", ["g", "k"]).select("g", "k", "all", ((F.col("bin") + 0.5) / 128).alias("v"))
    med = stage(_shrunk(wide(med, "m"), tree, [f"m{i}" for i in range(P)], prior), "medians")
    centre = med.select("g", F.posexplode(F.array(*[f"m{i}" for i in range(P)])).alias("k", "m"))
    mad = place(long.join(_salted(centre), ["g", "k", "salt"]).withColumn("r", F.abs(F.col("x") - F.col("m"))), "r", ["g", "k"]).select("g", "k", "all", ((F.col("bin") + 0.5) / 128 * 1.4826).alias("v"))
    start = stage(med.join(_shrunk(wide(mad, "v"), tree, [f"v{i}" for i in range(P)], prior), "g"), "starts")
    scale = lambda i: F.greatest(F.col(f"v{i}"), F.lit(FLOOR[i]))
    z = vectors.join(_salted(start), ["g", "salt"])
    for i in range(P):
        z = z.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}")) / scale(i))
    z = z.withColumn("norm", F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0)), F.lit(1e-9)))
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    signs = z.groupBy("g").agg(F.count("*").alias("n"), *[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm")).alias(f"c{i}{j}") for i, j in pairs])
    both = start.join(_shrunk(signs, tree, [f"c{i}{j}" for i, j in pairs], prior), "g")
    first = [both.select("g", F.lit(s).alias("start"), *[f"m{i}" for i in range(P)], *[((F.col(f"c{i}{j}") * P if s else F.lit(float(i == j))) * scale(i) * scale(j)).alias(f"a{i}{j}") for i, j in pairs]) for s in (0, 1)]
    shape = stage(_factor(first[0].unionByName(first[1])), "shapes")
    for _ in range(steps):
        d = _distance(vectors.join(_salted(shape), ["g", "salt"])).withColumn("bin", F.floor(F.log2(F.col("d2") + 2.0**-20) * _D_BINS).cast("long"))
        bins = _moments(d, ["g", "start", "bin"])
        w = Window.partitionBy("g", "start")
        # At most a bin for each 64th of a power of two from 2^-20 on, whatever the group's size.
        kept = bins.withColumn("before", F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(w)).where(F.col("before") < F.col("all") * h)
        merged = kept.groupBy("g", "start").agg(F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(c) for c in _MOMENTS])
        shape = stage(_factor(_shape(_shrunk(merged, tree, _MOMENTS, prior, ("start",)))), "shapes")
    best = shape.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("logdet", "start"))).where("rank = 1")
    grow = math.sqrt(h / chi2_cdf(chi2_quantile(h, P), P + 2))
    return best.select("g", *[f"m{i}" for i in range(P)], *[(F.col(f"l{i}{j}") * grow).alias(f"l{i}{j}") for i, j in pairs])


def _quantile(df: DataFrame, by: list[str], q: float) -> DataFrame:
    """The bin of each group in which the share q of its rows is reached."""
    n = df.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    return n.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w)).where((F.col("upto") >= F.col("all") * q) & (F.col("upto") - F.col("n") < F.col("all") * q)).drop("n", "upto")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = 1e-6, prior: float = 50.0) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept.

    base_failed: fewer than 10 words, or more than a fifth of them in repeated 5-word windows.
    kept: not base_failed, and the squared distance is at most the chi-square value that normal
    data exceed at rate ``cutoff``. Language and source (null: a value of its own) make a group,
    estimated on those that did not fail, with ``prior`` documents of its language besides. Null
    or empty text has no words and fails. Null ids stay null; repeated rows are each judged;
    other columns are ignored; an empty table gives no rows.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.concat(F.lit("l"), F.col(lang)), F.lit("")).alias("lang"), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("source"))
    d = with_statistics(src, "text").drop("text")
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    per = F.col("n_words") + 1
    d = d.withColumns({"x0": F.log1p("n_words"), "x1": F.log((F.col("word_chars") + 1) / per), "x2": F.log1p(100 * F.col("n_symbols") / per), "x3": F.log1p(F.col("n_dup_lines")), "x4": F.log1p(100 * F.col("n_repeat_words") / per)})
    # A name holds its language's length, so no two groups share one.
    names = [F.lit("all"), F.concat(F.lit("l"), F.col("lang")), F.concat(F.lit("g"), F.length("lang").cast("string"), F.lit(":"), "lang", "source")]
    d = stage(d.withColumn("g", names[2]).withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")), "statistics")
    ok = d.where(~F.col("base_failed"))
    level = lambda k: F.struct(names[k].alias("g"), (names[k - 1] if k else F.lit(None).cast("string")).alias("parent"), F.lit(k).alias("level"))
    tree = stage(ok.select("lang", "source").distinct().select(F.explode(F.array(*[level(k) for k in range(3)])).alias("t")).select("t.*").distinct(), "groups")
    vectors = ok.select(F.explode(F.array(*names)).alias("g"), "salt", *_X)
    shape = minimum_covariance_determinant(vectors, tree, prior=prior)
    far = _distance(d.join(_salted(stage(shape, "shape")), ["g", "salt"], "left"))
    good = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(1 - cutoff, P))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("d2").alias("distance2"), good.alias("kept"))
