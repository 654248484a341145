"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give base spans; looser ones give candidates. Four labelers vote -1, 0 or 1 on
each candidate: its pattern, a gazetteer (of top-level domains, issuers, areas, given names),
the words before it and its edges. Votes are counted by pattern, of which there are at most
9 kinds x 3^4, whatever the corpus; on those counts expectation-maximisation estimates each
labeler's reliability per class, and a logistic span classifier is trained on the posteriors. It
decides about loose candidates; base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums, stage

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_masked", "phone_local", "name", "card_like", "secret")
VOTES = ("v_pattern", "v_gazetteer", "v_context", "v_edges")

# The contract's patterns with possessive repeats and run starts, which change no match but keep long runs linear.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_masked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\(\[]at[\)\]] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\(\[]dot[\)\]] ?)[A-Za-z0-9-]{1,63}){1,4}",
    "phone_local": r"(?<![+0-9.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof)\. \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?",
    "card_like": r"(?<![0-9])[0-9]{14,19}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}+",
}
# What a text must hold to have a match at all.
_GATES = {"email": "@", "phone": "+", "email_masked": "at"}
_SIGNS = {"name": r"(?:Mr|Mrs|Ms|Dr|Prof)\. ", "ip": r"[0-9]\.[0-9]", "phone_local": "[0-9]{3}[.-][0-9]{4}", "card_like": "[0-9]{14}", "secret": "[A-Za-z0-9_]{24}"}
# Gazetteers: fixed values.
_TLDS = r"(?i)\.(com|org|net|edu|gov|info|biz|io|de|fr|es|it|uk|eu|ch|at|nl|be)$"
_NAMES = r"(?i) (john|mary|james|anna|peter|paul|maria|thomas|david|michael|sarah|laura|marie|hans|jean|jose|carlos|luis|ana|pierre)\b"
_CUES = r"(?i)(mail|contact|call|tel|phone|fax|mobile|whatsapp|card|visa|credit|account|host|server|address|from|name|dear|signed)[^\p{L}\p{N}]*$"
_NOT_CUES = r"(?i)(version|v|section|chapter|isbn|page|order|token|hash|id|no|build|release|figure|licen[cs]e)[^\p{L}\p{N}]*$"

_SECRET_CUES = r"(?i)(token|key|secret|password|passwd|pwd|credential|auth|bearer)[\"']?[\x20]{0,2}[:=]?[\x20]{0,2}[\"']?$"
_SECRET_NOT_CUES = r"(?i)(commit|revision|rev|checksum|digest|hash|md5|sha1|sha256|build|id)[\"']?[\x20]{0,2}[:=]?[\x20]{0,2}[\"']?$"

_SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,v_pattern:int,v_gazetteer:int,v_context:int,v_edges:int>>"


def _located(text: Column, pattern: str) -> Column:
    """Matches as array<struct<m, start, left, right>>: places in code points, text on both sides. Linear in the text."""
    empty = F.array().cast("array<struct<m:string,start:int,left:string,right:string>>")
    # A piece is the text before a match, and the match; the last has none.
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(m.alias("m"), F.length(gap).alias("gap"), F.right(gap, F.lit(24)).alias("left"), F.left(gap, F.lit(1)).alias("first")))

    def placed(v):
        ends = running_sums(F.transform(v, lambda x: x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0))))
        after = F.slice(F.transform(v, lambda x: x["first"]), F.lit(2), F.size(v))
        both = F.zip_with(F.zip_with(v, ends, lambda x, end: F.struct(x.alias("x"), end.alias("end"))), after, lambda y, right: F.struct(y["x"]["m"].alias("m"), (y["end"] - F.length(y["x"]["m"])).alias("start"), y["x"]["left"].alias("left"), right.alias("right")))
        return F.filter(both, lambda x: x["m"].isNotNull())

    return F.coalesce(let(pieces, placed), empty)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)

    def add(acc, i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 14) & (n <= 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "secret":
        return m.rlike("(?:[0-9][^0-9]*+){4}") & m.rlike("(?:[A-Za-z][^A-Za-z]*+){4}")
    return F.lit(True)


def _gazetteer(kind: str, m: Column) -> Column:
    yes = {
        "email": m.rlike(_TLDS), "email_masked": m.rlike(r"(?i)(com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$"), "ip": ~m.rlike(r"^0*(0|10|127|2[2-5][0-9])\."),
        "card": m.rlike("^[3-6]"), "phone": m.rlike(r"^\+[1-9]"), "phone_local": m.rlike(r"^\(?[2-9]"), "name": m.rlike(_NAMES),
        "card_like": m.rlike("^[3-6]"), "secret": m.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).*)$"),
    }[kind]
    return F.when(yes, 1).otherwise(0 if kind == "name" else -1)


def candidates(text: Column) -> Column:
    """All candidate spans of a text with their votes, by start and kind; null text has none."""
    t, all_ = F.coalesce(text, F.lit("")), []
    for kind in KINDS:
        gate = F.contains(t, F.lit(_GATES[kind])) if kind in _GATES else t.rlike(_SIGNS.get(kind, "[0-9]"))
        found = _located(t, PATTERNS[kind])
        all_.append(F.when(gate, F.transform(F.filter(found, _checks(kind)), _voter(kind))).otherwise(F.array().cast(_SPAN)))
    return F.concat(*all_)


def _checks(kind: str):
    return lambda x: _valid(kind, x["m"])


def _voter(kind: str):
    def vote(x):
        yes, no = (_SECRET_CUES, _SECRET_NOT_CUES) if kind == "secret" else (_CUES, _NOT_CUES)
        context = F.when(x["left"].rlike(yes), 1).when(x["left"].rlike(no), -1).otherwise(0)
        glued = x["left"].rlike(r"[\p{L}\p{N}_]$") | x["right"].rlike(r"^[\p{L}\p{N}_]")
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), F.lit(kind in BASE).alias("base"), F.lit(int(kind in BASE)).alias("v_pattern"), _gazetteer(kind, x["m"]).alias("v_gazetteer"), context.alias("v_context"), F.when(glued, -1).otherwise(1).alias("v_edges"))

    return vote


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple, float]:
    """Expectation-maximisation over vote patterns (kind, votes, n): the posterior of each pattern.

    Labelers are independent given the class, with class-conditional rates of their three votes
    (add-one smoothed); each kind has its own share of true spans. Starts from the votes' sum.
    """
    post = {(k, v): 1 / (1 + math.exp(-sum(v))) for k, v, _ in counts}
    for _ in range(rounds):
        share, seen = {}, {}
        rate = [{(j, x): 1.0 for j in range(len(VOTES)) for x in (-1, 0, 1)} for _ in range(2)]
        for k, v, n in counts:
            p = post[k, v]
            share[k], seen[k] = share.get(k, 1.0) + n * p, seen.get(k, 2.0) + n
            for j, x in enumerate(v):
                rate[0][j, x] += n * (1 - p)
                rate[1][j, x] += n * p
        for r in rate:
            for j in range(len(VOTES)):
                total = sum(r[j, x] for x in (-1, 0, 1))
                for x in (-1, 0, 1):
                    r[j, x] /= total
        for k, v, _ in counts:
            odds = math.log(share[k] / (seen[k] - share[k])) + sum(math.log(rate[1][j, x] / rate[0][j, x]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def train(counts: list[tuple[str, tuple[int, ...], int]], post: dict[tuple, float], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """Logistic span classifier on kind and votes, fitted to the posteriors (weights log1p of counts)."""
    bias, weight = dict.fromkeys(KINDS, 0.0), [0.0] * len(VOTES)
    total = sum(math.log1p(n) for _, _, n in counts) or 1.0
    for _ in range(steps):
        g_bias, g_weight = {k: decay * b for k, b in bias.items()}, [decay * w for w in weight]
        for k, v, n in counts:
            z = bias[k] + sum(w * x for w, x in zip(weight, v))
            d = math.log1p(n) / total * (1 / (1 + math.exp(-z)) - post[k, v])
            g_bias[k] += d
            for j, x in enumerate(v):
                g_weight[j] += d * x
        bias = {k: b - rate * g_bias[k] for k, b in bias.items()}
        weight = [w - rate * g for w, g in zip(weight, g_weight)]
    return {"bias": bias, "weight": weight}


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end, base, by start and kind) of every row.

    Places are code points, end exclusive. Loose candidates are kept if the classifier gives
    them 0.5 or more and they touch no base span. Null or empty text: no spans. Null ids stay
    null; repeated rows are each searched; other columns are ignored.
    """
    found = stage(docs.select(F.col(doc_id).alias("doc_id"), candidates(F.col(text)).alias("c")), "candidates")
    counts = found.select(F.explode("c").alias("x")).groupBy("x.kind", *[f"x.{v}" for v in VOTES]).agg(F.count("*").alias("n")).orderBy("kind", *VOTES).collect()
    counts = [(r["kind"], tuple(r[v] for v in VOTES), r["n"]) for r in counts]
    model = train(counts, estimate(counts))
    bias = F.create_map(*[x for k, b in model["bias"].items() for x in (F.lit(k), F.lit(b))])
    score = lambda x: bias[x["kind"]] + sum((x[v] * F.lit(w) for v, w in zip(VOTES, model["weight"])), F.lit(0.0))
    base = F.filter("c", lambda x: x["base"])
    extra = F.filter("c", lambda x: ~x["base"] & (score(x) >= 0) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    sort = F.sort_array(F.transform(F.concat(base, extra), lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("o"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"))))
    return found.select("doc_id", F.transform(sort, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))).alias("spans"))
