"""Plain-Python forms of the ten operators' contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def unigram(docs):
    """doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)."""
    toks = {i: [*WORD.findall(lower(t)), None] for i, t in docs}
    c = Counter(w for i, ws in toks.items() if crc(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (crc(i, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks.items()}


def shingles(text, k):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def components(docs, k, num, den):
    """doc_id: (n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    seen = set()
    for ids in at.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def luhn(d):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def personal(text):
    text, out = text or "", []
    for kind, rx in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], ("email", "ip", "card", "phone").index(x[0])))


def personal_row(text):
    found = personal(text)
    n = Counter(k for k, _, _ in found)
    return (*(n[k] for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest())


def kept(rows, h=0.75, steps=4, prior=50.0, cutoff=1e-6):
    """Verdicts of rows (lang, source, text) by minimum covariance determinants with their language's and all documents' as priors."""
    import numpy as np

    floor = np.array([0.5, 0.1, 0.5, 0.8, 0.8])
    p, stats, vecs = len(floor), [statistics(t) for _, _, t in rows], []
    for w, chars, symbols, dup, rep in stats:
        vecs.append([math.log1p(w), math.log((chars + 1) / (w + 1)), math.log1p(100 * symbols / (w + 1)), math.log1p(dup), math.log1p(100 * rep / (w + 1))])
    vecs, failed = np.array(vecs), np.array([w < 10 or 100 * rep > 20 * w for w, *_, rep in stats])
    groups = {}
    for k, (lang, source, _) in enumerate(rows):
        if not failed[k]:
            for g in ((), (lang,), (lang, source)):
                groups.setdefault(g, []).append(k)
    levels = sorted(groups, key=len)

    def shrink(own):
        out = {}
        for g in levels:
            n, a = own[g]
            out[g] = (n * a + prior * out[g[:-1]]) / (n + prior) if g else a
        return out

    def middle(x):
        bins = np.sort(np.floor(x * 128).astype(int), axis=0)
        return (bins[math.ceil(len(x) / 2) - 1] + 0.5) / 128

    def factor(mean, cov):
        low = np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                s = cov[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = math.sqrt(max(s + floor[i] ** 2, floor[i] ** 2)) if i == j else s / low[j, j]
        return mean, low

    far = lambda x, shape: (np.linalg.solve(shape[1], (x - shape[0]).T) ** 2).sum(axis=0)
    med = shrink({g: (len(k), middle(vecs[k])) for g, k in groups.items()})
    mad = shrink({g: (len(k), middle(np.abs(vecs[k] - med[g])) * 1.4826) for g, k in groups.items()})
    scale = {g: np.maximum(mad[g], floor) for g in groups}
    sign = {}
    for g, k in groups.items():
        z = (vecs[k] - med[g]) / scale[g]
        z = z / np.sqrt(np.maximum((z * z).sum(axis=1), 1e-9))[:, None]
        sign[g] = (len(k), z.T @ z / len(k))
    sign = shrink(sign)
    shapes = [{g: factor(med[g], np.eye(p) * np.outer(scale[g], scale[g])) for g in groups}, {g: factor(med[g], sign[g] * p * np.outer(scale[g], scale[g])) for g in groups}]
    for s, shape in enumerate(shapes):
        for _ in range(steps):
            means = {}
            for g, k in groups.items():
                x = vecs[k]
                bins = np.floor(np.log2(far(x, shape[g]) + 2.0**-20) * 64)
                rank = np.searchsorted(np.sort(bins), bins)
                x = x[rank < h * len(x)]
                means[g] = (len(x), np.concatenate([x.mean(axis=0), (x.T @ x / len(x)).ravel()]))
            means = shrink(means)
            shape = {g: factor(m[:p], m[p:].reshape(p, p) - np.outer(m[:p], m[:p])) for g, m in means.items()}
        shapes[s] = shape
    from editscan.llm.quality import chi2_cdf, chi2_quantile

    grow, out = math.sqrt(h / chi2_cdf(chi2_quantile(h, p), p + 2)), []
    for k, (lang, source, _) in enumerate(rows):
        if failed[k]:
            out.append((False, None))
            continue
        shape = min((s[lang, source] for s in shapes), key=lambda s: 2 * np.log(np.diag(s[1])).sum())
        d2 = far(vecs[k : k + 1], (shape[0], shape[1] * grow))[0]
        out.append((bool(d2 <= chi2_quantile(1 - cutoff, p)), d2))
    return out


def languages(train, docs, longest=4, max_words=30_000, max_grams=15_000):
    """(language, score) of each text of docs, learned from (lang, text) pairs: of words and n-grams seen twice the most frequent of each language are known."""
    edge = re.compile(r"^[\W\d_]+|[\W\d_]+$")
    clean = lambda t: [w for w in (edge.sub("", w.lower()) for w in WORD.findall(t)) if w]
    names = sorted({k for k, t in train if k is not None and t is not None})
    words, grams = {k: Counter() for k in names}, {k: Counter() for k in names}
    cut = lambda w, g: [f"^{w}$"[i : i + g] for i in range(len(w) + 3 - g)]
    for k, t in train:
        for w in clean(t or "") if k is not None else ():
            words[k][w] += 1
            for g in range(1, longest + 1):
                grams[k].update(cut(w, g))

    def table(counts, most):
        total = sum(counts.values(), Counter())
        often = {k: sorted((-n, x) for x, n in c.items() if total[x] > 1)[:most] for k, c in counts.items()}
        known = {x for top in often.values() for _, x in top}
        size = {k: sum(n for x, n in c.items() if x in known) for k, c in counts.items()}
        return known, lambda x: [math.log((counts[k][x] + 0.5) / (size[k] + 0.5 * (len(known) + 1))) for k in names]

    (known_words, word_logs), (known_grams, gram_logs) = table(words, max_words), table(grams, max_grams)
    out = []
    for t in docs:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        total = [0.0] * len(names)
        for w in clean(t):
            rows = [word_logs(w)] if w in known_words else []
            for g in range(longest, 0, -1):
                rows = rows or [gram_logs(x) for x in cut(w, g) if x in known_grams]
            if rows:
                logs = [sum(c) / len(rows) for c in zip(*rows)]
                total = [a + b - sum(logs) / len(logs) for a, b in zip(total, logs)]
        best = max(range(len(names)), key=lambda k: (total[k], -k))
        out.append((names[best], 1 / sum(math.exp(min(0.0, x - total[best])) for x in total)))
    return out
