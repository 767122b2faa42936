"""Plain Python versions of operators, one document at a time, that tests hold results against."""

import collections
import math
import re
import zlib

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
COMMON = set("the of and to in is that it for was on as with by be this are or an at from le la les de des et un une du en que qui pour dans il est der die das und zu den von ist mit im ein eine dem auf el los las y del se con por para lo".split())


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# quality rules


def measures(text):
    text = text or ""
    w = SPACE.findall(text)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(runs)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return {
        "words": len(w),
        "chars": sum(map(len, w)),
        "symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "upper": len(re.findall("[A-Z]", text)),
        "shouts": text.count("!"),
        "letters": sum(c.isalpha() for c in text),
        "common": sum(x in COMMON for x in w),
        "ends": sum(x.endswith(".") for x in w),
        "lines": len(lines),
        "dup": len(lines) - len(set(lines)),
        "repeat": len({i + j for i, x in enumerate(runs) if often[x] > 1 for j in range(3)}),
    }


def failed(m):
    return m["words"] < 50 or 100 * m["repeat"] > 50 * m["words"]


def votes(m):
    n, c = m["words"], m["chars"]
    rules = [
        (m["symbols"] > 0.1 * n, m["symbols"] <= 0.01 * n),
        (m["upper"] > 0.3 * c or m["shouts"] > 0.1 * n, m["upper"] <= 0.1 * c and m["shouts"] <= 0.01 * n),
        (m["repeat"] > 0.3 * n, m["repeat"] <= 0.1 * n),
        (m["lines"] > 3 and m["dup"] > 0.5 * m["lines"], m["lines"] > 3 and m["dup"] == 0),
        (c > 12 * n or c < 3 * n, 3.5 * n <= c <= 9 * n),
        (m["letters"] < 0.85 * c, m["letters"] >= 0.93 * c),
        (m["common"] < 0.04 * n, m["common"] >= 0.1 * n),
        (m["ends"] < 0.01 * n or m["ends"] > 0.5 * n, 0.03 * n <= m["ends"] <= 0.3 * n),
    ]
    return [-1 if bad else 1 if good else 0 for bad, good in rules]


def posteriors(rows, rounds=200):
    """P(good) of each row of votes, by expectation-maximisation over rows."""
    k = len(rows[0])
    right = {True: [0.9] * k, False: [0.1] * k}  # share of good votes by class
    prior = 0.8
    for _ in range(rounds):
        share = []
        for r in rows:
            a, b = prior, 1 - prior
            for j, v in enumerate(r):
                if v:
                    a *= right[True][j] if v > 0 else 1 - right[True][j]
                    b *= right[False][j] if v > 0 else 1 - right[False][j]
            share.append(a / (a + b))
        last = share
        mass = sum(share)
        prior = (mass + 1) / (len(rows) + 2)
        for good in (True, False):
            part = share if good else [1 - s for s in share]
            for j in range(k):
                up = sum(p for p, r in zip(part, rows, strict=True) if r[j] > 0) + 1
                down = sum(p for p, r in zip(part, rows, strict=True) if r[j] < 0) + 1
                right[good][j] = up / (up + down)
    return last, prior, right


def kept_by_quality(docs):
    ms = [measures(t) for _, t in docs]
    ok = [i for i, m in enumerate(ms) if not failed(m)]
    if not ok:
        return []
    _, prior, right = posteriors([votes(ms[i]) for i in ok])
    out = []
    for i in ok:
        odds = math.log(prior / (1 - prior))
        for j, v in enumerate(votes(ms[i])):
            if v > 0:
                odds += math.log(right[True][j] / right[False][j])
            elif v < 0:
                odds += math.log((1 - right[True][j]) / (1 - right[False][j]))
        if odds >= 0:
            out.append(docs[i])
    return out


# line dedup


def key(i):
    return float("inf") if i is None else i


def without_repeated_lines(docs, n=3):
    full = [[x for x in (t or "").split("\n") if SPACE.search(x)] for _, t in docs]
    where = collections.defaultdict(set)
    for k, (i, _) in enumerate(docs):
        for p in range(len(full[k]) - n + 1):
            where[tuple(full[k][p : p + n])].add((key(i), k, p))
    out = []
    for k, (i, t) in enumerate(docs):
        gone = {p + j for p in range(len(full[k]) - n + 1) for j in range(n) if any(a < key(i) or (m == k and q < p) for a, m, q in where[tuple(full[k][p : p + n])])}
        left, at = [], 0
        for x in (t or "").split("\n"):
            if SPACE.search(x):
                at += 1
                if at - 1 in gone:
                    continue
            left.append(x)
        if SPACE.search("\n".join(left)):
            out.append((i, "\n".join(left)))
    return out


# near duplicates


def shingles(text, n=5):
    w = SPACE.findall(low(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(sets):
    label = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while True:
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return label


def one_of_each(docs):
    """The smallest id of each component; a repeated id is one document, rows without an id stay."""
    label = components([shingles(t) for _, t in docs])
    least = {}
    for c, (i, _) in zip(label, docs, strict=True):
        least[c] = min(least.get(c, float("inf")), key(i))
    out, seen = [], set()
    for c, (i, t) in zip(label, docs, strict=True):
        if i is None or (i == least[c] and i not in seen):
            out.append((i, t))
            seen.add(i)
    return out


# decontamination


def clean_of(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    parts = set()
    for t in items:
        w = split(t)
        n = min(window, len(w))
        parts |= {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if n else set()
    sizes = {len(p) for p in parts}
    held = lambda w: any(tuple(w[p : p + n]) in parts for n in sizes for p in range(len(w) - n + 1))
    return [(i, t) for i, t in docs if not held(split(t))]


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_W = r" \t\n\x0B\f\r"
_NUMBER = rf"[(+]*+[0-9][0-9()./+-]*+(?![^{_W},;:!?\"'])"
_INSTANCE = re.compile(rf"(?<![^{_W}])(?:{_NUMBER}(?: {_NUMBER})*+|[^{_W}0-9@]*+[0-9@][^{_W}]*+)")
_EDGES = "\"'`()[]{}<>.,;:!?*#$%&|="


def base_spans(text):
    """(start, order, end, kind) of the base patterns."""
    out = []
    for o, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), o, m.end(), kind))
    return sorted(out)


def _instances(text):
    """(start, end, value, patterns)."""
    found, out = list(_INSTANCE.finditer(text)), []
    tidy = lambda x: re.sub(rf"[{_W}]+", " ", x.lower()).strip(" ")
    for i, m in enumerate(found):
        core = m[0].lstrip(_EDGES)
        start = m.end() - len(core)
        core = core.rstrip(_EDGES)
        if not core:
            continue
        before = tidy(("# " if i else "") + text[found[i - 1].end() if i else 0 : m.start()]).split(" ")
        after = tidy(text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]).split(" ")
        patterns = ["L " + " ".join(before[-2:])] if len(before) > 1 else []
        if before[-1]:
            patterns.append(f"M {before[-1]} _ {after[0] or '#'}")
        out.append((start, start + len(core), core, patterns))
    return out


def discovered(texts, rounds=3, support=3, confidence=0.8):
    """For each text the (start, order, end) of secrets and of what trusted patterns discover."""
    unit = 1_000_000
    seen, forms = [], {}
    for row, t in enumerate(texts):
        base = base_spans(t)
        for start, end, value, patterns in _instances(t or ""):
            over = [(e, o) for s, o, e, _ in base if s <= start and e > start]
            later = [(s, o) for s, o, e, _ in base if start <= s < end]
            kind = max(over)[1] if over else min(later)[1] if later else None
            hit = kind is not None
            unsure = False
            if re.fullmatch(r"(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,}", value):
                unsure = zlib.crc32(value.encode()) % 4 > 0
                kind = 4 if kind is None and not unsure else kind
            seen.append((row, start, end, value, patterns, hit, kind))
            forms[value] = unsure
    known = {}
    for _, _, _, value, _, _, kind in seen:
        if kind is not None:
            known[value] = min(kind, known.get(value, 9))
    edges = {(p, value) for _, _, _, value, patterns, _, _ in seen for p in patterns}
    unsure = {v for v, x in forms.items() if x and v not in known}
    size = collections.Counter(p for p, v in edges if v not in unsure)
    belief, good = {v: (k, unit) for v, k in known.items()}, {}
    for _ in range(rounds):
        mass = collections.defaultdict(lambda: [0, 0, 0])
        for p, v in edges:
            if v in belief:
                k, b = belief[v]
                mass[p, k][0] += b
                mass[p, k][1] += 1
                mass[p, k][2] += v in unsure
        good = {p: (b // (size[p] + u), -k) for (p, k), (b, s, u) in mass.items() if b // (size[p] + u) >= round(confidence * unit) and s >= support}
        belief = {v: (k, unit) for v, k in known.items()}
        best = {}
        for p, v in edges:
            if v not in known and p in good:
                best[v] = max(best.get(v, good[p]), good[p])
        belief |= {v: (-k, score) for v, (score, k) in best.items()}
    out = [set() for _ in texts]
    for row, start, end, _, patterns, hit, kind in seen:
        trusted = [good[p] for p in patterns if p in good and (kind is None or (kind == 4 and not hit and good[p][1] == -4))]
        if trusted and (kind is None or kind == 4):
            out[row].add((start, -max(trusted)[1], end))
    return [sorted(x) for x in out]
