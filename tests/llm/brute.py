"""Plain versions of the operators, written for clarity alone."""

import hashlib
import math
import re
import zlib
from collections import Counter

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(ASCII)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaks(docs, items, span=10):
    windows = []
    for item_id, text in items:
        w = terms(text)
        if item_id is not None and w:
            n = min(span, len(w))
            windows.append((str(item_id), n, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}))
    out = []
    for doc_id, text in docs:
        w = terms(text)
        hit, found = set(), set()
        for item, n, own in windows:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in own:
                    hit.update(range(i, i + n))
                    found.add(item)
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingles(text, size=4):
    w = spaced(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    seen = set()
    for group in where.values():
        for n, i in enumerate(group):
            for j in group[:n]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    common = len(sets[i] & sets[j])
                    if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                        root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(docs):
    out = []
    for doc_id, text in docs:
        w = terms(text)
        hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        out.append((doc_id, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    return out


def secrets(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        found = [
            ("assign", *m.span())
            for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A)
            if len(m[2]) >= 6
        ]
        found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        order = ("assign", "access", "hex")
        found.sort(key=lambda f: (f[1], order.index(f[0])))
        counts = [sum(f[0] == k for f in found) for k in order]
        out.append((doc_id, *counts, sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))))
    return out


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def pii(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        found += [("ip", *m.span()) for m in ips if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub(r"\D", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
        found += [("phone", *m.span()) for m in phones if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
        counts = [sum(f[0] == k for f in found) for k in ("email", "ip", "card", "phone")]
        out.append((doc_id, *counts, sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))))
    return out


def unigram(docs):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    tokens = [[*spaced(t), None] for _, t in docs]
    c = Counter(x for own, h in zip(tokens, held, strict=True) if not h for x in own)
    n, v = sum(c.values()), len(c)
    return [
        (d, h, len(own), sum(c[x] > 0 for x in own), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own))
        for (d, _), h, own in zip(docs, held, tokens, strict=True)
    ]


def ppm(texts, held, order=3):
    """Log10 probabilities by counts of every context, longest first, escape C, symbol exclusion."""
    counts = {}
    padded = [b"\xff" * order + (t or "").encode() + b"\xff" for t in texts]
    for p, h in zip(padded, held, strict=True):
        if not h:
            for i in range(order, len(p)):
                for k in range(order + 1):
                    counts.setdefault(p[i - k : i], Counter())[p[i]] += 1

    def log10(context, symbol):
        mass, seen = 1.0, set()
        for k in range(order, -1, -1):
            own = counts.get(context[order - k :])
            left = {s: c for s, c in own.items() if s not in seen} if own else {}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if symbol in left:
                return math.log10(mass * left[symbol] / whole)
            mass *= len(left) / whole
            seen |= set(left)
        return math.log10(mass / (256 - len(seen)))

    return [sum(log10(p[i - order : i], p[i]) for i in range(order, len(p))) for p in padded]
