"""Plain versions of what the operators compute, written from the contracts alone."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def secrets(text):
    text, out = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    kinds = ("assign", "access", "hex")
    spans = [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(out)]
    return (*(sum(k == i for _, k, _ in out) for i in range(3)), sha(spans))


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal(text):
    text = text or ""
    emails = [*re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    ips = [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    cards = [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    phones = [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    found = [("email", emails), ("ip", ips), ("card", cards), ("phone", phones)]
    return (*(len(ms) for _, ms in found), sha([f"{k}:{m.start()}:{m.end()}" for k, ms in found for m in ms]))


def counting_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def jaccard_components(rows, k, percent):
    """{doc_id: (set size, component)} of (doc_id, text)."""
    sets, home, known = {}, {}, defaultdict(list)
    for i, text in rows:
        sets[i] = shingles(text, k)
        home[i] = i

    def top(i):
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for i in sorted(sets):
        near = Counter(j for s in sets[i] for j in known[s])
        for j, both in near.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                home[b] = a
        for s in sets[i]:
            known[s].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def without_repeats(rows, length):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of (doc_id, text)."""
    docs = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(d[p : p + length] for _, d in docs for p in range(len(d) - length + 1))
    out = {}
    for i, d in docs:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if times[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest())
    return out


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: target} of {source: size}, by giving out the excess of capped sources round after round."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if s in over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    return target
