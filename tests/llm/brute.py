"""Plain versions of the operators on lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict
from math import log, log2

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BIG = 1 << 63


class Sets:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def jaccard(rows, size, percent):
    """Counter of (doc_id, n, component)."""
    sets, joined = [shingles(t, size) for _, t in rows], Sets()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                joined.join(i, j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[joined.find(i)].append(i)
    out, kept = Counter(), 0
    for members in groups.values():
        least = min(BIG if rows[i][0] is None else rows[i][0] for i in members)
        kept += 1
        for i in members:
            out[rows[i][0], len(sets[i]), None if least == BIG else least] += 1
    return out, kept


def removal(rows, length):
    """Results by (id, text); rows equal in both are one document."""
    from heirflow.llm import suffixes  # noqa: F401

    seen, out = set(), {}
    for key, data in rows:
        if (key, data) in out:
            continue
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            piece = data[k : k + length]
            if piece in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(piece)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key, data] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def leaks(rows, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for key, text in items:
        words = word.findall((text or "").translate(UPPER))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[k : k + size])].add("" if key is None else str(key))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in rows:
        words, hit, found = word.findall((text or "").translate(UPPER)), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(words[k : k + size])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(found), digest, bool(hit)))
    return out


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def entities(text, span):
    start, kind, stop = span
    name, value = PATTERNS[kind][0], text[start:stop].lower()
    digits = re.sub("[^0-9]", "", value)
    parts = {
        "email": [("email-name", value.split("@")[0]), ("email-domain", value.split("@")[-1])],
        "ip": [("ip-net", ".".join(value.split(".")[:3]))],
        "card": [("card-issuer", digits[:6])],
        "phone": [("phone-area", digits[:6])],
    }[name]
    return [f"{name}:{value}"] + [f"{a}:{b}" for a, b in parts]


def near(text, spans):
    """(kind, entity, term, context, start, end) of the eight words on each side of every span."""
    out, words = [], [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text or "")]
    for span in spans:
        start, kind, stop = span
        left = [(a, min(b, start)) for a, b in words if a < start][-8:]
        right = [(max(a, stop), b) for a, b in words if b > stop][:8]
        context = tuple(text[a:b].lower() for a, b in left + right)
        for a, b in left + right:
            if b - a >= 3 and not any(x < b and a < y for x, _, y in spans):
                out += [(PATTERNS[kind][0], e, text[a:b].lower(), context, a, b) for e in entities(text, span)]
    return out


def log_chance(k, n, share):
    if k <= n * share:
        return 0.0
    return -(k * log(k / (n * share)) + ((n - k) * log((n - k) / (n * (1 - share))) if n > k else 0.0))


def term_spans(rows, threshold=0.75):
    """Spans of disclosing terms of every (doc_id, text); rows equal in both are one document but count as rows."""
    found = [near(t, personal(t)) for _, t in rows]
    documents, contexts, holders, kinds, kind_terms = (defaultdict(set) for _ in range(5))
    for row, each in zip(rows, found):
        for kind, entity, term, context, _, _ in each:
            documents[entity, term].add(row)
            contexts[entity, term].add(context)
            holders[entity].add(row)
            kinds[kind].add(row)
            kind_terms[kind, term].add(row)
    df = Counter()
    for _, t in rows:
        df.update(set(re.findall(r"[^\W\d_]+", (t or "").lower())))
    chance, told = log(0.05 / max(1, len(documents))), {}
    for (entity, term), held in documents.items():
        k, both = min(len(held), len(contexts[entity, term])), len(held)
        kind = re.split("[-:]", entity)[0]
        ways = [(len(holders[entity]) / len(rows), df[term])]
        if entity.startswith(kind + "-"):
            ways.append((len(holders[entity]) / len(kinds[kind]), len(kind_terms[kind, term])))
        told[entity, term] = k >= 2 and all(
            share < 1 and log_chance(k, max(n, k), share) <= chance and 1 + log2(min(1, both / n)) / -log2(share) >= threshold
            for share, n in ways
        )
    return [sorted({(a, 4, b) for _, e, t, _, a, b in each if told[e, t]}) for each in found]
