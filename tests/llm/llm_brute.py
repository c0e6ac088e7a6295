"""Plain versions of the operators for small inputs."""

import hashlib
import math
import re
import zlib


def removed(rows, length):
    """(doc_id, bytes, merged spans) in input order; rows of one id see each other as one document."""
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            if k not in first or (d, p) < first[k]:
                first[k] = (d, p)
    for d, b in data:
        spans = []
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (d, p):
                if spans and p <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], p + length)
                else:
                    spans.append((p, p + length))
        yield d, b, spans


def words13(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def contamination(text, items, window=13):
    w, hit, found = words13(text), set(), set()
    for item, t in items:
        iw = words13(t)
        m = min(window, len(iw))
        for j in range(len(iw) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == iw[j : j + m]:
                    hit.update(range(p, p + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)])


def components(rows):
    """{doc_id: smallest linked id} by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                p, q = find(d), find(e)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in sets}


KINDS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    out = []
    for k, (kind, p) in enumerate(KINDS.items()):
        for m in p.finditer(text or ""):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def media(text):
    b = (text or "").encode()
    payload = b + bytes((-len(b)) % 64 or (0 if b else 64))
    return len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def targets(sizes, weights=(3, 1, 2), share=1.5):
    """{source: target} by dealing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, got, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = total
    while left > 1e-9 and open_:
        weight = sum(w[s] for s in open_)
        give = {s: left * w[s] / weight for s in open_}
        left = 0.0
        for s, g in give.items():
            got[s] += g
            if got[s] >= 2 * sizes[s]:
                left += got[s] - 2 * sizes[s]
                got[s] = 2.0 * sizes[s]
                open_.discard(s)
    return got


def tree(pages, gamma, least, threshold):
    """{host: nodes to remove} from [(host, shapes, blocks)]; shapes as (node, children), blocks as (leaf, text)."""
    out = {}
    for host in {h for h, _, _ in pages}:
        mine = [(s, b) for h, s, b in pages if h == host]
        on = {}
        for i, (shapes, blocks) in enumerate(mine):
            for n, *_ in [*shapes, *blocks]:
                on.setdefault(n, set()).add(i)
        score, most = {}, {}

        def entropy(counts, m):
            total = sum(counts)
            return min(1.0, -sum(c / total * math.log(c / total) for c in counts) / math.log(m)) if m > 1 else 1.0

        def visit(node):
            if node in score:
                return
            m = len(on[node])
            texts, kinds, parts = {}, {}, []
            for shapes, blocks in mine:
                for t in {t for n, t in blocks if n == node}:
                    texts[t] = texts.get(t, 0) + 1
                for k in {k for n, k in shapes if n == node}:
                    kinds[k] = kinds.get(k, 0) + 1
                parts += [k for n, k in shapes if n == node]
            if texts:
                score[node] = most[node] = max(0.0, 1 - sum(math.log(c) / math.log(m) for c in texts.values()) / len(texts)) if m > 1 else 1.0
                return
            weight = {}
            for kids in parts:
                for k in kids:
                    visit(k)
                    weight[k] = weight.get(k, 0) + 1 / len(kids)
            keep = gamma ** len(kinds)
            score[node] = (1 - keep) * entropy(list(kinds.values()), m) + keep * sum(w * score[k] for k, w in weight.items()) / sum(weight.values())
            most[node] = max(score[node], *[most[k] for k in weight])

        for n in on:
            visit(n)
        out[host] = {n for n in on if n and len(on[n]) >= least and most[n] < threshold * score[0]} if on else set()
    return out
