"""Modified Kneser-Ney over three words, token by token, to test against."""

import re
import zlib
from collections import Counter, defaultdict
from math import log10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def toks(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def discounts(values):
    n = [sum(1 for v in values if v == k) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return [0.0] + [min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(d, 1)]


def scores(rows):
    """{doc_id: (held_out, n_tokens, n_known, N, base, score)} of (doc_id, text) rows."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    uni, tri, start = Counter(), Counter(), "<s>"
    for i, t in rows:
        if not held[i]:
            u = v = (start,)
            for w in toks(t):
                uni[w] += 1
                tri[u, v, w] += 1
                u, v = v, (w, 1)
    bi = Counter((v, w) for _, v, w in tri)
    before = Counter(w for _, w in bi)
    after3, after2 = defaultdict(list), defaultdict(list)
    for (u, v, w), n in tri.items():
        after3[u, v].append(n)
    for (v, w), n in bi.items():
        after2[v].append(n)
    d3, d2, d1 = (discounts(x.values()) for x in (tri, bi, before))
    total, size, kinds = sum(uni.values()), len(uni), sum(before.values())
    rest = sum(d1[min(n, 3)] for n in before.values()) / max(kinds, 1) if kinds else 1.0

    def order(c, found, d, lower):
        if not found:
            return lower
        s = sum(found)
        return max(c - d[min(c, 3)], 0) / s + sum(d[min(n, 3)] for n in found) / s * lower

    out = {}
    for i, t in rows:
        u = v = (start,)
        base = score = 0.0
        words = toks(t)
        for w in words:
            base += log10((uni[w] + 1) / (total + size + 1))
            p = max(before[w] - d1[min(before[w], 3)], 0) / max(kinds, 1) + rest / (size + 1)
            p = order(bi[v, w], after2.get(v), d2, p)
            score += log10(order(tri[u, v, w], after3.get((u, v)), d3, p))
            u, v = v, (w, 1)
        out[i] = (held[i], len(words), sum(uni[w] > 0 for w in words), total, base, score)
    return out
