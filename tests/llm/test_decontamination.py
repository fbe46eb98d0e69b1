"""Contained items against plain sets of shingles."""

import random
import re

from quillmark.llm import decontamination as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(t, n):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(t or "")]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}, len(w)


def brute(docs, items):
    out = set()
    for j, it in items:
        n = min(5, grams(it, 1)[1])
        if n:
            want = grams(it, n)[0]
            for i, t in docs:
                k = len(want & grams(t, n)[0])
                if k >= 0.8 * len(want) - 1e-9:
                    out.add((i, j, k, len(want)))
    return out


def test_contained(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["aa", "bb", "Cc", "dd"]) + str(rng.randrange(40)) for _ in range(n))
    items = [(j, text(n)) for j, n in enumerate([15, 15, 30, 59, 200, 4, 2, 1, 6])] + [(20, None), (21, ""), (22, "  ")]
    docs = [(i, text(rng.choice([0, 3, 50, 400]))) for i in range(40)]
    for k, (j, it) in enumerate(items[:9] * 3):
        w = it.split()
        for _ in range(k // 9):
            w[rng.randrange(len(w))] = "edit"
        host = docs[k % 40][1].split()
        docs.append((100 + k, " ".join(host[:20] + [x.upper() for x in w] + host[20:])))
    docs += [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1])]
    d = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, item_id long").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for size in (D.BLOCK_BYTES, 300):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = [(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in D.contained(d, b).collect()]
        assert set(got) == want and len(got) == len(want) + sum(1 for x in want if x[0] == 202)
        kept = D.clean(d, b)
        assert kept.columns == d.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {x[0] for x in want}
    assert D.contained(d.limit(0), b).count() == 0
    assert D.contained(d, b.limit(0)).count() == 0 and D.clean(d, b.limit(0)).count() == len(docs)


def test_no_class_misses_items_at_the_threshold():
    """Items of every class, found in documents with exactly enough of their shingles and not in ones with one fewer."""
    import pyarrow as pa

    for m in (1, 2, 5, 15, 16, 31, 32, 63, 64, 127, 128, 300, 1000):
        words = [f"w{m}x{k}" for k in range(m + 4)]
        least = -(-4 * m // 5)
        index = D.Index([" ".join(words), "other words that are in no document"], 5, 0.8)
        docs = ["before " + " ".join(words[a : a + n + 4]) + " after" for n in (least, least - 1) for a in (0, (m - n) // 2, m - n)]
        assert [(t, i, k, n) for t, i, k, n in index.search(pa.array(docs))] == [(t, 0, least, m) for t in range(3)], m


def test_text_ids_clashes_and_long_texts(spark):
    item = " ".join(f"k{k}" for k in range(40))
    docs = spark.createDataFrame([("a", "x y z " * 200_000 + item, 1.0), ("b", "nothing of it", 2.0)], "doc_id string, text string, containment double")
    items = spark.createDataFrame([("q", item)], "item_id string, text string")
    assert [tuple(r) for r in D.contained(docs, items).collect()] == [("a", "q", 36, 36, 1.0)]
    assert [r["doc_id"] for r in D.clean(docs, items).collect()] == ["b"]
