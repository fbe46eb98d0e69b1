"""Components against all pairs compared in plain Python."""

import random
import re

import pytest

from quillmark.llm import near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n, num, den):
    """{id: (set size, component)} with every pair compared."""
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((top(a), top(b)))
                comp[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed):
    """Chains of edits, groups of copies, texts around the threshold and odd ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(rng.choice([1, 2, 9, 30])):
            rows.append((at, " ".join(base)))
            at += 1
            if rng.random() < 0.7 and base:
                base = list(base)
                for _ in range(rng.choice([1, 1, 2, 5])):
                    base[rng.randrange(len(base))] = rng.choice(words)
    rows += [(at, None), (at + 1, ""), (at + 2, " \n\t"), (at + 3, "Hi"), (at + 4, "hI"), (at + 5, "É a"), (at + 6, "é A"), (at + 7, "x " * 30000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "small", "block", "sim"), [(1, 16, 256, N.QUERY), (2, 2, 3, N.QUERY), (3, 4, 8, N.Similarity())])
def test_components(spark, monkeypatch, seed, small, block, sim):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, i, "sig") for i, t in rows], "doc_id long, text string, id long, sig string").repartition(4)
    got = N.near_duplicates(df, sim).collect()
    want = brute(rows, sim.words, sim.num, sim.den)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in N.near_duplicates(df, N.QUERY).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert N.near_duplicates(df.limit(0), N.QUERY).count() == 0
    assert N.one_of_each(df, N.QUERY).count() == 3


def test_one_id_with_two_texts(spark):
    """A document is linked by each of its texts, also where another stands for its class."""
    x, y = "a b c d e f g", "q r s t u v w"
    df = spark.createDataFrame([(3, x), (5, x), (5, y), (7, y), (9, "other words are here")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in N.near_duplicates(df, N.QUERY).collect()} == {(3, 3), (5, 3), (7, 3), (9, 9)}


@pytest.mark.parametrize("block", [512, 3])
def test_ids_as_text_and_long_texts(spark, monkeypatch, block):
    monkeypatch.setattr(N, "SMALL", 2)
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus(4)
    long = " ".join(f"v{k % 7919}" for k in range(400_000))
    rows += [(1000, long), (1001, long + " end"), (1002, "other " + long)]
    assert len(long) > 1 << 20
    df = spark.createDataFrame([(f"k{i:04}", t, "x") for i, t in rows], "doc_id string, text string, component_id string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df, N.QUERY).collect()}
    assert got == {f"k{i:04}": (n, f"k{c:04}") for i, (n, c) in brute(rows, 3, 85, 100).items()}
    assert N.one_of_each(df, N.QUERY).count() == sum(f"k{c:04}" == i for i, (_, c) in ((i, (0, int(v[1][1:]))) for i, v in got.items()))


def test_pruning_keeps_links():
    """A pair at the threshold is dropped with about the chosen probability only."""
    from math import comb

    sim = N.QUERY
    t = sim.num / sim.den
    for n, least in sim.least_matches:
        assert sum(comb(n, m) * t**m * (1 - t) ** (n - m) for m in range(least)) < 10 * sim.miss
    assert (1 - t**sim.rows) ** sim.bands <= sim.band_miss
    with pytest.raises(ValueError):
        N.Similarity(num=30)
