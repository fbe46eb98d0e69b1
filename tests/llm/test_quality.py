"""Base rules against plain Python, probabilities that sum to one, verdicts and classifier on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import kneser_ney as kn
from quillmark.llm import quality_classifier as C
from quillmark.llm import quality_rules as R
from quillmark.llm import textops as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, cover = Counter(g), set()
    for i, x in enumerate(g):
        if n[x] > 1:
            cover.update(range(i, i + 8))
    return [len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(cover)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab \n#é日|\t"), max_size=80)), max_size=6), st.integers(1, 100))
def test_base(values, size):
    got = [r.tolist() for c in tx.chunks(pa.array(values, pa.string()), size) for r in R.base_features(c)]
    assert got == [brute_base(v) for v in values]


def brute_model(texts, order=4):
    """p(byte | bytes before) by the textbook: continuation counts below the highest order, discounts by counts of counts."""
    levels = {order: Counter()}
    for t in texts:
        raw = bytes(order - 1) + t.encode()
        levels[order].update(raw[i : i + order] for i in range(len(t.encode())))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    d, after = {}, {}
    for k, found in levels.items():
        n = [sum(v == c for v in found.values()) for c in (1, 2, 3, 4)]
        d[k] = kn.discounts(n)
        after[k] = {}
        for g, c in found.items():
            after[k].setdefault(g[:-1], []).append(c)

    def p(g):
        if not g:
            return 1 / 256
        k, lower = len(g), p(g[1:])
        seen = after[k].get(g[:-1])
        if not seen:
            return lower
        c = levels[k][g]
        return (max(c - d[k][min(c, 3)], 0) + sum(d[k][min(x, 3)] for x in seen) * lower) / sum(seen)

    return p


def perplexities(rows):
    by = {}
    for _, t, lang in rows:
        by.setdefault(lang or "", []).append(t or "")
    models, out = {k: brute_model(v) for k, v in by.items()}, []
    for _, t, lang in rows:
        raw = bytes(3) + (t or "").encode()
        logs = [math.log(models[lang or ""](raw[i : i + 4])) for i in range(len(raw) - 3)]
        out.append(-sum(logs) / len(logs) if logs else None)
    return out


def verdicts(rows, logs):
    """kept of each row, from its log perplexity, by sorting all values of a language."""
    base = [brute_base(t) for _, t, _ in rows]
    failed = [b[0] < 20 or 100 * b[4] > 30 * b[0] for b in base]
    size = [len((t or "").encode()) for _, t, _ in rows]
    names = [lang or "" for _, _, lang in rows]

    def bands(values, shares):
        def pick(of):
            v = sorted(round(values[i] / R.GRID) for i in of)
            return [v[max(0, math.ceil(s * len(v)) - 1)] * R.GRID if v else 0.0 for s in shares], len(v)

        used = [i for i in range(len(rows)) if not failed[i] and logs[i] is not None]
        whole = pick(used)[0]
        own = {x: pick([i for i in used if names[i] == x]) for x in set(names)}
        return {x: [(n * a + R.FEW * b) / (n + R.FEW) for a, b in zip(v, whole)] for x, (v, n) in own.items()}

    middle = bands(logs, [0.5])
    off = [None if v is None else (v - middle[x][0]) / math.sqrt(1 + R.NOISE_BYTES / max(n, 1)) for v, x, n in zip(logs, names, size)]
    quarter = bands(off, [0.25, 0.75])
    return [not f and v is not None and a - R.REACH * (b - a) <= v <= b + R.REACH * (b - a) for f, v, (a, b) in ((f, v, quarter[x]) for f, v, x in zip(failed, off, names))]


@pytest.mark.parametrize("shard_bytes", [R.SHARD_BYTES, 2000])
def test_perplexity_and_verdict_by_brute_force(spark, shard_bytes):
    rng = random.Random(5)
    words = {x: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(40)] for x, a in (("en", "etaoinsr"), ("fr", "éèauilmt"))}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(5, 60))), x) for i, x in enumerate(rng.choice(["en", "en", "fr"]) for _ in range(90))]
    rows += [(200 + i, "".join(rng.choice("#@!?Zq9 ") for _ in range(150)), x) for i, x in enumerate(["en", "fr", None, "xx", ""])]
    rows += [(300, None, "en"), (301, "", None), (302, "ab " * 60, "en"), (303, rows[0][1], "en"), (303, rows[0][1], "en")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, N_Words string").repartition(4)
    got = R.judge(R.measure(df, R.train(df, shard_bytes=shard_bytes))).collect()
    want = perplexities(rows)
    exact = {}
    for r, v, k in zip(rows, want, verdicts(rows, want)):
        exact.setdefault(r[0], []).append((v, k))
    assert len(got) == len(rows)
    for r in got:
        v, k = exact[r["doc_id"]][0]
        assert r["log_perplexity"] == (None if v is None else pytest.approx(v, abs=2e-6))
        assert r["kept"] == k
    assert {r["kept"] for r in got} == {True, False}


def test_one_very_long_text_and_names(spark):
    long = "plain words that go on and on, number after number. " * 25_000
    rows = [(f"k{i}", f"some text about {i} things and the words that come with it, again and again " * 3, "en") for i in range(40)] + [("long", long, "en"), (None, None, None)]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id string, text string, lang string, kept int, log_perplexity string")
    out = R.judge(R.measure(df, R.train(df)))
    assert out.columns.count("kept") == 1 and out.columns.count("log_perplexity") == 1
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 42 and got["long"]["n_bytes"] == len(long) and got["long"]["base_failed"]


def test_rules(spark):
    rng = random.Random(1)
    words = ["the", "cat", "sat", "on", "mat", "and", "dog", "ran", "far", "away", "home", "again"]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, text(), "en" if i % 3 else None) for i in range(240)]
    rows += [(900, " ".join(f"Q{i}%Zx{i * 7}#" for i in range(60)), "en"), (901, None, "en"), (902, "", None), (903, "cat " * 80, "en"), (904, "one two", "xx")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, q double")
    got = {r["doc_id"]: r for r in R.judge(R.measure(df, R.train(df))).collect()}
    assert len(got) == len(rows)
    assert not got[900]["kept"] and not got[900]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (901, 902, 903, 904))
    assert sum(got[i]["kept"] for i in range(240)) >= 235
    empty = df.limit(0)
    assert R.judge(R.measure(empty, R.train(empty))).count() == 0


def test_query_base(spark, data):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in R.query(spark, data).collect():
        b = brute_base(texts[r["doc_id"]])
        assert [r[c] for c in R.BASE] == b
        assert r["base_failed"] == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (r["kept"] and r["base_failed"])


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = C.query(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    m = got[got.held_out].merge(labels, on="doc_id")
    assert got.score.between(0, 1).all() and (m.predicted == m.quality).mean() > 0.93
    assert (m.predicted[m.quality == 1] == 1).mean() > 0.97


def test_scores_by_brute_force(spark, data):
    """Terms, projection and votes of each document, one by one, against all labelled vectors."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = C.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in C.score(docs.select("doc_id", "text"), model).collect()}
    unit = model.vectors.astype(float)
    sampled = model.labels.mean()
    for r in docs.select("doc_id", "text").limit(60).collect():
        raw = (r["text"] or "").encode()
        counts = Counter(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 20 for i in range(len(raw) - 2))
        words = WORD.findall(raw.decode())
        x = np.zeros(C.TERMS)
        for k, n in counts.items():
            x[k] = math.log1p(n) * model.weights[k]
        x[-1] = 0
        x /= max(np.linalg.norm(x), 1e-9)
        x[-1] = C.REPEATS * sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
        if not counts and not x[-1]:
            assert got[r["doc_id"]] == pytest.approx(model.share)
            continue
        q = x @ model.basis
        near = sorted(((float(v @ q) / max(np.linalg.norm(q), 1e-9), y) for v, y in zip(unit, model.labels)), reverse=True)[: C.NEIGHBOURS]
        one = sum(math.exp(C.SHARPNESS * (c - 1)) for c, y in near if y) * model.share / sampled
        zero = sum(math.exp(C.SHARPNESS * (c - 1)) for c, y in near if not y) * (1 - model.share) / (1 - sampled)
        assert got[r["doc_id"]] == pytest.approx(one / (one + zero), abs=0.02)


def test_classifier_with_text_ids_and_clashes(spark):
    rows = [(f"d{i}", "good plain words here " * 3 if i % 2 else "b@d $$$ ### " * 4, "x") for i in range(60)] + [("long", "good plain words here " * 60_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, Score string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)], "doc_id string, quality int")
    out = C.score(docs, C.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "score"]
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert min(got["d1"], got["long"]) > 0.7 > 0.3 > got["d2"]
    other = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert len(C.fit(docs, other).labels) == 0


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good plain words here " * 3 if i % 2 else "b@d $$$ ### " * 4, 0.5) for i in range(1, 60)] + [(60, None, 0.1), (61, "", 0.1), (62, "ab", 0.2)], "doc_id long, text string, y double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 1), (3, 7), (None, 1), (999, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in C.score(docs, C.fit(docs, labels)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and min(got[1], got[3]) > max(got[2], got[4])
    assert C.keep_good(docs, C.fit(docs, labels)).columns == docs.columns
    none = C.fit(docs, labels.limit(0))
    assert {r["score"] for r in C.score(docs, none).collect()} == {1.0}
    assert C.score(docs.limit(0), none).count() == 0
