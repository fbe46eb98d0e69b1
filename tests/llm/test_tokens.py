"""Prefix counts and packing against the tokenizer library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm import packing as P
from quillmark.llm import prefix_tokens as T

PATH = T.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "b", "the ", "ing", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "é", "ß", "日", "😀", "1", "23", "!", "--", "<|endoftext|>", "<|", "|>", "\x1c", "\x85", " ", "\r\n", "\x00", "don't"]
texts = st.lists(st.sampled_from(PARTS), max_size=14).map("".join)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(texts)
def test_every_prefix(text):
    changes = T.counter(PATH).changes(text)
    assert np.cumsum(np.frombuffer(changes, np.int8), dtype=int).tolist() == [len(ids(text[:k])) for k in range(1, len(text) + 1)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(texts, st.text(max_size=60)))
def test_ids(text):
    assert P.encoding(PATH).encode(text, allowed_special="all") == ids(text)
    assert T._total(T.counter(PATH).changes(text)) == len(ids(text))


@pytest.mark.parametrize("text", [" " * 3_000_000, "\n" * 3_000_000, "x" + " \n" * 1_500_000 + "y", "<|endoftext|>" + "\t " * 600_000 + "<|endoftext|> a" + " " * 1_200_000 + " b", "a" * 3_000_000, "word and 12 " * 200_000], ids=range(6))
def test_ids_of_very_long_texts(text):
    assert P.token_ids(PATH, text).tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_with_runs_cut_out(text):
    import re

    runs, long = P._RUNS, P.LONG_RUN
    P._RUNS, P.LONG_RUN = re.compile(f"[{P.WHITE}]{{2,}}"), 0
    try:
        assert P.token_ids(PATH, text).tolist() == ids(text)
    finally:
        P._RUNS, P.LONG_RUN = runs, long


def test_clashing_names_and_long_texts(spark):
    long = "one two  three " * 100_000
    df = spark.createDataFrame([("a", long, 5, "z"), ("b", None, 6, "y"), (None, "", 7, "x")], "doc_id string, text string, N_Tokens int, n_bytes string")
    got = T.with_prefix_counts(df)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "prefix_changes"]
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()} == {("a", len(long), len(ids(long))), ("b", 0, 0), (None, 0, 0)}
    own = T.with_prefix_counts(df, names=("text", "n_tokens", None))
    assert {(r["text"], r["n_tokens"]) for r in own.collect()} == {(len(long), len(ids(long))), (0, 0)}


def test_questions(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat.", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, n_tokens_ string")
    got = T.with_prefix_counts(df).withColumn("at", T.tokens_at(F.col("prefix_changes"), F.lit(7))).withColumn("fit", T.chars_within(F.col("prefix_changes"), 2)).orderBy("doc_id").collect()
    text = got[0]["text"]
    assert got[0]["n_tokens"] == len(ids(text)) and got[0]["at"] == len(ids(text[:7]))
    assert got[0]["fit"] == max(k for k in range(len(text) + 1) if len(ids(text[:k])) <= 2)
    assert [(r["n_bytes"], r["n_tokens"], r["at"], r["fit"]) for r in got[1:]] == [(0, 0, 0, 0)] * 2


def check_pieces(pieces, docs, window=1024):
    """Pieces give back every document, sequences have no gaps; returns padding."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for i, rows in by_doc.items():
        want, at = np.array([*ids(docs[i] or ""), 0], "<u4"), 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        padding += 0 if not at & (at - 1) else window - at
    return padding


def test_packing(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert check_pieces(P.query(spark, data).collect(), {r[0]: r[1] for r in rows}) == 0


def test_packing_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_TOKENS", 3000)
    docs = {1: None, 2: "", 3: "word " * 5000, 4: "<|endoftext|> x", **{i: "some words here " * (i % 90) for i in range(5, 90)}}
    df = spark.createDataFrame([(k, v, k) for k, v in docs.items()], "doc_id long, text string, length long").repartition(3)
    assert check_pieces(P.digest(P.pack(df)).collect(), docs) == 0
    assert P.pack(df.limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=120))
def test_block(lengths):
    b = P.Block(64)
    for i, n in enumerate(lengths):
        b.add(i, 0, np.arange(n, dtype=np.uint32))
    seen = {}
    for s in b.sequences():
        size = sum(len(x[2]) for x in s)
        assert size == 64 or not size & (size - 1)
        for doc, start, part in s:
            seen.setdefault(doc, []).append((start, part))
    for i, n in enumerate(lengths):
        parts = sorted(seen[i], key=lambda x: x[0])
        assert np.concatenate([p for _, p in parts]).tolist() == list(range(n))


def exact_least_squares(a, b):
    """The minimum of |a x - b|^2 over x >= 0 by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    free, x = np.zeros(n, bool), np.zeros(n)
    while True:
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if free.all() or w.max() < 1e-9:
            return float(((a @ x - b) ** 2).sum())
        free[np.argmax(w)] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 1e-12:
                break
            bad = free & (s <= 1e-12)
            x += (x[bad] / (x[bad] - s[bad])).min() * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s


@pytest.mark.parametrize("seed", range(6))
def test_least_squares_against_exact_ones(seed):
    rng = np.random.default_rng(seed)
    window = 24
    h = np.concatenate([[0], rng.integers(0, 60, window - 1) * (rng.random(window - 1) < 0.7), [0]]).astype(int)
    columns, _ = P.solve(h, window)
    a = np.zeros((window + 1, len(columns)))
    for j, c in enumerate(columns):
        np.add.at(a[:, j], c[c > 0], 1)
    least = exact_least_squares(a, h.astype(float))
    left = [float(((a @ P.solve(h, window, t)[1] - h) ** 2).sum()) for t in (P.TOLERANCE, 1e-9)]
    assert left[1] == pytest.approx(least, abs=1e-3) and least - 1e-6 <= left[0] <= 1.02 * least + P.TOLERANCE * len(columns)


def test_squares_are_small():
    h = np.zeros(1025, int)
    h[[512, 300, 724]] = [40, 10, 10]
    columns, repeats = P.solve(h, 1024)
    used = np.zeros(1025)
    for c, r in zip(columns, repeats):
        for x in c:
            used[x] += r
    assert np.abs(used[1:] - h[1:]).max() < 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_vocabulary(name):
    v = T.Vocabulary(T.tokenizer_path(name))
    assert all(v.stable(v.tokens[b"x"], v.tokens[b" y"]) for _ in range(1)) and not v.stable(v.tokens[b"t"], v.tokens[b"h"])
