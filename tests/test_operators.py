"""Merges, sinks, order and streams on small tables, empty ones among them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import merging as M
from quillmark.operators import models as O
from quillmark.operators import search as S
from quillmark.operators import survival as V
from quillmark.operators.ordering import global_position, running_total
from quillmark.sources import sinks, tables
from quillmark.streaming import incremental as I


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_positions_and_totals(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "g int, v int").repartition(5)
    got = {r["v"]: r["position"] for r in global_position(df, ["v"]).collect()}
    assert got == {i: i + 1 for i in range(100)}
    total = {r["g"]: r["s"] for r in running_total(df, "g", "v", "s").collect()}
    want, run = {}, 0
    for g in range(7):
        run += sum(i for i in range(100) if i % 7 == g)
        want[g] = run
    assert total == want
    assert running_total(df.limit(0), "g", "v", "s").count() == 0


def test_superseded(spark):
    docs = spark.createDataFrame([("10.1101/A", "x"), ("10.2/b", "x"), ("10.1101/A", "y")], "doi string, dataset string")
    versions = spark.createDataFrame([("10.1101/a", "10.2/B")], "preprint string, published string")
    assert rows(M.drop_superseded(docs, versions, "dataset")) == [("10.1101/A", "y"), ("10.2/b", "x")]
    assert rows(M.drop_superseded(docs, versions).select("doi", "dataset")) == [("10.2/b", "x")]


def test_error_never_replaces(spark):
    cur = spark.createDataFrame([(1, 1, False), (2, 1, True)], "k int, version int, bad boolean")
    new = spark.createDataFrame([(1, 2, True), (2, 2, True), (3, 2, False)], "k int, version int, bad boolean")
    assert rows(sinks.upserted(cur, new, ["k"], F.col("bad"), "version")) == [(1, 1, False), (2, 2, True), (3, 2, False)]


def test_json_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"count": 2, "results": [{"id": "x", "n": 1}, {"id": "y"}]}')
    (tmp_path / "b.json").write_text("not json")
    schema = spark.createDataFrame([], "id string, n int").schema
    assert rows(tables.wrapped_json(spark, str(tmp_path), schema).fillna(0)) == [("x", 1), ("y", 0)]
    (tmp_path / "ids.txt").write_text("# head\n a \n\nb\n")
    assert rows(tables.identifier_lines(spark, str(tmp_path / "ids.txt"))) == [("a",), ("b",)]
    (tmp_path / "o.json").write_text('{"_note": {"remove": []}, "d1": {"replace": ["p"]}}')
    assert [r["dataset_id"] for r in tables.overrides(spark, str(tmp_path / "o.json")).collect()] == ["d1"]


def test_search(spark):
    p = spark.createDataFrame([("10.1/A", "uses an archive"), ("10.1/a", "archive again"), (None, "archive"), ("10.2/b", "dogs archive")], "doi string, text string")
    assert rows(S.search(p, "text", ["archive"], ["dogs"]).select("doi")) == [("10.1/A",)]
    assert rows(S.by_term(p.where("doi is not null"), "text", ["dogs", "archive"]).select("doi", "term"))[-1] == ("10.2/b", "dogs")


def test_citing_after(spark):
    e = spark.createDataFrame([("a", "p", 1), ("b", "p", 1), ("c", "p", 1)], "citing string, cited string, dataset_id int")
    w = spark.createDataFrame([("a", dt.date(2020, 1, 1)), ("b", dt.date(2021, 1, 1))], "doi string, day date")
    c = spark.createDataFrame([(1, dt.date(2020, 1, 1))], "dataset_id int, made date")
    assert rows(S.citing_after(e, w, c).select("citing")) == [("b",)]
    assert rows(S.citing_after(e, w, c, inclusive=True, keep_undated=True).select("citing")) == [("a",), ("b",), ("c",)]


def test_cumulative_function_against_loops(spark):
    import random

    rng = random.Random(3)
    ends = [float(rng.randint(1, 40)) for _ in range(60)]
    events = [float(rng.randint(1, 45)) for _ in range(200)]
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "t double")
    got = {r["t"]: r["mcf"] for r in V.cumulative_function(frame(events), frame(ends)).collect()}
    run = 0.0
    for t in sorted(set(events)):
        n = sum(e >= t for e in ends)
        if n:
            run += events.count(t) / n
            assert got.pop(t) == pytest.approx(run)
    assert not got


def test_islands_and_restarts(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 100, 120), (1, 500, 510), (2, 0, 1)], "d int, a int, b int")
    assert rows(V.islands(df, ["d"], "a", "b", 200).select("d", "first", "last", "n")) == [(1, 0, 120, 2), (1, 500, 510, 1), (2, 0, 1, 1)]
    num = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 2, 3, 1, 2, 2])], "d int, o int, n int")
    assert [r["grp"] for r in V.restarts(num, ["d"], "o", "n").orderBy("o").collect()] == [0, 0, 0, 1, 1, 2]


def test_stream(spark, data, tmp_path):
    ev = spark.read.parquet(f"{data}/events.parquet")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = I.event_files(spark, str(tmp_path / "in"), ev, 1)
    q = I.windowed_counts(stream, "ts", ["event_type"], "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == ev.count()


def test_stream_upsert(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(1, i, i == 1), (2, i, False)], "k int, version int, bad boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    q = I.keep_upserted(I.event_files(spark, str(tmp_path / "in"), like, 1), str(tmp_path / "out"), ["k"], F.col("bad"), "version", str(tmp_path / "cp"))
    q.awaitTermination()
    last = max(int(p.name[1:]) for p in (tmp_path / "out").iterdir())
    assert rows(spark.read.parquet(str(tmp_path / "out" / f"v{last}"))) == [(1, 0, False), (2, 1, False)]


def test_word_overlap_of_whole_texts(spark, data):
    """Every pair against plain sets of words, also those whose words lie beyond a document's first 200 characters."""
    import re

    from quillmark.plans import QUERIES

    words = lambda t: {w for w in re.sub("[^a-z0-9]+", " ", t.lower()).split() if len(w) >= 4}
    items, docs = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("benchmark", "documents"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    want, late = {}, 0
    for r in items.select("item_id", "text").collect():
        w = words(r["text"] or "")
        for i, t in texts.items():
            if w and len(w & words(t)) / len(w) >= 0.5:
                want[r["item_id"], i] = round(len(w & words(t)) / len(w), 6)
                late += len(w & words(t[:200])) / len(w) < 0.5
    got = {(r["title_id"], r["name_id"]): r["share"] for r in QUERIES["q_word_overlap"](spark, data).collect()}
    assert got == want and late > 0


def test_quotes_from_everywhere(spark, data):
    """Texts of all languages and lengths, against the record of plain Python for each quote."""
    from quillmark.functions.quotes import records
    from quillmark.plans import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").collect()}
    got = {}
    for r in QUERIES["q_quotes_whole"](spark, data).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append((r["quote"], r["match_type"], r["offset"]))
    assert set(got) == {i for i, t in texts.items() if t}
    for i, rows in got.items():
        assert rows == [(x["quote"], x["match_type"], x["offset"]) for x in records([q for q, _, _ in rows], texts[i])]
        assert texts[i][:40] == rows[0][0] and any(q == texts[i][-40:] for q, _, _ in rows) and all(m != "not_found" for q, m, _ in rows if q in texts[i])
    assert {"exact", "case_insensitive", "spacing_insensitive", "punctuation_insensitive"} <= {m for rows in got.values() for _, m, _ in rows}


def test_short_texts_have_contexts(spark, data):
    from quillmark.plans import QUERIES

    short = {r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").where("char_length(text) <= 200").collect()}
    for name in ("q_contexts", "q_body_citations"):
        assert short & {r["doc_id"] for r in QUERIES[name](spark, data).collect()}, name


def test_smoothed_rate_against_plain_sums(spark):
    """Every event's increment under the kernel, at every place, in plain Python."""
    from math import erf, exp, pi, sqrt

    from quillmark.operators import survival as S

    ev, ob, width = [1.0, 2.5, 2.5, 6.0, 9.0, 14.0, 40.0], [3.0, 7.0, 8.0, 10.0, 12.0, 30.0], 1.5
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "t double")
    got = S.smoothed_rate(frame(ev), frame(ob), width).orderBy("t").collect()
    top, phi = max(ob), lambda u: 0.5 * (1 + erf(u / sqrt(2)))
    assert len(got) == 200 and got[-1]["t"] == pytest.approx(top)
    for i, r in enumerate(got):
        at = i * top / 199
        inside = max(phi((top - at) / width) - phi(-at / width), 1e-10)
        rate = var = 0.0
        for t in ev:
            n = sum(o >= t for o in ob)
            if n:
                w = exp(-0.5 * ((at - t) / width) ** 2) / (width * sqrt(2 * pi) * inside)
                rate, var = rate + w / n, var + (w / n) ** 2
        want = (rate, max(rate - 1.96 * sqrt(var), 0), rate + 1.96 * sqrt(var))
        assert (r["rate"], r["low"], r["high"]) == tuple(pytest.approx(x, abs=1e-12) for x in want)
    assert S.smoothed_rate(frame(ev), frame([]), width).count() == 0


def test_bootstraps_against_drawing_rows():
    """Draws of counts have the bounds that draws of single rows have."""
    rng = np.random.default_rng(0)
    delays, ends, at = rng.integers(1, 40, 150).astype(float), rng.integers(20, 60, 80).astype(float), np.linspace(0, 39, 100)
    curves = []
    for _ in range(600):
        e, t = np.sort(rng.choice(ends, len(ends))), np.sort(rng.choice(delays, len(delays)))
        risk = (e[None, :] >= t[:, None]).sum(axis=1)
        stop = len(t) if risk.all() else int(np.argmin(risk))
        total = np.cumsum(1 / risk[:stop])
        last = np.flatnonzero(np.append(t[1:stop] != t[: stop - 1], True))
        curves.append(np.interp(at, np.append(0, t[:stop][last]), np.append(0, total[last])))
    found = O.bootstrap_curve(np.unique(delays, return_counts=True), np.unique(ends, return_counts=True), at, 600)
    for q, got in zip((2.5, 97.5), found):
        want = np.percentile(curves, q, axis=0)
        assert np.abs(got - want).max() < 0.08 * max(1, want.max())
    counts = rng.negative_binomial(1.5, 0.3, 300)
    r, m = [], []
    for _ in range(2000):
        x = rng.choice(counts, len(counts))
        if x.var() > x.mean() > 0:
            m.append(x.mean())
            r.append(x.mean() ** 2 / (x.var() - x.mean()))
    got = O.bootstrap_nb(dict(zip(*(v.tolist() for v in np.unique(counts, return_counts=True)))))
    assert got["mean"] == pytest.approx(tuple(np.percentile(m, [2.5, 97.5])), rel=0.05) and got["r"] == pytest.approx(tuple(np.percentile(r, [2.5, 97.5])), rel=0.12)
    assert np.isnan(O.bootstrap_nb({3: 10})["r"]).all()


def test_growth_curves():
    t = np.linspace(0.1, 9, 80)
    for name, v in (("logistic", O.logistic(t, 900.0, 1.1, 4.0)), ("power", O.power_law(t, 12.0, 1.6)), ("richards", O.growth_richards(t, 700.0, 0.9, 3.0, 4.0))):
        v = v + 0.002 * v.max() * np.cos(37 * np.arange(80))
        found, p, _ = O.fit_curve(t, v, curves=O.GROWTH)
        curve = O.GROWTH[found][0]
        assert found == name and np.abs(curve(t, *p) - v).max() < 0.01 * v.max()
    assert O.fit_curve(np.array([1.0, 2.0]), np.array([2.0, 4.0]))[1].tolist() == [2.0, 1.0]
    assert O.fit_curve(np.array([1.0, 2.0, 3.0]), np.array([np.inf, 1.0, 2.0]), curves={"power": O.CURVES["power"]})[0] == "power"


def test_variance_equal_to_the_mean(spark):
    from quillmark.operators import survival as S

    df = spark.createDataFrame([(0,), (2,), (0,), (2,), (None,)], "k int")
    same = S.negative_binomial(df, "k").first()
    assert (same["n"], same["mean"], same["variance"], same["r"], same["p"]) == (4, 1.0, 1.0, None, None)
    more = S.negative_binomial(spark.createDataFrame([(0,), (4,)], "k int"), "k").first()
    assert (more["r"], more["p"]) == (2.0, 0.5)
    f = O.count_fits({0: 2, 2: 2})
    assert "r" not in f and f["mean"] == f["variance"] == 1.0


def test_poisson_bounds_of_the_query(spark, data):
    """At each bound the tail of the Poisson distribution, summed term by term, is 2.5 %."""
    from math import exp, lgamma, log

    from quillmark.plans import QUERIES

    tail = lambda k, m: sum(exp(i * log(m) - m - lgamma(i + 1)) for i in range(k + 1))
    for r in QUERIES["q_poisson_bounds"](spark, data).collect():
        assert tail(r["n"], r["high"]) == pytest.approx(0.025, abs=1e-6) and 1 - tail(r["n"] - 1, r["low"]) == pytest.approx(0.025, abs=1e-6)
