"""Models of six bytes, as the query has them, against plain Python, in one or several passes over the languages."""

import math

import pytest
from test_quality import brute_model

from quillmark.llm import quality_rules as R


def log_perplexity(p, text, order):
    raw = bytes(order - 1) + text.encode()
    logs = [math.log(p(raw[i : i + order])) for i in range(len(raw) - order + 1)]
    return -sum(logs) / len(logs)


@pytest.mark.parametrize("order, shard_bytes, languages", [(6, R.SHARD_BYTES, 1 << 16), (6, 500, 2), (7, 500, 1 << 16)])
def test_longer_models_by_brute_force(spark, monkeypatch, order, shard_bytes, languages):
    monkeypatch.setattr(R, "LANGUAGES", languages)
    said = {"en": "the brown fox and the lazy dog ran number {} far away ", "fr": "une été à la mer, numéro {} et même plus ", None: "{}#%&{} ", "de": "über den Straßen {} ", "es": "el niño {} "}
    rows = [(i, said[x].format(i, i * i) * (1 + i % 3), x) for i, x in enumerate([*said] * 8)] + [(99, None, "de"), (100, "", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r["log_perplexity"] for r in R.measure(df, R.train(df, shard_bytes=shard_bytes, order=order)).collect()}
    models = {x: brute_model([t for _, t, y in rows if y == x and t], order) for x in said}
    assert len(got) == len(rows) and got[99] is None and got[100] is None
    for i, t, x in rows[:40]:
        assert got[i] == pytest.approx(log_perplexity(models[x], t, order), abs=2e-6)


def test_query_sees_six_bytes(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    p = brute_model([r["text"] or "" for r in docs if r["lang"] == "es"], 6)
    got = {r["doc_id"]: r["perplexity"] for r in R.query(spark, data).select("doc_id", "perplexity").collect()}
    some = sorted((r for r in docs if r["lang"] == "es" and r["text"]), key=lambda r: len(r["text"]))[:4]
    assert some
    for r in some:
        assert math.log(got[r["doc_id"]]) == pytest.approx(log_perplexity(p, r["text"], 6), abs=1e-5)
