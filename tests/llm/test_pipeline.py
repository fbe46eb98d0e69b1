"""The stages: columns, decisions, and what they keep."""

import corpus_pipeline as P
from pyspark.sql import functions as F
from test_tokens import check_pieces


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, data)
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        kept = after.join(before.select("doc_id"), "doc_id", "left_semi").count()
        assert kept == after.count() > 0.5 * before.count(), name
        before = P.stored(after, "t")
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert check_pieces(P.pack(spark, before, data).collect(), texts) == 0


def test_odd_rows_pass(spark, data):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "clean words in a row that say a thing or two", "en", "s", 44)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, data), "t")
    assert {r["doc_id"] for r in docs.collect()} == {1, 2, 3}
    assert P.pack(spark, docs, data).select(F.countDistinct("doc_id")).first()[0] == 3
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_stages_against_plain_python(spark, data):
    """Line dedup, near-dedup and decontamination over what the classifier keeps."""
    from test_decontamination import brute as contained
    from test_line_dedup import brute as without_lines
    from test_near_dedup import brute as grouped

    from quillmark.llm import line_dedup

    (_, quality), (_, lines), (_, near), (_, clean) = P.STAGES[:4]
    first = P.stored(quality(spark, spark.read.parquet(f"{data}/documents.parquet"), data), "t")
    second = P.stored(lines(spark, first, data), "t")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in first.collect()]
    got = sorted((r["doc_id"], r["source"] or "", "\0" if r["text"] is None else r["text"]) for r in second.collect())
    assert got == without_lines(rows, line_dedup.RATIO, line_dedup.MIN_PAGES)
    assert all(r["n_chars"] == len(r["text"]) for r in second.where("text is not null").collect())

    third = P.stored(near(spark, second, data), "t")
    groups = grouped([(r["doc_id"], r["text"]) for r in second.collect()], 5, 80, 100)
    assert {r["doc_id"] for r in third.collect()} == {i for i, (_, c) in groups.items() if i == c}

    fourth = clean(spark, third, data)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in third.collect()]
    assert {r["doc_id"] for r in fourth.collect()} == {i for i, _ in docs} - {m[0] for m in contained(docs, items)}


def test_text_ids_and_clashing_columns(spark, data):
    """Ids that are no numbers, null ones, long texts, repeated rows, and columns named like the operators' own."""
    base = "plain words that say a thing and then another thing about rivers and hills in the south"
    rows = [("a", base, "s"), ("b", base + " again", "s"), ("a", base, "s"), (None, "some other words entirely about a house by the sea", None), ("long", "a word or two of prose follows here. " * 30_000, "t"), ("e", "", "t"), ("n", None, None)]
    docs = spark.createDataFrame([(*r, 1.0, 2, "x", "y") for r in rows], "doc_id string, text string, source string, score double, id int, __gone string, component_id string")
    before = docs.schema.simpleString()
    for _, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, data), "t")
        assert docs.schema.simpleString() == before
    kept = sorted(r["doc_id"] or "" for r in docs.collect())
    assert kept == sorted(x for x in kept if x != "b") or "a" not in kept
    packed = P.pack(spark, docs, data)
    assert packed.select("doc_id").distinct().count() == len(set(kept))
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0] + sum(r["doc_tokens"] for r in packed.where("doc_id = 'a' and start = 0").limit(1).collect() if kept.count("a") > 1)
