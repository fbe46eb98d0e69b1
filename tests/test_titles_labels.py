"""Titles, labels, data sections and small text forms against plain Python."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillmark.functions import mentions as N
from quillmark.functions import scalars as X
from quillmark.operators import labels as L
from quillmark.operators import titles as T


def spelt(rng, title):
    out = list(title)
    for _ in range(rng.randrange(6)):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [rng.choice("abcde ")], [out[k], rng.choice("abcde ")]])
    return "".join(out)


@pytest.fixture(scope="module")
def titles():
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdefgh  ") for _ in range(rng.randrange(20, 60))) for _ in range(25)] + ["ab" * 15, "abc " * 60]
    out = [spelt(rng, b) for b in bases for _ in range(6)] + ["short", "", "ab" * 15]
    rng.shuffle(out)
    return out


def test_similar_titles(spark, titles):
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(titles))]
    want = {(i, j) for j, b in rows for i, a in rows if i < j and min(len(a), len(b)) >= 20 and SequenceMatcher(None, b, a).ratio() > 0.85}
    got = [tuple(r) for r in T.similar_titles(spark.createDataFrame(rows, "id long, title string"), 0.85).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    heads, first = [], {}
    for j, _ in rows:
        hit = [i for i in heads if (i, j) in want]
        if hit:
            first[j] = hit[0]
        else:
            heads.append(j)
    pairs = spark.createDataFrame(sorted(want), "early long, late long")
    assert {r["late"]: r["early"] for r in T.first_matches(pairs).collect()} == first


def test_versions(spark):
    a, b = "a title of a paper that is long enough", "A title of the paper that is long enough "
    rows = [(1, a, True, ["x"]), (2, b, False, ["y"]), (3, b, False, ["z"]), (4, a, True, None), (5, "short", True, ["s"]), (6, None, True, ["n"]), (7, "another title without any other version", True, ["o"])]
    df = spark.createDataFrame(rows, "id long, title string, preprint boolean, datasets array<string>")
    got = {r["id"]: r["datasets"] for r in T.without_other_versions(df).collect()}
    assert got == {2: ["x", "y"], 3: ["z"], 5: ["s"], 6: ["n"], 7: ["o"]}
    assert T.without_other_versions(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        T.similar_titles(df, 0.85, 2)


def test_labels(spark):
    rows = spark.createDataFrame([(1, "described"), (2, "described"), (3, "described"), (4, "registered"), (5, None)], "k int, origin string")
    answers = spark.createDataFrame([(1, "mentions", 1), (1, " describes", 2), (2, "nonsense", 1), (4, None, 1)], "k int, label string, version int")
    got = L.labelled(rows, answers, ["k"], ["DESCRIBES", "MENTIONS"], "ERROR")
    assert {r["k"]: r["label"] for r in got.collect()} == {1: "DESCRIBES", 2: "ERROR", 3: "ERROR", 4: "ERROR", 5: "ERROR"}
    kept = L.approved(got, "label", "DESCRIBES", F.col("origin") == "described")
    assert sorted(r["k"] for r in kept.collect()) == [1, 4]


def test_access_lines():
    line = re.compile(rf"[^\n]*(?:{N.ACCESS})[^\n]*(?:{N.DATA})[^\n]*", re.I)
    rng = random.Random(1)
    words = ["download", "Obtained", "access", "available", "at", "on", "data", "archive", "x", "datasets\n", "\n", "available\nfrom"]
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(14)))
        assert [text[a:b] for a, b in N.access_lines(text)] == [m.group() for m in line.finditer(text)], text


def test_data_sections(spark):
    texts = [
        "Intro\nData availability\nAll at a site." + "x" * 4000,
        "Methods\nMice.\nRecording setup\n" + "y" * 3000,
        "Materials and Methods\nnothing of it",
        "We downloaded all the data from here.\nEnd",
        "nothing",
        "",
        None,
        "Key Resources Table a\nDeposited data b",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", N.data_sections(F.col("t")).alias("s"))
    got = {r["i"]: r["s"] for r in df.collect()}
    assert got[0] == "--- Data availability section ---\n" + texts[0][6:][:3000]
    assert got[1].startswith("--- Methods (data subsection) ---\nRecording setup\nyyy") and got[1].endswith("y" * 1900)
    assert got[2] == "--- Methods ---\nMaterials and Methods\nnothing of it"
    assert got[3] == "--- Text near data access mention ---\n" + texts[3]
    assert (got[4], got[5], got[6]) == ("", "", "")
    assert got[7] == "--- Key resources table ---\nKey Resources Table a\nDeposited data b\n\n--- Deposited data ---\nDeposited data b"


def test_text_forms(spark):
    people = [[("Roe", "Ann"), ("", "Bo"), (None, "Cy"), ("Poe", None)], [], None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(people)], "i int, p array<struct<last: string, first: string>>")
    assert [r[0] for r in df.orderBy("i").select(X.contributor_names("p")).collect()] == ["Roe, Ann; Poe", "Not listed", "Not listed"]
    one = spark.range(1)
    assert one.select(X.without_suffixes(F.lit("idhttp:Download")), X.search_terms(F.lit(" a\u2014b-c  d?!")), X.filled("{a} and {a}{b}", a=F.lit("{b}"), b=F.lit(None))).first()[:] == ("id", "a b c d", "{b} and {b}")
    v = spark.createDataFrame([(1.0, True), (2.0, True), (9.0, False), (8.0, False)], "x double, sure boolean")
    assert v.select(X.weighted_median("x", "sure", 0.5)).first()[0] == 2.0
    assert v.limit(0).select(X.weighted_median("x", "sure", 0.5)).first()[0] is None
