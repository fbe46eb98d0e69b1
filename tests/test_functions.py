"""Rules on literal values."""

import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmark.functions import answers as A
from quillmark.functions import archives as R
from quillmark.functions import bibliography as B
from quillmark.functions import mentions as M
from quillmark.functions import metadata as D
from quillmark.functions import predicates as P
from quillmark.functions import quotes as Q
from quillmark.functions import scalars as X
from quillmark.operators import models as O


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    ("text", "archive", "want"),
    [
        ("see https://dandiarchive.org/dandiset/000130 and DANDI:000130", "DANDI Archive", [("000130", "url")]),
        ("doi 10.48324/dandi.000026/0.210813.0225", "DANDI Archive", [("000026", "doi")]),
        ("from CRCNS hc-3 and crcns.org/data-sets/hc/hc-2", "CRCNS", [("hc-2", "url"), ("hc-3", "text_crcns")]),
        ("OpenNeuro ds000117, 10.18112/openneuro.ds000117.v1", "OpenNeuro", [("ds000117", "doi")]),
        ("nothing here", "SPARC", []),
    ],
)
def test_dataset_ids(spark, text, archive, want):
    got = one(spark, R.dataset_ids(F.lit(text), R.PATTERNS[archive]).alias("m"))["m"]
    assert [(m["id"], m["kind"]) for m in got] == want


def test_archive_references(spark):
    got = one(spark, R.archive_references(F.lit("DANDI 000004 and figshare: 1234567")).alias("m"))["m"]
    assert set(got) == {"DANDI Archive", "Figshare"}


def test_archive_names(spark):
    names = {"crcns": "CRCNS", " none ": None, "": None, "Neural Latents Benchmark": "DANDI Archive", "NLB": "DANDI Archive", "My Site": "My Site", "CELL×GENE": "CELLxGENE"}
    rows = spark.createDataFrame([Row(v=k) for k in names]).select("v", R.normal_archive("v").alias("n"))
    assert {r["v"]: r["n"] for r in rows.collect()} == names
    assert one(spark, R.archive_parts(F.lit("DANDI and GitHub; dandi archive")).alias("p"))["p"] == ["DANDI Archive", "GitHub"]
    assert one(spark, R.names_archive(F.lit(None).cast("string"), "GIN").alias("p"))["p"] is False


def test_answers(spark):
    a = lambda s, **k: one(spark, A.strict_answer(F.lit(s), **k).alias("a"))["a"]
    assert a('{"classification": "reuse"}')["label"] == "REUSE"
    assert a('```json\n{"classification": "mention"}\n```')["label"] == "MENTION"
    assert a('Well {"classification": "NEITHER"} so')["label"] == "NEITHER"
    assert a("REUSE it is")["error"] == "not a JSON object"
    assert a('{"classification": "PRIMARY"}')["error"] == "unrecognized classification"
    assert a('{"classification": "PRIMARY"}', labels=A.DIRECT_LABELS)["label"] == "PRIMARY"
    assert a("  ")["error"] == "empty response"
    assert a('{"x": 1}')["error"] == "missing classification"
    assert one(spark, A.reuse_type(F.lit("tool demo"), F.lit("x")).alias("t"))["t"] == ("TOOL_DEMO", None)
    assert one(spark, A.reuse_type(F.lit("Odd use"), F.lit(None).cast("string")).alias("t"))["t"] == ("OTHER", "Odd use")
    assert one(spark, A.modalities(F.array(F.lit("EPhys"), F.lit("electrophysiology"), F.lit("zzz"), F.lit("MRI"))).alias("m"))["m"] == ["neurophysiology", "imaging"]
    env = '{"choices": [{"message": {"content": " "}}]}'
    assert one(spark, A.empty_completion(F.lit(env)).alias("e"))["e"] is True
    assert one(spark, A.empty_completion(F.lit('{"error": {"code": 1}, "choices": [{"message": {}}]}')).alias("e"))["e"] is False
    assert one(spark, A.empty_completion(F.lit('{"choices": []}')).alias("e"))["e"] is False


@pytest.mark.parametrize(
    ("quote", "tier"),
    [
        ("a recent study", "case_insensitive"),
        ("A recent  study", "exact"),
        ("“quoted” text", "exact"),
        ('"quoted" text', "normalized"),
        ("studyalso", "spacing_insensitive"),
        ("study alas", "not_found"),
        ("isolated  by us ,, again", "exact"),
        ("isolated by us, again", "punctuation_insensitive"),
        ("quo ted", "spacing_insensitive"),
        ("", "not_found"),
        ("!!", "not_found"),
    ],
)
def test_quotes(quote, tier):
    text = "Notably, A recent  study also reported “quoted” text, isolated  by us ,, again."
    assert Q.locate(quote, Q.Views(text))[0] == tier


def test_quote_records(spark):
    df = spark.createDataFrame([(["abc", None], "xx abc"), (None, "t"), ([], None)], "q array<string>, t string")
    rows = df.select(Q.verified_quotes(F.col("q"), F.col("t")).alias("r")).select("r", Q.fabricated(F.col("r")).alias("f")).collect()
    assert [len(r["r"]) for r in rows] == [1, 0, 0]
    assert rows[0]["r"][0]["offset"] == 3 and rows[0]["f"] == 0


PAPER = (
    "Intro. Place cells remap [12,14-16]. Others agree (Huszár et al., 2022). The first 15 s were cut. Sites 15 , 20 were used.\n"
    "References\n14. Adams A. A short note on the maze. 10.1000/a14\n15. Huszár R, Li B. Preconfigured dynamics in the hippocampus are guided. 10.1000/a15\n"
)


def test_bibliography():
    entries = M.numbered_bibliography(PAPER)
    assert sorted(entries) == [14, 15]
    assert M.number_by_title(entries, "Preconfigured dynamics in the hippocampus") == 15
    assert M.number_by_title(entries, "Too short") is None
    assert M.number_by_doi(M.Paper(PAPER), {}, "10.1000/a15") == 15


def test_two_bibliographies_take_the_fuller():
    text = "\n1. Aa short.\n2. Bb short.\n1. Cc " + "is much longer than those before " * 100 + "\n2. Dd is longer too.\n"
    assert M.numbered_bibliography(text)[1].startswith("Cc")


def test_citations():
    found = M.numbered_citations(M.Paper(PAPER), 15)
    assert PAPER.index("[12,14-16]") in found
    assert not any(PAPER[p:].startswith("t 15 s") for p in found)
    assert M.author_citations(PAPER, ["Huszár", "Li", "Wu"], 2021) == [PAPER.index("(Huszár"), PAPER.index("Huszár")]
    assert M.author_citations(PAPER, ["Huszár", "Li", "Wu"], 2024) == []
    methods = [c["method"] for c in M.citation_contexts(PAPER, "10.1000/a15", "Preconfigured dynamics in the hippocampus are guided", ["Huszár", "Li", "Wu"], 2022)]
    assert "numbered_citation" in methods and "author_year" in methods


@pytest.mark.parametrize(
    ("text", "n", "at"),
    [
        ("as shown [3,5-7] here", 6, "[3"), ("as shown [3,5-7] here", 4, None), ("as [see 12a] or [ 12 ]", 12, "[ 12"), ("two (4, 8–10) of", 9, "(4"),
        ("in (2020) only", 20, None), ("previously42 and", 42, "y42"), ("studies42,43.", 43, "s42"), ("cortex105,106", 106, "x105"), ("word5x", 5, None),
        ("circuits 5 , 7 are", 5, "s 5"), ("for 30 s of", 30, None), ("the first 30, then", 30, None), ("(RRID) 62 using", 62, ") 62"), ("dynamics 11 – 15 of", 13, "11 –"),
        ("band 11-15 Hz", 13, None), ("doi 10.1101 b 3-5.", 4, None), ("ends with 7", 7, "h 7"), ("no number", 7, None), ("", 1, None),
    ],
)
def test_kinds_of_numbered_citations(text, n, at):
    found = M.numbered_citations(M.Paper(text), n)
    assert (text.index(at) in found) if at else not found


def test_references():
    dois = " ".join(f"10.1000/x{k}" for k in range(6))
    text = "Body. " * 300 + "References\n" + dois
    p = M.Paper(text)
    assert p.in_references(len(text)) and not p.in_references(400) and p.references == text.index("10.1000")
    assert M.Paper("a " * 600 + dois).in_references(1210) and not M.Paper("no DOIs").in_references(3)
    assert M.number_by_doi(M.Paper("Text.\n7. Adams. 10.1000/x1"), {}, "10.1000/X1") == 7
    assert M.number_by_doi(p, {}, "10.1000/x4") == 5 and M.number_by_doi(p, {}, "10.9/none") is None


def test_word_windows_against_all_words():
    import random

    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab  \n") for _ in range(rng.randrange(0, 200)))
        a = rng.randrange(len(t) + 1)
        b, n = rng.randrange(a, len(t) + 1), rng.randrange(0, 6)
        before, after = [m.start() for m in re.finditer(r"\S+", t[:a])], [b + m.end() for m in re.finditer(r"\S+", t[b:])]
        got = M.word_window(t, a, b, n)
        assert (got["start"], got["end"]) == (before[-n:][0] if before and n else a, after[:n][-1] if after and n else b)


def test_windows():
    t = "one two three four five six"
    assert M.word_window(t, 8, 13, 1)["context"] == "two three four"
    w = M.char_window("A b. " + "x" * 700 + ". End", 300, 200)
    assert w["start"] == 5 and w["end"] == 500
    assert M.range_holds("[3-7,9]", 5) and not M.range_holds("[3-7,9]", 8)
    assert M.dense_start(list(range(0, 100, 10)), 5000) == 0 and M.dense_start([1, 2], 50) == 50


def test_body_of_bibliography():
    t = "As shown [29] and in Archive 29 . See Figure 29 too.\nReferences\n28. Foo A. T. 2020. 29. Bar B. Set ABC 000130. 2021. 30. Next C."
    got = B.cited_in_body(t, t.index("ABC"), "ABC 000130", 5)
    assert [g["reference_number"] for g in got] and got[0]["bib_entry"].startswith("29. Bar")
    assert B.in_bibliography(t, t.index("ABC")) and not B.in_bibliography(t, 5)
    assert B.entry_number("noise 50 Ramachandran S and ABC", "ABC") == "50"


def test_metadata(spark):
    s = one(
        spark,
        D.species_of_name(F.lit("Mus musculus - House mouse")).alias("a"),
        D.species_of_name(F.lit("")).alias("b"),
        D.by_words(F.lit("Recordings of a rat's maze"), D.SPECIES_OF_CATALOG, "unknown").alias("c"),
        D.modality_of_approaches(F.array(F.lit("electrophysiological approach"), F.lit("two-photon microscopy"))).alias("d"),
        D.modality_of_text(F.lit("patch and clamp")).alias("e"),
        D.resource_doi(F.lit(None).cast("string"), F.lit("https://elifesciences.org/articles/55130?x")).alias("f"),
        D.resource_doi(F.lit("doi:10.1/x"), F.lit("")).alias("g"),
        D.resource_doi(F.lit(""), F.lit("https://www.biorxiv.org/content/10.1101/2021.03.09.434621v2")).alias("h"),
        D.journal_short(F.lit("Nature Neuroscience")).alias("i"),
    )
    assert tuple(s) == ("mouse", "unknown", "unknown", "multimodal", "ephys", "10.7554/eLife.55130", "10.1/x", "10.1101/2021.03.09.434621", "Nat. Neurosci.")


def test_scalars(spark):
    s = one(
        spark,
        X.slug(F.lit("--A b/C--")).alias("a"),
        X.dois_in(F.lit("see 10.1234/ab.c). and 10.1234/ab.c, 10.5/x")).alias("b"),
        X.citation_name(F.array(F.lit("A"), F.lit("B")), F.lit(2020)).alias("c"),
        X.is_preprint(F.lit("10.1101/2020")).alias("d"),
        X.padded_date(F.lit(2020), F.lit(3), F.lit(None).cast("int")).alias("e"),
        X.descriptor_journal(F.lit("10.1038/s41597-020-1")).alias("f"),
        X.head_and_tail(F.lit("abcdefghij"), 5).alias("g"),
        X.safe_ratio(F.lit(1), F.lit(0)).alias("h"),
    )
    assert s["a"] == "a-b-c" and s["b"] == ["10.1234/ab.c"] and s["c"] == "A and B, 2020" and s["d"] and s["e"] == "2020-03"
    assert s["f"] == "Scientific Data (Nature)" and s["g"].startswith("abc\n") and s["g"].endswith("ij") and s["h"] == 0.0


def test_predicates(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "s boolean")
    assert [r[0] for r in df.select(P.different_lab("s", False)).collect()] == [False, True, False]
    assert [r[0] for r in df.select(P.different_lab("s", True)).collect()] == [False, True, True]
    assert one(spark, P.boolean_query(F.lit("the data archive"), ["archive"], ["dogs"]).alias("x"))["x"]
    assert not one(spark, P.boolean_query(F.lit(None).cast("string"), ["archive"]).alias("x"))["x"]


def test_curve_fit():
    t = np.linspace(0.2, 6, 40)
    name, p, _ = O.fit_curve(t, O.saturating(t, 3.0, 0.7), "saturating")
    assert name == "saturating" and np.allclose(p, [3.0, 0.7], rtol=1e-3)


def test_cox_on_a_case_by_hand():
    # two events at different times, one covariate: 1 / (1 + e^-b) ... solved on a grid
    start, stop, event, x = np.zeros(4), np.array([1.0, 2, 3, 4]), np.array([1, 1, 1, 0]), np.array([[1.0], [0], [1], [0]])
    grid = np.linspace(-3, 4, 7001)
    like = [b - np.log(2 * np.exp(b) + 2) - np.log(np.exp(b) + 2) + b - np.log(np.exp(b) + 1) for b in grid]
    assert abs(O.cox(start, stop, event, x)["coef"][0] - grid[int(np.argmax(like))]) < 2e-3


def test_poisson_bounds():
    low, high = O.poisson_interval(10)
    assert abs(low - 4.7954) < 1e-3 and abs(high - 18.3904) < 1e-3
    assert O.poisson_interval(0)[0] == 0


def test_negative_binomial():
    f = O.count_fits({0: 60, 1: 20, 2: 10, 5: 7, 9: 3})
    assert f["variance"] > f["mean"] and f["nb"] > f["poisson"] and abs(f["r"] * (1 - f["p"]) / f["p"] - f["mean"]) < 1e-9
