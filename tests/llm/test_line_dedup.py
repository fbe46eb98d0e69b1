"""Boilerplate lines against plain counting; both ways of handing them out."""

from collections import Counter

import pytest

from quillmark.llm import line_dedup as L

ROWS = [
    *((i, "a", f"Menu\nbody {i} text\n  Menu  \n\nFoot") for i in range(10)),
    (20, "a", None),
    (21, "a", ""),
    (22, "a", "Foot"),
    (23, None, "Menu\nown"),
    (24, None, "own"),
    (25, "b", "Menu\nMenu"),
    (26, "b", "lone\r"),
    (27, "c", "x" * 100_000),
    (22, "a", "Foot"),
]


def brute(rows, ratio, least):
    pages, lines = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        lines.update((h, x) for x in {y.strip(L.BLANKS) for y in (t or "").split("\n")} - {""})
    drop = {k for k, n in lines.items() if n >= least and n > ratio * pages[k[0]]}
    return sorted((i, h or "", "\0" if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(L.BLANKS)) not in drop)) for i, h, t in rows)


@pytest.mark.parametrize("bound", [10, -1])
def test_dropping(spark, monkeypatch, bound):
    monkeypatch.setattr(L, "BROADCAST_LINES", bound)
    df = spark.createDataFrame([(i, h, t, 1, 2) for i, h, t in ROWS], "doc_id long, source string, text string, pages int, host_pages int").repartition(3)
    out = L.drop_lines(df, ratio=0.5, min_pages=2)
    assert out.columns == df.columns
    assert sorted((r[0], r[1] or "", "\0" if r[2] is None else r[2]) for r in out.collect()) == brute(ROWS, 0.5, 2)
    assert L.drop_lines(df.limit(0)).count() == 0


def test_lines_of_a_smaller_language(spark):
    """A fifth of a source's pages are French and a tenth of them have the line: 2 % of the source."""
    rows = [(i, "s", ("Voir aussi.\n" if i % 50 == 0 else "Rare.\n" if i < 5 else "") + f"body {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["text"] for r in L.drop_lines(df).collect()}
    assert got == {i: t.removeprefix("Voir aussi.\n") for i, _, t in rows}
    assert sum(t.startswith("Rare.") for t in got.values()) == 4
