"""From a mention in a bibliography to the places in the body that cite its entry."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.mentions import range_holds, word_window

# Headings of bibliographies, and of sections that end them.
HEADINGS = r"\b(?:References|Bibliography|Literature Cited|Cited Literature|Reference List)\b"
LATER_SECTIONS = ("acknowledgments", "supplementary", "appendix", "author contributions", "[hyperlinks]")
LINK_LIST = "[HYPERLINKS]"
# How an entry begins inside running text, and where the next one does.
ENTRY = (r"(?:^|\s)(\d{1,4})\.\s+[A-Z]", r"(?:^|\s)\[(\d{1,4})\]\s+[A-Z]", r"(?:^|\n)(\d{1,4})\.\s")
NEXT_ENTRY = (r"\s(\d{1,4})\.\s+[A-Z]", r"\s\[(\d{1,4})\]\s+[A-Z]", r"\n(\d{1,4})\.\s")
# The number at an entry's start, and numbers inside it.
NUMBER_FIRST = (r"(\d{1,3})\.\s", r"\[(\d{1,3})\]\s", r"(\d{1,3})\s+[A-Z]")
NUMBER_INSIDE = (r"\b(\d{1,3})\.\s+[A-Z][a-z]+\s+[A-Z]", r"\b(\d{1,3})\s+[A-Z][a-z]+\s+[A-Z]", r"\[(\d{1,3})\]\s+[A-Z]")

_headings = re.compile(HEADINGS, re.I)


def bibliography_start(text: str) -> int:
    """The last heading, or the text's end."""
    return max((m.start() for m in _headings.finditer(text)), default=len(text))


def in_bibliography(text: str, at: int) -> bool:
    """Whether a heading comes before a place and no later section between."""
    last = max((m.end() for m in _headings.finditer(text, 0, at)), default=-1)
    return last >= 0 and not any(s in text[last:at].lower() for s in LATER_SECTIONS)


def entry_at(text: str, at: int, reach: int = 500) -> str:
    """The entry around a place, from the last number before it to the next one after."""
    low = max(0, at - reach)
    starts = [m.start() for p in ENTRY for m in re.finditer(p, text[low:at])]
    a = low + max(starts) if starts else low
    after = text[at : at + reach]
    stops = [m.start() for p in NEXT_ENTRY if (m := re.search(p, after))]
    entry = text[a : at + min(stops, default=len(after))].strip()
    return entry.split(LINK_LIST)[0].strip()


def entry_number(entry: str, mention: str | None = None) -> str | None:
    """The number that an entry starts with, else the last one before the mention in it."""
    entry = entry.strip()
    for p in NUMBER_FIRST:
        if m := re.match(p, entry):
            return m.group(1)
    limit = entry.find(mention) if mention and mention in entry else len(entry)
    found = [(m.start(), m.group(1)) for p in NUMBER_INSIDE for m in re.finditer(p, entry) if m.start() < limit]
    return max(found, key=lambda x: x[0])[1] if found else None


def body_citations(body: str, number: int) -> list[tuple[int, int]]:
    """Places that cite a number, in brackets, in ranges or bare, but not of a figure or table."""
    n = str(number)
    grouped = [m for m in re.finditer(r"\[[\d,\s-]+\]|\([\d,\s-]+\)", body) if range_holds(m.group(), number)]
    bare = list(re.finditer(rf"(?<=[)\]a-zA-Z])\s+{n}(?:\s+[.,]|\s+[A-Z]|(?=\s|$))", body))
    out = set()
    for m in [*grouped, *bare]:
        around = body[max(0, m.start() - 30) : m.end() + 30]
        if not re.search(rf"(?:figure|table|fig\.|tab\.)\s*{n}", around, re.I):
            out.add((m.start(), m.end()))
    return sorted(out)


def merged_spans(spans: list[tuple[int, int]], gap: int = 10) -> list[tuple[int, int]]:
    """Spans at most a few characters apart as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cited_in_body(text: str, at: int, mention: str | None, words: int = 100) -> list[dict]:
    """The body's contexts of the entry that holds a mention."""
    entry = entry_at(text, at)
    number = entry_number(entry, mention)
    if number is None:
        return []
    body = text[: bibliography_start(text)]
    return [{"reference_number": number, "bib_entry": entry, **word_window(text, a, b, words)} for a, b in merged_spans(body_citations(body, int(number)))]


def dataset_contexts(text: str, spans: list[tuple[int, int]], name: str, words: int = 100) -> list[dict]:
    """The words around each mention of a dataset, else around its bare name."""
    if not spans:
        spans = [m.span() for m in re.finditer(re.escape(name), text, re.I)]
    return [word_window(text, a, b, words) for a, b in spans]


WINDOWS = "array<struct<reference_number: string, bib_entry: string, context: string, start: int, end: int, highlight: int>>"


def body_contexts(text: Column, at: Column, mention: Column, words: int = 100) -> Column:
    @F.pandas_udf(WINDOWS)
    def run(texts: pd.Series, places: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([cited_in_body(t or "", int(p), m, words) for t, p, m in zip(texts, places, names)])

    return run(text, at, mention)


def span_contexts(text: Column, start: Column, end: Column, words: int = 100) -> Column:
    @F.pandas_udf("struct<context: string, start: int, end: int, highlight: int>")
    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([word_window(t, int(a), int(b), words) for t, a, b in zip(texts, starts, ends)], columns=["context", "start", "end", "highlight"])

    return run(text, start, end)
