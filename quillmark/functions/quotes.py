"""Quote verification against a whole text, by tiers of tolerance."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters, and what each stands for.
FOLDED = {
    "\u2018": "'",
    "\u2019": "'",
    "\u201a": "'",
    "\u201b": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u201e": '"',
    "\u201f": '"',
    "\u2010": "-",
    "\u2011": "-",
    "\u2012": "-",
    "\u2013": "-",
    "\u2014": "-",
    "\u2015": "-",
    "\u2212": "-",
    "\u00a0": " ",
    "\u2009": " ",
    "\u202f": " ",
    "\u2003": " ",
    "\u200b": "",
    "\u200c": "",
    "\u200d": "",
    "\ufeff": "",
    "\u2026": "...",
}
# Names of tiers, strictest first, and of failure.
TIERS = ("exact", "normalized", "case_insensitive", "spacing_insensitive", "punctuation_insensitive")
NOT_FOUND = "not_found"

_TABLE = str.maketrans(FOLDED)


class Views:
    """A text as each tier sees it; made when first asked for, kept for the next quote."""

    def __init__(self, text: str):
        self._made: dict[str, str] = {"exact": text}

    def of(self, tier: str) -> str:
        if tier not in self._made:
            self._made[tier] = getattr(self, "_" + tier)()
        return self._made[tier]

    def _folded(self) -> str:
        return unicodedata.normalize("NFKC", self.of("exact")).translate(_TABLE)

    def _normalized(self) -> str:
        return " ".join(self.of("folded").split())

    def _case_insensitive(self) -> str:
        return self.of("normalized").lower()

    def _spacing_insensitive(self) -> str:
        return "".join(self.of("folded").split()).lower()

    def _punctuation_insensitive(self) -> str:
        return re.sub("[^a-z0-9]+", "", unicodedata.normalize("NFKC", self.of("exact")).lower())


def locate(quote: str | None, views: Views) -> tuple[str, int | None]:
    """The strictest tier that finds a quote and where; a tier that leaves nothing of a quote finds nothing."""
    if quote and views.of("exact"):
        mine = Views(quote)
        for tier in TIERS:
            if wanted := mine.of(tier):
                at = views.of(tier).find(wanted)
                if at >= 0:
                    return tier, at
    return NOT_FOUND, None


RECORD = "array<struct<quote: string, chars: int, match_type: string, verbatim: boolean, offset: int>>"


def records(quotes, text: str | None) -> list[dict]:
    """A record for each quote that is not null."""
    views, rows = Views(text or ""), []
    for q in quotes if quotes is not None else ():
        if q is not None:
            tier, at = locate(q, views)
            rows.append({"quote": q, "chars": len(q), "match_type": tier, "verbatim": tier == TIERS[0], "offset": at})
    return rows


def verified_quotes(quotes: Column, text: Column) -> Column:
    """A record for each quote of an array, null as none."""

    @F.pandas_udf(RECORD)
    def run(qs: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([records(q, t) for q, t in zip(qs, texts)])

    return run(quotes, text)


def fabricated(found: Column) -> Column:
    return F.size(F.filter(found, lambda r: r["match_type"] == NOT_FOUND))


def needs_look(found: Column) -> tuple[Column, Column]:
    """Whether any quote is missing, and whether any was found only by a loose tier."""
    return F.exists(found, lambda r: r["match_type"] == NOT_FOUND), F.exists(found, lambda r: ~r["match_type"].isin("exact", "normalized", NOT_FOUND))


def folded_accents(value: Column) -> Column:
    """Without combining marks, in compatibility form."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)))

    return run(value)
