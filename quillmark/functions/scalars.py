"""Scalar functions on strings, dates, numbers and arrays, as Catalyst expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings that mark a preprint DOI, and the journal repair of one prefix.
PREPRINT_MARKS = ("10.1101/", "arxiv", "10.21203/", "10.2139/")
#: DOI patterns of journals that describe datasets.
DESCRIPTOR_JOURNALS = (("Data (MDPI)", r"^10\.3390/data\d+"), ("Scientific Data (Nature)", r"^10\.1038/s41597-"))
#: DOIs of supplements and peer reviews.
NON_RESEARCH = r"\.sa\d+|/peer-review/"
#: Days in a month and in a year.
MONTH_DAYS, YEAR_DAYS = 30.44, 365.25
#: Fixed value: what stands where the middle of a long text was.
OMITTED = "\n\n[... MIDDLE OF PAPER OMITTED FOR LENGTH ...]\n\n"

#: What link texts leave at the end of ids, in the order they are taken off.
LINK_SUFFIXES = ("Download", "http:")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_title(x) -> Column:
    """Lower case, anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", " "))


def slug(x, most: int = 60) -> Column:
    """Runs of other characters as one hyphen, at most so long."""
    return F.left(F.lower(F.btrim(F.regexp_replace(c(x), "[^A-Za-z0-9]+", "-"), F.lit("-"))), F.lit(most))


def file_name(doi) -> Column:
    return F.translate(c(doi), "/:\\", "___")


def is_preprint(doi) -> Column:
    return F.coalesce(sum((F.lower(c(doi)).contains(m).cast("int") for m in PREPRINT_MARKS), F.lit(0)) > 0, F.lit(False))


def descriptor_journal(doi) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(DESCRIPTOR_JOURNALS):
        out = F.when(c(doi).rlike(pattern), name).otherwise(out)
    return out


def is_non_research(doi) -> Column:
    return c(doi).rlike(NON_RESEARCH)


def unversioned(doi) -> Column:
    """Without a /vN ending."""
    return F.regexp_replace(c(doi), r"/v\d+$", "")


def dotted_base(doi) -> Column:
    """What stands before a .N ending, else null."""
    base = F.regexp_extract(unversioned(doi), r"^(.*)\.\d+$", 1)
    return F.when(base != "", base)


def has_accession(base) -> Column:
    """Whether the last path segment ends in four digits or more."""
    return c(base).rlike(r"[0-9]{4,}$")


def journal_repaired(doi, journal) -> Column:
    blank = c(journal).isNull() | c(journal).isin("", "openRxiv") | c(journal).contains("Cold Spring Harbor")
    return F.when(c(doi).startswith("10.1101/") & blank, "bioRxiv").otherwise(c(journal))


def head_and_tail(text, most: int) -> Column:
    """At most so many characters: 60 of 100 from the front, the rest from the end, marked between."""
    head = int(most * 0.6)
    return F.when(F.char_length(c(text)) <= most, c(text)).otherwise(F.concat(F.left(c(text), F.lit(head)), F.lit(OMITTED), F.right(c(text), F.lit(most - head))))


def earliest_snippet(text, markers: list[str], length: int) -> Column:
    """The text from the first of the markers on, or empty."""
    low = F.lower(c(text))
    found = [F.nullif(F.locate(m, low), F.lit(0)) for m in markers]
    at = F.least(*found) if len(found) > 1 else found[0]
    return F.coalesce(F.substr(c(text), at, F.lit(length)), F.lit(""))


def day_or_null(text) -> Column:
    return F.try_to_date(c(text), "yyyy-MM-dd")


def moment_or_null(text) -> Column:
    """An ISO moment with or without Z, else the day in its first ten characters."""
    s = F.regexp_replace(c(text), "Z$", "")
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(F.left(s, F.lit(10)), F.lit("yyyy-MM-dd")))


def days_between(later, earlier) -> Column:
    """Whole days, rounded down, between two moments."""
    seconds = lambda x: F.unix_timestamp(c(x).cast("timestamp"))
    return F.floor((seconds(later) - seconds(earlier)) / 86400)


def months_between_days(later, earlier) -> Column:
    return days_between(later, earlier) / MONTH_DAYS


def years_between_days(later, earlier) -> Column:
    return days_between(later, earlier) / YEAR_DAYS


def quarter_label(day) -> Column:
    return F.concat(F.year(c(day)).cast("string"), F.lit("-Q"), F.quarter(c(day)).cast("string"))


def quarter_end(day) -> Column:
    return F.last_day(F.make_date(F.year(c(day)), F.quarter(c(day)) * 3, F.lit(1)))


def padded_date(year, month, day) -> Column:
    """As much of a date as is known."""
    y, m, d = F.lpad(c(year).cast("string"), 4, "0"), F.lpad(c(month).cast("string"), 2, "0"), F.lpad(c(day).cast("string"), 2, "0")
    return F.when(c(month).isNull(), y).when(c(day).isNull(), F.concat_ws("-", y, m)).otherwise(F.concat_ws("-", y, m, d))


def safe_ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(c(a).cast("double"), c(b).cast("double")), F.lit(0.0))


def floored_log10(x, floor: float) -> Column:
    return F.log10(F.greatest(c(x).cast("double"), F.lit(floor)))


def percent_text(n, total) -> Column:
    return F.when(c(total) > 0, F.format_string("%.1f%%", 100.0 * c(n).cast("double") / c(total))).otherwise("0.0%")


def overflow_list(values, most: int) -> Column:
    """The first values joined by commas, and how many more there are."""
    more = F.size(c(values)) - most
    return F.concat(F.array_join(F.slice(c(values), 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(F.lit("")))


def mapped(x, table: dict[str, str], default: Column | None = None) -> Column:
    """A lookup that stays in the expression; for tables of a fixed, small size."""
    pairs = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    return F.coalesce(F.try_element_at(pairs, c(x)), c(x) if default is None else default)


def citation_name(authors, year) -> Column:
    """Author-year text by number of authors."""
    a, y = c(authors), c(year).cast("string")
    return (
        F.when(F.size(a) == 1, F.format_string("%s, %s", a[0], y))
        .when(F.size(a) == 2, F.format_string("%s and %s, %s", a[0], F.get(a, F.lit(1)), y))
        .when(F.size(a) > 2, F.format_string("%s et al., %s", a[0], y))
    )


def dois_in(text) -> Column:
    """The DOIs of a text without the punctuation after them, each once, in order."""
    found = F.regexp_extract_all(c(text), F.lit(r"(10\.\d{4,}/[^\s\"<>]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:)\]}]+$", "")))


def word_overlap(a, b) -> Column:
    """The share of a's words that b has."""
    x, y = (F.array_distinct(F.split(normal_title(t), " ")) for t in (a, b))
    return safe_ratio(F.size(F.array_intersect(x, y)), F.size(x))


def any_evidence(contexts, availability) -> Column:
    return (F.size(F.coalesce(c(contexts), F.array())) > 0) | (F.coalesce(c(availability), F.lit("")) != "")


def without_suffixes(x, suffixes: tuple[str, ...] = LINK_SUFFIXES) -> Column:
    """Each ending taken off once, in order."""
    out = c(x)
    for ending in suffixes:
        out = F.when(out.endswith(ending), F.left(out, F.char_length(out) - len(ending))).otherwise(out)
    return out


def search_terms(x) -> Column:
    """Dashes as blanks, no punctuation at the end, single blanks."""
    bare = F.rtrim(F.translate(c(x), "\u2013\u2014-", "   "), F.lit(".,;:!?"))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def contributor_names(people, most: int = 15) -> Column:
    """"Last, First" of those with a last name among the first people of an array of (last, first), else "Not listed"."""
    name = lambda p: F.btrim(F.concat(p["last"], F.lit(", "), F.coalesce(p["first"], F.lit(""))), F.lit(", "))
    named = F.filter(F.slice(F.coalesce(c(people), F.array()), 1, most), lambda p: F.coalesce(p["last"], F.lit("")) != "")
    return F.when(F.size(named) > 0, F.array_join(F.transform(named, name), "; ")).otherwise(F.lit("Not listed"))


def filled(template: str, **values) -> Column:
    """A template with columns at its {names}; nulls are empty, and values are never read as templates."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(c(values[name]).cast("string"), F.lit("")))
    return F.concat(*parts)


def weighted_median(x, certain, share: float, unit: int = 100) -> Column:
    """The median of values that count whole where certain and by a share elsewhere; an aggregate, exact to 1 / unit of a row."""
    return F.percentile(c(x), 0.5, F.when(c(certain), unit).otherwise(round(share * unit)).cast("long"))
