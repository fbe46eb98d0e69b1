"""Filters of the evidence tables, as boolean expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.scalars import c

# Names that say nothing, ids that are examples, tags of tests.
TRIVIAL_NAMES = ["test", "asdf", "abc", "bla", "zzz"]
PLACEHOLDER_IDS = ["123456"]
TEST_TAGS = ["test", "embargo", "testing"]
# Relations and kinds of resources that are papers, and kinds that are not.
PAPER_RELATIONS = ["dcite:IsDescribedBy", "dcite:IsPublishedIn", "dcite:IsSupplementTo", "dcite:Describes"]
PAPER_KINDS = ["dcite:JournalArticle", "dcite:Preprint", "dcite:DataPaper", "dcite:ConferencePaper", "dcite:ConferenceProceeding"]
OTHER_KINDS = ["dcite:Software", "dcite:Dataset", "dcite:ComputationalNotebook"]


def non_empty(assets, size) -> Column:
    return F.coalesce(c(assets) > 0, F.lit(False)) | F.coalesce(c(size) > 0, F.lit(False))


def paper_resources(resources) -> Column:
    """Those of an array of (relation, kind, ...) that may be papers; a null kind may."""
    ok = lambda r: r["relation"].isin(PAPER_RELATIONS) & (r["kind"].isNull() | r["kind"].isin(PAPER_KINDS)) & ~F.coalesce(r["kind"].isin(OTHER_KINDS), F.lit(False))
    return F.filter(c(resources), ok)


def is_paper_resource(kind, doi) -> Column:
    return (c(kind).isNull() | c(kind).isin(PAPER_KINDS)) & (F.coalesce(c(doi), F.lit("")) != "")


def has_full_text(source, length, full_sources: list[str], least: int = 5000) -> Column:
    """Whether any source of a '+' list gives full texts, and the text is long enough."""
    return F.coalesce(F.arrays_overlap(F.split(c(source), r"\+"), F.array(*(F.lit(s) for s in full_sources))) & (c(length) >= least), F.lit(False))


def is_reuse(label, same_lab=None, want_same: bool | None = None) -> Column:
    """Reuse; with a wish, only rows known to be of the same or of another lab."""
    out = c(label) == "REUSE"
    return out if want_same is None else out & c(same_lab).eqNullSafe(F.lit(want_same))


def different_lab(same_lab, null_counts: bool) -> Column:
    """Another lab for certain, or also where it is not known."""
    known = c(same_lab).eqNullSafe(F.lit(False))
    return known | c(same_lab).isNull() if null_counts else known


def within(day, cutoff) -> Column:
    return c(day) <= cutoff


def found_link(found, confidence, validated, least: int = 6) -> Column:
    return c(found).eqNullSafe(F.lit(True)) & F.coalesce(c(confidence) >= least, F.lit(False)) & c(validated).eqNullSafe(F.lit(True))


def foreign_id(dataset_id) -> Column:
    """A six-digit id, which belongs to another archive."""
    return c(dataset_id).rlike(r"^\d{6}$")


def is_placeholder(dataset_id) -> Column:
    return c(dataset_id).isin(PLACEHOLDER_IDS)


def trivial_name(name) -> Column:
    return F.lower(F.trim(c(name))).isin(TRIVIAL_NAMES) | (F.char_length(F.trim(c(name))) < 5)


def is_test(tags) -> Column:
    return F.coalesce(F.arrays_overlap(F.transform(c(tags), lambda t: F.lower(t)), F.array(*(F.lit(t) for t in TEST_TAGS))), F.lit(False))


def extraction_artifact(source, text, least: int = 20) -> Column:
    """A text from one source with many lone line numbers."""
    return c(source).contains("unpaywall") & (F.regexp_count(c(text), F.lit(r"\n\s*\d{1,4}\s*\n")) >= least)


def boolean_query(text, wanted: list[str], unwanted: list[str] = ()) -> Column:
    """Any of the wanted terms and none of the unwanted, case aside."""
    low, hit, miss = F.lower(c(text)), F.lit(False), F.lit(False)
    for t in wanted:
        hit = hit | low.contains(t.lower())
    for t in unwanted:
        miss = miss | low.contains(t.lower())
    return F.coalesce(hit & ~miss, F.lit(False))


def matches_search(fields: list, needle: str) -> Column:
    return F.lower(F.concat_ws(" ", *(c(f) for f in fields))).contains(needle.lower())
