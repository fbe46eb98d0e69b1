"""Metadata by rule: species, modality, DOIs of resources, journals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.scalars import c, mapped

# Words that decide, in order, for structured names, for descriptions, for tagged descriptions and for catalogs.
SPECIES_OF_NAME = [("mouse", ["mus musculus", "house mouse"]), ("human", ["homo sapiens", "human"]), ("rat", ["rattus", "norway rat"]), ("nhp", ["macaca", "rhesus"])]
SPECIES_OF_TEXT = [("mouse", ["mouse", "mus musculus"]), ("human", ["human", "homo sapiens"]), ("nhp", ["macaque", "monkey", "primate"]), ("rat", ["rat", "rattus"]), ("other", ["cat", "felis", "aplysia"])]
SPECIES_OF_TAGGED = [("mouse", ["mouse", "mice", "murine"]), ("rat", ["rat ", "rats "]), ("human", ["human", "patient"]), ("pig", ["pig", "porcine", "swine"]), ("cat", ["cat ", "feline"])]
SPECIES_OF_CATALOG = [
    ("mouse", ["mouse", "mice"]), ("rat", ["rat ", "rats "]), ("cat", ["cat "]), ("nhp", ["monkey", "macaque", "primate", "rhesus"]), ("human", ["human", "patient"]),
    ("other", ["zebra finch", "songbird", "locust", "grasshopper", "salamander", "aplysia", "rabbit", "ferret"]),
]
RECORDING = [
    ("extracellular", ["extracellular", "tetrode", "multi-electrode", "silicon probe", "single-unit", "single unit", "multi-unit", "spiking activity", "spike train"]),
    ("intracellular", ["intracellular", "whole-cell", "whole cell", "patch clamp", "patch-clamp", "somatic membrane potential"]),
    ("calcium_imaging", ["calcium imaging", "two-photon", "2-photon", "gcamp", "volumetric calcium"]),
    ("ECoG_EEG", ["ecog", "electrocorticograph", "eeg", "electroencephalog", "scalp"]),
    ("fMRI", ["fmri", "bold"]),
]
# Journal names as they are to be written, and short.
JOURNALS = {
    "bioRxiv (Cold Spring Harbor Laboratory)": "bioRxiv",
    "Cold Spring Harbor Laboratory": "bioRxiv",
    "arXiv (Cornell University)": "arXiv",
    "Cornell University": "arXiv",
    "medRxiv (Cold Spring Harbor Laboratory)": "medRxiv",
    "Research Square (Research Square)": "Research Square",
}
JOURNALS_SHORT = {
    "Nature Communications": "Nat. Commun.",
    "Nature Neuroscience": "Nat. Neurosci.",
    "Nature Methods": "Nat. Methods",
    "Nature Biotechnology": "Nat. Biotechnol.",
    "PLoS Computational Biology": "PLoS Comput. Biol.",
    "PLoS ONE": "PLoS ONE",
    "Journal of Neuroscience": "J. Neurosci.",
    "Journal of Neurophysiology": "J. Neurophysiol.",
    "Scientific Reports": "Sci. Rep.",
    "Current Biology": "Curr. Biol.",
    "Cell Reports": "Cell Rep.",
    "Proceedings of the National Academy of Sciences": "PNAS",
    "Proceedings of the National Academy of Sciences of the United States of America": "PNAS",
    "Frontiers in Neuroscience": "Front. Neurosci.",
    "Frontiers in Computational Neuroscience": "Front. Comput. Neurosci.",
    "Frontiers in Neural Circuits": "Front. Neural Circuits",
    "Journal of Computational Neuroscience": "J. Comput. Neurosci.",
    "Neural Computation": "Neural Comput.",
}


def by_words(text, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first name any of whose words a text has."""
    low, out = F.lower(F.coalesce(c(text), F.lit(""))), F.lit(default)
    for name, words in reversed(rules):
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def species_of_name(name) -> Column:
    """Of a structured name; other names are ``other`` and none is ``unknown``."""
    return F.when(F.coalesce(c(name), F.lit("")) == "", "unknown").otherwise(by_words(name, SPECIES_OF_NAME, "other"))


# Words of approaches, and of texts, that tell a modality.
EPHYS_APPROACHES, IMAGING_APPROACHES = ("electrophysiol",), ("microscopy", "imaging")
EPHYS_TEXT, IMAGING_TEXT = "electrophysiol|spike|extracellular|tetrode", "calcium|fluorescen|imaging"
EPHYS_PAIR = ("patch", "clamp")
# Addresses that hold a DOI or the end of one, what a DOI looks like in them, and prefixes of such ends.
PREPRINT_ADDRESS, PREPRINT_DOI = r"(?:bio|med)rxiv\.org/content/", r"(10\.\d+/[^\s/v]+)"
ELIFE_ADDRESS, ELIFE_END, ELIFE_PREFIX = r"^https?://elifesciences\.org/articles/\d+", r"/articles/(\d+)", "10.7554/eLife."
NATURE_ADDRESS, NATURE_END, NATURE_PREFIX = r"^https?://(?:www\.)?nature\.com/articles/[^\s?#]+", r"/articles/([^\s?#]+)", "10.1038/"
ANY_DOI, DOI_HOST = r"(10\.\d{4,9}/[^\s,;)]+)", "doi.org/"


def modality_of_approaches(approaches) -> Column:
    has = lambda *words: F.exists(F.coalesce(c(approaches), F.array().cast("array<string>")), lambda a: sum((F.lower(a).contains(w).cast("int") for w in words), F.lit(0)) > 0)
    ephys, imaging = has(*EPHYS_APPROACHES), has(*IMAGING_APPROACHES)
    return F.when(ephys & imaging, "multimodal").when(ephys, "ephys").when(imaging, "imaging").otherwise("other")


def modality_of_text(text) -> Column:
    low = F.lower(F.coalesce(c(text), F.lit("")))
    by = F.when(low.rlike(EPHYS_TEXT), "ephys").when(low.rlike(IMAGING_TEXT), "imaging")
    return by.when(low.contains(EPHYS_PAIR[0]) & low.contains(EPHYS_PAIR[1]), "ephys").otherwise("other")


def resource_doi(identifier, url) -> Column:
    """The DOI of a linked resource, by identifier, then by form of address."""
    i, u = c(identifier), c(url)
    part = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    after = lambda x: F.when(x.contains(DOI_HOST), F.substring_index(x, DOI_HOST, -1))
    by_id = F.when(F.lower(F.left(i, F.lit(4))) == "doi:", F.substr(i, F.lit(5))).when(i.startswith("10."), i).otherwise(after(i))
    whole = F.when(u.rlike(PREPRINT_ADDRESS), part(u, PREPRINT_DOI))
    ends = [F.when(u.rlike(address), F.concat(F.lit(prefix), part(u, end))) for address, end, prefix in ((ELIFE_ADDRESS, ELIFE_END, ELIFE_PREFIX), (NATURE_ADDRESS, NATURE_END, NATURE_PREFIX))]
    by_url = F.coalesce(after(u), whole, *ends, part(u, ANY_DOI))
    return F.coalesce(F.nullif(by_id, F.lit("")), by_url)


def journal_name(name) -> Column:
    return mapped(name, JOURNALS)


def journal_short(name) -> Column:
    return mapped(journal_name(name), JOURNALS_SHORT)


def first_description(values) -> Column:
    return F.try_element_at(F.filter(c(values), lambda x: x != ""), F.lit(1))


def subjects(models) -> Column:
    """The sum of counts of models named as subjects, of an array of (name, count)."""
    return F.aggregate(F.filter(c(models), lambda m: m["name"].isin("animal_subject", "subject")), F.lit(0).cast("long"), lambda s, m: s + F.coalesce(m["count"], F.lit(0)))
