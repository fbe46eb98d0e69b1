"""Validation of classifier answers: labels, types, modalities, envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.scalars import c, mapped

# Label vocabularies.
CITING_LABELS = ["REUSE", "MENTION", "NEITHER"]
DIRECT_LABELS = ["PRIMARY", "REUSE", "NEITHER"]
REUSE_TYPES = ["TOOL_DEMO", "BENCHMARK", "AGGREGATION", "CONFIRMATORY", "NOVEL_ANALYSIS", "ML_TRAINING", "SIMULATION", "TEACHING", "OTHER"]
MODALITIES = ["neurophysiology", "behavior", "imaging", "morphology", "transcriptomics", "other", "unclear"]
HOSTED_MODALITIES = ["neurophysiology", "behavior", "imaging"]
# Other words for modalities.
MODALITY_WORDS = {
    "electrophysiology": "neurophysiology", "ephys": "neurophysiology", "physiology": "neurophysiology",
    "transcriptomic": "transcriptomics", "gene_expression": "transcriptomics", "genetics": "transcriptomics",
    "behaviour": "behavior", "morphological": "morphology",
    "mri": "imaging", "fmri": "imaging", "structural_imaging": "imaging", "electron_microscopy": "imaging", "em": "imaging",
    "histology": "imaging", "anatomy": "imaging", "anatomical": "imaging",
}
# Confidence words.
CONFIDENCE = {"high": "8", "medium": "5", "low": "3"}

_ANSWER = "map<string, string>"


def unfenced(content) -> Column:
    """Without a code fence around it."""
    s = F.trim(c(content))
    inner = F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(s.startswith("```"), F.trim(inner)).otherwise(s)


def _object(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{"), F.from_json(text, _ANSWER))


def strict_answer(content, labels: list[str] = CITING_LABELS) -> Column:
    """(fields, label, error): the JSON object of an answer, rescued from prose around it at most once.

    A label outside the vocabulary is an error and never guessed from words.
    """
    text = unfenced(content)
    fields = F.coalesce(_object(text), _object(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))))
    raw = F.try_element_at(fields, F.lit("classification"))
    label = F.replace(F.upper(F.trim(raw)), F.lit(" "), F.lit("_"))
    error = (
        F.when(F.coalesce(F.trim(c(content)), F.lit("")) == "", "empty response")
        .when(fields.isNull(), "not a JSON object")
        .when(raw.isNull(), "missing classification")
        .when(~label.isin(labels), "unrecognized classification")
    )
    return F.struct(fields.alias("fields"), F.when(error.isNull(), label).alias("label"), error.alias("error"))


def lenient_answer(content, labels: list[str], default: str) -> Column:
    """The label by JSON, else the first of the labels that occurs, else a default."""
    strict = strict_answer(content, labels)["label"]
    out = F.lit(default)
    for x in reversed(labels):
        out = F.when(F.upper(c(content)).contains(x), x).otherwise(out)
    return F.coalesce(strict, out)


def empty_completion(envelope) -> Column:
    """Whether an API answer looks complete and has no text; errors and missing choices are not that."""
    g = lambda p: F.get_json_object(c(envelope), p)
    there = g("$.choices[0]").isNotNull() & F.coalesce(g("$.error"), F.lit("null")).isin("null", "", "{}")
    return F.coalesce(there & (F.trim(F.coalesce(g("$.choices[0].message.content"), F.lit(""))) == ""), F.lit(False))


def reuse_type(raw, write_in) -> Column:
    """(type, write_in): unknown types as OTHER with their own words."""
    value = F.translate(F.upper(F.trim(c(raw))), " -", "__")
    own = F.nullif(F.trim(c(write_in)), F.lit(""))
    known = value.isin(REUSE_TYPES)
    kind = F.when(c(raw).isNull(), F.lit(None)).when(known, value).otherwise("OTHER")
    text = F.when(c(raw).isNull(), F.lit(None)).when(~known, F.coalesce(own, F.left(F.trim(c(raw)), F.lit(120)))).when(value == "OTHER", own)
    return F.struct(kind.alias("type"), text.alias("write_in"))


def modalities(raw) -> Column:
    """Known modalities of a list, each once, in order."""
    norm = F.transform(F.coalesce(c(raw), F.array().cast("array<string>")), lambda x: F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("_")))
    return F.array_distinct(F.filter(F.transform(norm, lambda x: mapped(x, MODALITY_WORDS)), lambda x: x.isin(MODALITIES)))


def hosted(found) -> Column:
    """Whether any modality is one that the home archive hosts; null when none is known."""
    return F.when(F.size(c(found)) > 0, F.arrays_overlap(c(found), F.array(*(F.lit(m) for m in HOSTED_MODALITIES))))


def confidence_number(word) -> Column:
    x = F.lower(F.trim(c(word)))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in CONFIDENCE.items() for v in kv)), x).cast("int"), x.try_cast("int"), F.lit(5))


def only_for_reuse(label, value) -> Column:
    return F.when(c(label) == "REUSE", c(value))


def capped_confidence(label, confidence, text_length, least: int = 15_000, cap: int = 5) -> Column:
    """(confidence, low_text_warning, high_confidence_reuse)."""
    short = (c(label) == "REUSE") & (c(text_length) < least)
    value = F.when(short, F.least(c(confidence), F.lit(cap))).otherwise(c(confidence))
    return F.struct(value.alias("confidence"), F.coalesce(short, F.lit(False)).alias("low_text_warning"), F.coalesce((c(label) == "REUSE") & (value >= 7), F.lit(False)).alias("high_confidence_reuse"))


def strict_boolean(value) -> Column:
    x = F.lower(F.trim(c(value).cast("string")))
    return F.when(x.isin("true", "yes", "1"), True).when(x.isin("false", "no", "0", ""), False).when(x.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), x)).cast("boolean"))
