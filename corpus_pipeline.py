"""Five stages from raw documents to packed training sequences.

Each stage reads what the one before wrote. All but the last keep the columns
of ``documents``; the last returns the packed pieces.

Defined cases, alike in all stages: null, empty and very long texts, null
sources and languages, null ids and ids of other types, repeated rows and
columns of any other name are allowed. A null or empty text has the learned
share of good documents as its score, no lines, no near duplicates and no
benchmark items, and is packed as its end id alone. Rows that repeat an id
and text are near duplicates of one document, which stays with all its rows; a
null id stays. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import decontamination, line_dedup, near_dedup, packing, quality_classifier
from quillmark.llm.runtime import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the nearest-neighbour classifier rejects. It learns from labelled rows of docs."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the boilerplate lines of each source out of its documents; n_chars follows the text."""
    return line_dedup.drop_lines(docs).selectExpr(*("char_length(text) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns)).to(docs.schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of texts whose five-word shingles are alike to 0.8 or more."""
    return near_dedup.one_of_each(docs, near_dedup.Similarity(words=5, num=80, den=100))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 1,024 tokens."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: The first stage's model and the last stage's tokenizer are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
