"""Answers of classifiers as tables: labels by key, and filters that keep nothing on doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(rows: DataFrame, answers: DataFrame, keys: list[str], vocabulary: list[str], otherwise: str) -> DataFrame:
    """Rows with the label that a classifier gave their key, in column ``label``.

    answers has the keys, ``label`` and ``version``; of several answers the
    newest counts, and of equally new ones the last by label. Labels compare
    trimmed and in upper case; one outside the vocabulary, or none, gives
    ``otherwise``.
    """
    newest = answers.groupBy(*keys).agg(F.max(F.struct("version", F.upper(F.trim("label")).alias("label"))).alias("_a"))
    known = F.when(F.col("_a.label").isin(vocabulary), F.col("_a.label")).otherwise(F.lit(otherwise))
    joined = rows.join(newest, keys, "left")
    return joined.select(*(F.col(c) for c in rows.columns if c != "label"), known.alias("label"))


def approved(rows: DataFrame, verdict: str, wanted: str, asked: Column) -> DataFrame:
    """Rows that need no verdict and those with the wanted one; an error or no verdict is a no."""
    return rows.where(~F.coalesce(asked, F.lit(True)) | F.coalesce(F.col(verdict) == wanted, F.lit(False)))
