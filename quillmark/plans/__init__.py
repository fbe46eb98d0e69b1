"""Queries over the table set, each a Spark plan with its SQL where SQL can say it."""

from quillmark.plans import counting, inputs, labels, merging, review, survival, texts
from quillmark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "counting", "inputs", "labels", "merging", "review", "survival", "texts"]
