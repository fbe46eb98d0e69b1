"""Review of labels: samples, confusion, metrics, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.scalars import safe_ratio


def stratified_sample(rows: DataFrame, by: str, key: str, n: int, start: int = 0) -> DataFrame:
    """Places start + 1 to start + n of each class in the order of a hash of the key."""
    w = Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("place", F.row_number().over(w)).where((F.col("place") > start) & (F.col("place") <= start + n))


def confusion(labels: DataFrame, said: str, found: str) -> DataFrame:
    """(said, found, n) of the rows that a person has reviewed."""
    return labels.where(F.col(found).isNotNull()).groupBy(F.col(said).alias("said"), F.col(found).alias("found")).agg(F.count("*").alias("n"))


def label_metrics(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, accuracy) from confusion counts."""
    each = matrix.select(F.explode(F.array("said", "found")).alias("label")).distinct()
    right = matrix.where("said = found").select(F.col("said").alias("label"), F.col("n").alias("hit"))
    rows, cols = (matrix.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(c)) for c in ("said", "found"))
    whole = matrix.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("said") == F.col("found"), F.col("n")).otherwise(0)).alias("ok"))
    joined = each.join(right, "label", "left").join(rows, "label", "left").join(cols, "label", "left").join(F.broadcast(whole))
    hit = F.coalesce("hit", F.lit(0))
    return joined.select("label", safe_ratio(hit, "said").alias("precision"), safe_ratio(hit, "found").alias("recall"), safe_ratio("ok", "all").alias("accuracy"))


def wald_interval(num: Column, den: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Bounds of a share, inside 0 and 1; null where there is nothing to share."""
    p = F.try_divide(num.cast("double"), den)
    half = z * F.sqrt(F.try_divide(p * (1 - p), den.cast("double")))
    return F.greatest(p - half, F.lit(0.0)), F.least(p + half, F.lit(1.0))


def transitions(before: DataFrame, after: DataFrame, human: DataFrame, key: str) -> DataFrame:
    """(human, parent, current, n, outcome): fixed, regressed, drifted or same."""
    j = before.select(key, F.col("label").alias("parent")).join(after.select(key, F.col("label").alias("current")), key).join(human.select(key, F.col("label").alias("human")), key)
    p, c, h = F.col("parent"), F.col("current"), F.col("human")
    outcome = F.when(p == c, "same").when(c == h, "fixed").when(p == h, "regressed").otherwise("drifted")
    return j.groupBy("human", "parent", "current", outcome.alias("outcome")).agg(F.count("*").alias("n"))
