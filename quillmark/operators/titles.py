"""Titles that differ by spelling: a lossless similarity join and the first match of each."""

from __future__ import annotations

from difflib import SequenceMatcher
from math import floor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.session import cut, ship


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def similar_titles(titles: DataFrame, least: float = 0.85, shortest: int = 20) -> DataFrame:
    """(early, late) of ids, early < late, whose titles have a ratio of matching sequences above least.

    titles has (id, title), ids in order and each once, titles all different.
    A ratio 2M / T above 2m leaves fewer than T - 2M + 1 gaps between the
    matching sequences, so the titles share over (3m - 1) T - 1 pairs of
    neighbouring letters, and T is over 1 / (1 - m) of either length. Each
    title is therefore joined on its rarest pairs alone, one more than may be
    lacking, and no pair of titles is lost. Repeated pairs of letters are
    numbered. Titles shorter than the bound has meaning for are left out.
    """
    m = least / 2
    share = (3 * m - 1) / (1 - m)
    if share * shortest < 1:
        raise ValueError("titles this short may share no pair of letters")
    ship(titles.sparkSession)
    t = titles.where(F.char_length("title") >= shortest).select("id", "title", F.char_length("title").alias("n"))
    at = F.expr("transform(sequence(1, n - 1), i -> substring(title, i, 2))")
    counted = t.select("id", "n", F.explode(at).alias("gram")).groupBy("id", "n", "gram").agg(F.count("*").alias("c"))
    grams = counted.select("id", "n", "gram", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("k"))
    often = grams.groupBy("gram", "k").agg(F.count("*").alias("often"))
    order = Window.partitionBy("id").orderBy("often", "gram", "k")
    shared = F.greatest(F.floor(F.col("n") * (floor(share * 1e6) / 1e6) - 1) + 1, F.lit(1))
    rare = grams.join(often, ["gram", "k"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("n") - shared).select("id", "n", "gram", "k")
    other = rare.select(F.col("id").alias("late"), F.col("n").alias("n2"), "gram", "k")
    # the shorter length is at least m / (1 - m) of the longer one
    near = (F.col("id") < F.col("late")) & (F.least("n", "n2") * (1 - m) >= F.greatest("n", "n2") * m)
    pairs = rare.join(other, ["gram", "k"]).where(near).select(F.col("id").alias("early"), "late").distinct()

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    a = t.select(F.col("id").alias("early"), F.col("title").alias("first"))
    b = t.select(F.col("id").alias("late"), F.col("title").alias("second"))
    return pairs.join(a, "early").join(b, "late").where(ratio("second", "first") > least).select("early", "late")


def first_matches(pairs: DataFrame) -> DataFrame:
    """(late, early): for ids taken in order, the first one before that is itself matched to none.

    Each round settles the ids that no open id comes before; the rest of the
    pairs goes on through a checkpoint. The driver sees one flag a round.
    """
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("early").alias("id")).union(pairs.select("late")).distinct())
    heads, left = None, pairs
    while not ids.isEmpty():
        new = cut(ids.join(left.select(F.col("late").alias("id")).distinct(), "id", "left_anti"))
        taken = left.join(new.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id")).distinct()
        ids = cut(ids.join(new, "id", "left_anti").join(taken, "id", "left_anti"))
        open_ = lambda c: ids.select(F.col("id").alias(c))
        left = cut(left.join(open_("early"), "early", "left_semi").join(open_("late"), "late", "left_semi"))
        heads = new if heads is None else heads.union(new)
    if heads is None:
        return pairs.select("late", "early")
    by_head = pairs.join(heads.select(F.col("id").alias("early")), "early", "left_semi")
    return by_head.groupBy("late").agg(F.min("early").alias("early"))


def without_other_versions(entries: DataFrame, least: float = 0.85, shortest: int = 20) -> DataFrame:
    """Entries less the preprints of a title that a journal has too, with the datasets of all its versions.

    entries has (id, title, preprint, datasets), ids once and in order. Titles
    compare trimmed and in lower case. Entries of one title, or matched to
    one by ``first_matches``, are versions of each other. Where some are
    preprints and some not, the preprints go, and the first of the others has
    the datasets of those that go added to its own, sorted. All other entries
    stay as they are, those with null or short titles too.
    """
    named = entries.withColumn("_t", F.lower(F.trim("title")))
    firsts = named.where(F.char_length("_t") >= shortest).groupBy("_t").agg(F.min("id").alias("_h"))
    found = first_matches(similar_titles(firsts.select(F.col("_h").alias("id"), F.col("_t").alias("title")), least, shortest))
    heads = firsts.join(found.select(F.col("late").alias("_h"), "early"), "_h", "left").select("_t", F.coalesce("early", "_h").alias("_head"))
    rows = named.join(heads, "_t", "left").withColumn("_head", F.coalesce("_head", "id"))
    gone = F.when(F.col("preprint"), F.col("datasets"))
    groups = rows.groupBy("_head").agg(F.min(F.when(~F.col("preprint"), F.col("id"))).alias("_kept"), F.array_distinct(F.flatten(F.collect_set(gone))).alias("_more"))
    both = rows.join(groups, "_head").where(~(F.col("preprint") & F.col("_kept").isNotNull()))
    grown = (F.col("id") == F.col("_kept")) & (F.size("_more") > 0)
    all_ = F.when(grown, F.array_sort(F.array_union("datasets", "_more"))).otherwise(F.col("datasets"))
    return both.select(*(all_.alias(c) if c == "datasets" else F.col(c) for c in entries.columns))
