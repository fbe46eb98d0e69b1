"""Merges of evidence: precedence, de-duplication, versions, overrides, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order.

    An aggregate over structs, so partial minima are taken before the shuffle
    and a hot key costs one row a task.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select("*", *(o.alias(n) for o, n in zip(order, names)))
    rest = [c for c in df.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*names, *rest)).alias("_r"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_r.{k}").alias(k) for k in df.columns])


def priority(label: Column, labels: list[str]) -> Column:
    """The place of a label in an order, unknown ones last."""
    out = F.lit(len(labels))
    for i, x in reversed(list(enumerate(labels))):
        out = F.when(label == x, i).otherwise(out)
    return out


def merge_pathways(refs: DataFrame, citations: DataFrame, keys: list[str], label: str, dropped: str, filled: list[str]) -> DataFrame:
    """Full outer merge of two pathways, each one row a key.

    In both: the citation's row, its blanks filled from the reference; found
    by reference alone: kept unless labelled ``dropped``.
    """
    r = refs.select(*keys, *(F.col(c).alias(f"_r_{c}") for c in refs.columns if c not in keys), F.lit(True).alias("_in_r"))
    c = citations.select("*", F.lit(True).alias("_in_c"))
    both = c.join(r, keys, "full")
    value = lambda x: F.coalesce(x, f"_r_{x}") if x in filled else F.when(F.col("_in_c"), F.col(x)).otherwise(F.col(f"_r_{x}"))
    source = F.when(F.col("_in_c") & F.col("_in_r"), "both").when(F.col("_in_c"), "citation_analysis").otherwise("direct_reference")
    kept = both.where(F.col("_in_c") | ~F.col(f"_r_{label}").eqNullSafe(F.lit(dropped)))
    return kept.select(*keys, *(value(x).alias(x) for x in citations.columns if x not in keys), source.alias("source_type"))


def merge_upgrades(current: DataFrame, direct: DataFrame, keys: list[str], label: str, strong: str) -> DataFrame:
    """Direct rows of the strong label upgrade others; equal labels mean both; missing rows are added."""
    d = direct.select(*keys, F.col(label).alias("_label"))
    both = current.select(*keys, label).join(d, keys, "full")
    new, old = F.col("_label"), F.col(label)
    source = F.when(old.isNull(), "direct").when(new.isNull(), "citation").when((new == strong) & (old != strong), "direct").when(new == old, "both").otherwise("citation")
    merged = F.when(old.isNull() | ((new == strong) & (old != strong)), new).otherwise(old)
    return both.select(*keys, merged.alias(label), source.alias("source_type"))


def fill_where_missing(left: DataFrame, right: DataFrame, keys: list[str], first: list[str], second: list[str]) -> DataFrame:
    """The first source's rows, and the second's for keys that the first has none of."""
    return left.select(*keys, *first).unionByName(right.join(left.select(*keys).distinct(), keys, "left_anti").select(*keys, *(F.col(b).alias(a) for a, b in zip(first, second))))


def drop_superseded(rows: DataFrame, versions: DataFrame, group: str | None = None, doi: str = "doi") -> DataFrame:
    """Without the preprints whose published version is there too, in the same group if one is named.

    versions has (preprint, published); ids compare in lower case.
    """
    low = F.lower(F.col(doi))
    on = [F.lower("preprint").alias("_pre"), F.lower("published").alias("_pub")]
    groups = [group] if group else []
    there = rows.select(low.alias("_pub"), *groups).distinct()
    gone = versions.select(*on).distinct().join(there, "_pub").select(F.col("_pre").alias("_doi"), *(F.col(g).alias("_g") for g in groups)).distinct()
    key = (low == F.col("_doi")) & ((F.col(group) == F.col("_g")) if group else F.lit(True))
    return rows.join(gone, key, "left_anti")


def applied_overrides(items: DataFrame, overrides: DataFrame, key: str, values: str) -> DataFrame:
    """Lists with a replacement where there is one, and without what is to be removed, case aside."""
    o = overrides.select(F.col(key).alias("_k"), "replace", "remove")
    removed = F.filter(values, lambda x: ~F.array_contains(F.transform(F.coalesce("remove", F.array()), lambda y: F.lower(y)), F.lower(x)))
    new = F.when(F.col("replace").isNotNull(), F.col("replace")).otherwise(removed)
    return items.join(o, F.col(key) == F.col("_k"), "left").select(*(new.alias(c) if c == values else F.col(c) for c in items.columns))


def enriched(rows: DataFrame, extra: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns filled from another table where they are null or blank."""
    x = extra.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_x_{c}") for c in columns))
    joined = rows.join(x, F.col(key) == F.col("_k"), "left")
    return joined.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_x_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns))


def corpus_difference(known: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """One row: ids in both, only known (dropped) and only current (new)."""
    k, c = (t.select(F.col(key).alias("k")).distinct().withColumn(n, F.lit(True)) for t, n in ((known, "_a"), (current, "_b")))
    both = k.join(c, "k", "full")
    return both.agg(F.count_if(F.col("_a") & F.col("_b")).alias("in_both"), F.count_if(F.col("_b").isNull()).alias("dropped"), F.count_if(F.col("_a").isNull()).alias("new"))


def capped(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """At most so many rows a group, in order."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def token_overlap_join(titles: DataFrame, names: DataFrame, least: float = 0.5, shortest: int = 4) -> DataFrame:
    """(title_id, name_id, share) of pairs that share so many of the title's longer words.

    A title of n words of which a share is found elsewhere has one of its
    rarest n - ceil(share * n) + 1 words there, so only those are joined on:
    a common word makes no pairs. Candidates are verified on all words.
    """
    from quillmark.functions.scalars import normal_title

    words = lambda x: F.array_distinct(F.filter(F.split(normal_title(x), " "), lambda w: F.length(w) >= shortest))
    a = titles.select("title_id", words("title").alias("ws")).where(F.size("ws") > 0).withColumn("n", F.size("ws"))
    b = names.select("name_id", words("name").alias("found"))
    placed = b.select("name_id", F.explode("found").alias("w"))
    often = placed.groupBy("w").agg(F.count("*").alias("often"))
    ranked = a.select("title_id", "n", F.explode("ws").alias("w")).join(often, "w").withColumn("rank", F.row_number().over(Window.partitionBy("title_id").orderBy("often", "w")))
    # words that no name has come first in the order; they are counted, not joined
    absent = F.col("n") - F.count("*").over(Window.partitionBy("title_id"))
    rare = ranked.withColumn("rank", F.col("rank") + absent).where(F.col("rank") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1)
    pairs = rare.select("title_id", "w").join(placed, "w").select("title_id", "name_id").distinct()
    both = pairs.join(a, "title_id").join(b, "name_id").withColumn("share", F.size(F.array_intersect("ws", "found")) / F.col("n"))
    return both.where(F.col("share") >= least).select("title_id", "name_id", "share")
