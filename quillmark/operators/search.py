"""Search and citation scans over input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.predicates import boolean_query
from quillmark.operators.merging import keep_one


def search(papers: DataFrame, text: str, wanted: list[str], unwanted: list[str] = (), key: str = "doi", most: int | None = None) -> DataFrame:
    """Papers with a key that a query finds, each key once, the first so many by key."""
    hits = papers.where(boolean_query(text, wanted, unwanted) & (F.coalesce(F.col(key), F.lit("")) != ""))
    once = keep_one(hits.withColumn("_low", F.lower(F.col(key))), ["_low"], [F.col(key)]).drop("_low")
    return once if most is None else once.orderBy(key).limit(most)


def by_term(papers: DataFrame, text: str, terms: list[str], key: str = "doi") -> DataFrame:
    """Papers with the first term, in the order given, that finds them."""
    low = F.lower(F.col(text))
    first = F.coalesce(*(F.when(low.contains(t.lower()), F.lit(t)) for t in terms))
    return keep_one(papers.withColumn("term", first).where("term is not null"), [key], [F.col("term")])


def citing_after(edges: DataFrame, works: DataFrame, created: DataFrame, inclusive: bool = False, keep_undated: bool = False) -> DataFrame:
    """Edges whose citing work appeared after the cited dataset was made.

    edges (citing, cited, dataset_id); works (doi, day); created (dataset_id, made).
    """
    e = edges.join(works.select(F.col("doi").alias("citing"), "day"), "citing", "left").join(created, "dataset_id")
    later = F.col("day") >= F.col("made") if inclusive else F.col("day") > F.col("made")
    return e.where(later | F.col("day").isNull() if keep_undated else later)


def over_versions(edges: DataFrame, versions: DataFrame, source: str = "source") -> DataFrame:
    """Edges of all versions of a paper, named by the primary one, each citing paper once, the first source's."""
    v = versions.select("primary", F.explode(F.array_distinct(F.array("primary", "other"))).alias("cited")).where("cited is not null")
    e = edges.join(v, "cited").select("dataset_id", F.lower("citing").alias("citing"), F.col("primary").alias("cited_paper"), source)
    return keep_one(e, ["dataset_id", "citing"], [F.col(source), F.col("cited_paper")])


def by_priority(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """A value for each key from the first source, in the order given, that has one."""
    every = None
    for i, s in enumerate(sources):
        rows = s.where(F.col(value).isNotNull()).select(key, F.lit(i).alias("source"), value)
        every = rows if every is None else every.unionAll(rows)
    return keep_one(every, [key], [F.col("source")])
