"""Line removal by site-relative frequency.

A line is boilerplate of its host when the share of the host's pages that
contain it exceeds a ratio. Lines are compared without surrounding blanks
(0x20, 0x09-0x0D); blank lines are never counted or dropped.

Defined cases: a null text stays null and has no lines; an empty text has one
blank line; pages with a null host form one host; rows repeated under one id
count as pages of their own; a host on which a line is found on fewer than
``min_pages`` pages keeps that line whatever its share; a text of any length
is taken whole. Other columns of the input, of whatever name, are ignored by
counting and handed through unchanged by dropping; columns added by ``counts``
replace those of the same name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.runtime import discard, feed, ship, stored

#: Production parameters. A host's languages share its pages, so lines of the smaller ones are on few of them in a hundred.
RATIO, MIN_PAGES = 0.01, 3
#: Up to so many (host, line) rows are broadcast, 8 bytes each and each host's name once; more are joined by host and salt.
BROADCAST_LINES = 1_000_000
SALTS = 64
BLANKS = " \t\n\x0b\x0c\r"
_HOST, _LINE = "__host", "__line"


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line hash, pages with it, pages of the host) of each line above the ratio.

    Each page contributes a line once, and counts are added up before and
    after one shuffle by (host, line), so a host with most of all pages is
    spread like any other. Host totals are one row a host.
    """
    pages = docs.select(F.col(host).alias(_HOST), F.col(text).alias("t"))
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != ""), lambda x: F.xxhash64(x)))
    counts = pages.select(_HOST, F.explode(lines).alias(_LINE)).groupBy(_HOST, _LINE).agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy(F.col(_HOST).alias("h")).agg(F.count("*").alias("host_pages"))
    return counts.join(totals, F.col(_HOST).eqNullSafe(F.col("h"))).drop("h").where(F.col("pages") > ratio * F.col("host_pages"))


def _cleaned(text: str | None, drop: np.ndarray | None) -> tuple[str | None, int, int]:
    """The text without the lines whose hashes are in drop, sorted; lines before, lines dropped."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if drop is None or not len(drop):
        return text, len(lines), 0
    bare = [x.strip(BLANKS) for x in lines]
    hashes = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in bare], np.uint64)
    bad = (drop[np.minimum(np.searchsorted(drop, hashes), len(drop) - 1)] == hashes).tolist()
    if not any(bad):
        return text, len(lines), 0
    kept = [x for x, s, gone in zip(lines, bare, bad) if not gone or not s]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """The documents with boilerplate lines taken out of ``text``.

    counts names two columns to add, lines before and lines dropped. Rows,
    their order within partitions and all other columns stay.
    """
    spark = docs.sparkSession
    ship(spark)
    found = stored(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    given = feed(docs, [host, text], [(c, T.LongType()) for c in counts or ()])
    kept, (host_at, text_at), place = given.kept, given.at, given.schema.fieldNames().index(text)

    def cleaned(b: pa.RecordBatch, drops: Iterator[np.ndarray | None]) -> pa.RecordBatch:
        rows = [_cleaned(t.as_py(), d) for t, d in zip(b.column(text_at), drops)]
        columns = b.columns[:kept]
        columns[place] = pa.array([r[0] for r in rows], pa.string())
        columns += [pa.array([r[k] for r in rows], pa.int64()) for k in ((1, 2) if counts else ())]
        return pa.RecordBatch.from_arrays(columns, names)

    names = given.schema.fieldNames()
    if found.count() <= BROADCAST_LINES:
        by_host = spark.sparkContext.broadcast(_by_host(found.select(_HOST, _LINE).toArrow()))
        discard(found)

        def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield cleaned(b, (by_host.value.get(h) for h in b.column(host_at).to_pylist()))

        return given.rows.mapInArrow(small, given.schema)

    per_host = found.groupBy(F.col(_HOST).alias("h")).agg(F.collect_set(_LINE).alias("drop")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    columns = given.rows.columns
    salted = given.rows.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{columns[host_at]}`").alias("host"), F.pmod(F.xxhash64(F.col(f"`{columns[text_at]}`")), F.lit(SALTS)).cast("int").alias("s"))
    joined = salted.join(per_host, F.col("host").eqNullSafe(F.col("h")) & (F.col("s") == F.col("salt")), "left").select("row", "drop")

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drops = (None if d.as_py() is None else np.sort(np.asarray(d.values, np.int64).view(np.uint64)) for d in b.column(1))
            yield cleaned(pa.RecordBatch.from_struct_array(b.column(0)), drops)

    return joined.mapInArrow(large, given.schema)


def _by_host(found: pa.Table) -> dict[str | None, np.ndarray]:
    """The sorted line hashes of each host."""
    host, line = found.column(0).combine_chunks().dictionary_encode("encode"), found.column(1).to_numpy().view(np.uint64)
    number = host.indices.to_numpy()
    order = np.lexsort((line, number))
    bounds = np.searchsorted(number[order], np.arange(len(host.dictionary) + 1))
    return {h: line[order[a:b]] for h, a, b in zip(host.dictionary.to_pylist(), bounds, bounds[1:])}


def query(spark, sf_dir):
    """op1: every document with its source's boilerplate lines dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_lines(docs, counts=("n_lines", "n_dropped"))


SQL = f"""
with pages as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
words as (select source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))), lambda x: x <> ''))) as line from pages),
counts as (select source, line, count(*) as n from words group by all having count(*) >= {MIN_PAGES}),
totals as (select source, count(*) as host_pages from pages group by source),
drops as (select c.source, list(c.line) as bad from counts c join totals t on c.source is not distinct from t.source where c.n > {RATIO}::double * t.host_pages group by c.source),
kept as (select p.doc_id, p.source, p.text, p.lines, case when p.lines is null then null when d.bad is null then p.lines else list_filter(p.lines, lambda x: not list_contains(d.bad, trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))))) end as rest
  from pages p left join drops d on p.source is not distinct from d.source)
select doc_id, source, case when text is null then null when len(rest) = 0 then '' else array_to_string(rest, chr(10)) end as text,
  coalesce(len(lines), 0)::bigint as n_lines, coalesce(len(lines) - len(rest), 0)::bigint as n_dropped from kept
"""
