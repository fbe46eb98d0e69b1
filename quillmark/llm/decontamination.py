"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be long, so the Jaccard similarity of
the two says nothing; what counts is the share of an item's shingles that a
document has. Items are partitioned by size into classes of a power of two.
Each has a bottom-k MinHash sketch: its k least shingle hashes, a uniform
sample of its set. A document becomes a candidate when it holds enough of
them, and candidates are verified on the complete shingle sets.

Each class has its own sketches: an item of m shingles of which at least
``threshold * m`` are in a document has at most ``m - ceil(threshold * m)``
others, so of a sketch of h entries more than that, a document that contains
the item always holds h. Larger classes ask for more hits (``hits``), so that
single shingles in common make no candidates of long items; none is missed in
any class.

Shingles are five words, A-Z lower-cased. An item of fewer words is one
shingle of its own length, and documents are read at that length too for it.
Defined cases: null or empty texts, and texts without words, match nothing on
either side; repeated rows and repeated ids each give rows of their own; null
ids are reported as null, and ids may be of any type; texts of any length are
searched whole; without items nothing is found, and an empty table gives no
rows; other columns, of whatever name, are ignored or, in ``clean``, kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import textops as tx
from quillmark.llm.runtime import ship

WORDS, THRESHOLD = 5, 0.8
#: Shingles of an item for each hit that its class asks for.
PER_HIT = 16
#: Items are searched in blocks of about so many bytes of text; a block is what is broadcast.
BLOCK_BYTES = 16 << 20


def hits(size: int) -> int:
    """Sketch entries that a candidate must hold, by the size class of an item."""
    return max(1, (1 << size.bit_length() - 1) // PER_HIT)


class Index:
    """The items of one block, by shingle length and size class."""

    def __init__(self, texts: list[str | None], n: int, threshold: float):
        self.threshold = threshold
        self.sets: dict[int, np.ndarray] = {}
        sketches: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for c in tx.chunks(pa.array(texts, pa.string())):
            low = tx.lowered(c)
            w = tx.words(low)
            h = tx.word_hashes(low, w)
            for i in range(len(c)):
                mine = h[w.of[i] : w.of[i + 1]]
                if not len(mine):
                    continue
                width = min(n, len(mine))
                s = np.unique(tx.windows(mine, np.array([0, len(mine)]), width)[0])
                # one hit at least, and never more than the shingles that must be there
                least = min(hits(len(s)), max(1, int(np.ceil(threshold * len(s) - 1e-9))))
                k = len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + least
                self.sets[c.first + i] = s
                sketches.setdefault((width, least), []).append((s[:k], c.first + i))
        #: By shingle length: the hits asked for, and sketch entries with their items, of each size class.
        self.parts: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for (width, least), found in sorted(sketches.items(), key=lambda x: x[0]):
            keys = np.concatenate([s for s, _ in found])
            items = np.repeat([i for _, i in found], [len(s) for s, _ in found])
            order = np.argsort(keys, kind="stable")
            self.parts.setdefault(width, []).append((least, keys[order], items[order]))

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item, shared shingles, shingles of the item) of each verified match."""
        out = []
        for c in tx.chunks(texts):
            low = tx.lowered(c)
            w = tx.words(low)
            h = tx.word_hashes(low, w)
            for width, parts in self.parts.items():
                g, bounds = tx.windows(h, w.of, width)
                pairs: set[tuple[int, int]] = set()
                for least, keys, items in parts:
                    first = np.searchsorted(keys, g)
                    hit = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == g)
                    text_of = np.searchsorted(bounds, hit, "right") - 1
                    held: Counter[tuple[int, int]] = Counter()
                    for t, key in set(zip(text_of.tolist(), g[hit].tolist())):
                        a, b = np.searchsorted(keys, np.uint64(key)), np.searchsorted(keys, np.uint64(key), "right")
                        held.update((t, i) for i in items[a:b].tolist())
                    pairs.update(x for x, n in held.items() if n >= least)
                have, of = np.zeros(0, np.uint64), -1
                for t, i in sorted(pairs):
                    if t != of:
                        have, of = np.unique(g[bounds[t] : bounds[t + 1]]), t
                    item = self.sets[i]
                    shared = int(np.isin(item, have, assume_unique=True).sum())
                    if shared >= self.threshold * len(item) - 1e-9:
                        out.append((c.first + t, i, shared, len(item)))
        return out


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[str | None]]]:
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    n = 1 + int((rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == b)
        got = part.orderBy("i", "t").toArrow()
        yield got.column("i").to_pylist(), got.column("t").to_pylist()


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each document and item found in it.

    One map over the documents a block of items, and no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    out = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("containment", T.DoubleType())])
    found = None
    for ids, texts in _blocks(items, item_id, item_text):
        given = spark.sparkContext.broadcast((ids, Index(texts, n, threshold)))

        def match(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            names, index = given.value
            for b in batches:
                hits = index.search(b.column(1))
                shared, size = np.array([x[2] for x in hits], np.int64), np.array([x[3] for x in hits], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([x[0] for x in hits], pa.int64())), pa.array([names[x[1]] for x in hits], kind), pa.array(shared), pa.array(size), pa.array(shared / np.maximum(size, 1))], out.names)

        kind = _arrow_type(items.schema[item_id].dataType)
        rows = docs.select(doc_id, text).mapInArrow(match, out)
        found = rows if found is None else found.unionAll(rows)
    return found


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that hold no item. One map a block of items, no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text)
    for _, texts in _blocks(items, item_id, item_text):
        given = spark.sparkContext.broadcast(Index(texts, n, threshold))

        def keep(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for b in batches:
                mask = np.ones(b.num_rows, bool)
                mask[[x[0] for x in given.value.search(b.column(at))]] = False
                yield b.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def query(spark, sf_dir):
    """op10: every document that holds a benchmark item, with the item."""
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Items of fewer than five words are one shingle of their own length; their documents' shingles are made at that length.
SQL = f"""
with item_words as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from benchmark where text is not null),
sized as (select row_number() over () as k, item_id, w, least(len(w), {WORDS}) as n from item_words where len(w) > 0),
item_sets as (select distinct k, item_id, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i : i + n - 1], ' '))) as s from sized),
sizes as (select k, count(*) as n_item from item_sets group by k),
doc_words as (select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents where text is not null),
doc_sets as (select distinct r, doc_id, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i : i + n - 1], ' '))) as s from doc_words, (select distinct n from sized) where len(w) >= n),
shared as (select r, doc_id, k, item_id, count(*) as n_shared from doc_sets join item_sets using (n, s) group by all)
select doc_id, item_id, n_shared, n_item, n_shared::double / n_item as containment from shared join sizes using (k) where n_shared >= {THRESHOLD} * n_item - 1e-9
"""
