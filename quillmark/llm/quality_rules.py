"""Quality rules with perplexity bands of byte n-gram models by language.

Every text counts towards a modified Kneser-Ney model of its language: bytes,
ORDER or more at a time, are counted by Spark; probabilities and back-off weights,
interpolated over all orders, are stored as sorted arrays of n-gram keys,
which workers map into memory. A text's perplexity is judged against bands
around its language's median, wider for short texts: both text that no model
expects (symbols, shouting) and text that is too easily predicted (repetition)
fall outside.

Orders SPREAD and up are dealt to shards by language and context, as many as
the language's text needs, so no task has all n-grams of a language; the
orders below have at most 65,536 n-grams. How many different bytes precede an
n-gram is summed by a shuffle from each order to the next one below, and
probabilities are made from the lowest order up. Percentiles are exact ones of
values on a grid of GRID, from a histogram by language, so they do not depend
on how rows are partitioned.

Defined cases: null and empty texts have no words, fail the base rules and
have perplexity null; null and empty languages share one model and band; a
band counts as FEW texts of all languages besides its own, so that of a rare
language is near the common one; repeated rows count and are judged each;
texts of any length are read whole; an empty table gives no rows; null ids
play no part; other columns go through, but for those named like the added
ones, which take their place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import kneser_ney as kn
from quillmark.llm import textops as tx
from quillmark.llm.runtime import discard, feed, new_path, ship, stored

#: Bytes of an n-gram, unless a caller names more (up to 7), and of those of the query.
ORDER, QUERY_ORDER = 4, 6
#: The lowest order dealt to shards; text of a shard, and shards of a language at most; languages counted in one pass
#: at most, as far as a key has room for their numbers.
SPREAD, SHARD_BYTES, SHARDS, LANGUAGES = 3, 16 << 20, 1 << 16, 1 << 16
#: Texts of all languages that count towards a language's band, and the grid of values whose percentiles are taken.
FEW, GRID = 50, 1e-4
#: A band reaches so many interquartile ranges beyond the quartiles of deviations from a language's median log
#: perplexity. Deviations are taken in units that widen for short texts: at NOISE_BYTES chance doubles their variance.
REACH, NOISE_BYTES = 2.5, 1000
#: Fixed values of the base rules.
MIN_WORDS, REPEAT_WORDS, REPEAT_PERCENT, SYMBOLS = 20, 8, 30, b"#*$%&|<>"
OTHER = ""

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
#: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_features(c: tx.Chunk) -> np.ndarray:
    """Texts by the five base features."""
    n = len(c)
    w = tx.words(c)
    h = tx.word_hashes(c, w)
    out = np.zeros((n, 5), np.int64)
    out[:, 0] = np.diff(w.of)
    begins = np.concatenate([[0], np.cumsum(c.data & 0xC0 != 0x80)])
    chars = np.concatenate([[0], np.cumsum(begins[w.end] - begins[w.start])])
    out[:, 1] = np.diff(chars[w.of])
    out[:, 2] = np.diff(np.concatenate([[0], np.cumsum(_IS_SYMBOL[c.data])])[c.offsets])

    breaks = np.flatnonzero(c.data == 10)
    edges = np.unique(np.concatenate([c.offsets[:-1], breaks + 1]))
    edges = edges[edges < len(c.data)]
    text_of = np.searchsorted(c.offsets, edges, "right") - 1
    ends = np.minimum(np.concatenate([breaks, [len(c.data)]])[np.searchsorted(breaks, edges)], c.offsets[text_of + 1])
    wordy = np.searchsorted(w.start, ends) > np.searchsorted(w.start, edges)
    edges, ends, text_of = edges[wordy], ends[wordy], text_of[wordy]
    lines = tx.span_hashes(c.data, edges, ends) if len(edges) else np.zeros(0, np.uint64)
    first = np.unique(_in_text(lines, text_of), return_index=True)[1]
    out[:, 3] = np.bincount(text_of, minlength=n) - np.bincount(text_of[first], minlength=n)

    g, bounds = tx.windows(h, w.of, REPEAT_WORDS)
    window_of = np.repeat(np.arange(n), np.diff(bounds))
    _, which, times = np.unique(_in_text(g, window_of), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    start = again - bounds[window_of[again]] + w.of[window_of[again]]
    cover = np.zeros(len(h) + 1, np.int32)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + REPEAT_WORDS, -1)
    out[:, 4] = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])[w.of])
    return out


def _in_text(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Hashes that differ from text to text."""
    return tx.mix(hashes ^ tx.mix(text_of.astype(np.uint64) + np.uint64(1)))


def ngrams(c: tx.Chunk, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, zero bytes standing before a text."""
    keys = np.zeros(len(c.data), np.uint64)
    place = np.arange(len(c.data)) - np.repeat(c.offsets[:-1], np.diff(c.offsets))
    for back in range(order):
        b = np.zeros(len(c.data), np.uint64)
        b[back:] = c.data[: len(c.data) - back] if back else c.data
        b[place < back] = 0
        keys |= b << np.uint64(8 * back)
    return keys


def _low(order: int) -> np.uint64:
    """The bits of an n-gram's bytes."""
    return np.uint64((1 << 8 * order) - 1)


def interpolated(key: np.ndarray, count: np.ndarray, d: np.ndarray, below: np.ndarray) -> list[np.ndarray]:
    """Keys, log probabilities, contexts and their log back-off weights, from complete contexts."""
    context = key >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    off = d[np.minimum(count, 3).astype(int)]
    total = np.add.reduceat(count, first).astype(float)
    weight = np.add.reduceat(off, first) / total
    sizes = np.diff(first, append=len(key))
    p = np.maximum(count - off, 0) / np.repeat(total, sizes) + np.repeat(weight, sizes) * below
    return [key, np.log(p).astype(np.float32), context[first], np.log(weight).astype(np.float32)]


def lowest_orders(keys: np.ndarray, counts: np.ndarray, order: int = SPREAD - 1) -> list[np.ndarray]:
    """The arrays of each order up to this one, from 1, and the log probability of a byte never seen."""
    levels = [(keys, counts)]
    for k in range(order - 1, 0, -1):
        levels.append(kn.merged(levels[-1][0] & _low(k), np.ones(len(levels[-1][0]), np.uint64)))
    out: list[np.ndarray] = []
    for k, (key, count) in enumerate(levels[::-1], 1):
        below = np.full(len(key), 1 / 256) if k == 1 else np.exp(out[-3][kn.find(out[-4], key & _low(k - 1))[0]])
        out += interpolated(key, count, kn.discounts(kn.count_of_counts(count)), below)
    return [*out, out[3] - np.float32(np.log(256))]


@dataclass
class Language:
    """One language's model: the file of its lowest orders, and by shard those of a higher order's n-grams and of the rest."""

    number: int
    shards: int
    first_shard: int
    order: int = ORDER
    lowest: str = ""
    spread: dict[int, list[list[str]]] = field(default_factory=dict)

    def shard_of(self, context: np.ndarray) -> np.ndarray:
        return (tx.mix(context | np.uint64(self.number) << np.uint64(8 * self.order)) % np.uint64(self.shards)).astype(np.int64)

    def _found(self, order: int, keys: np.ndarray, contexts: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of n-grams, or log weights of contexts, and which there are."""
        place = 2 if contexts else 0
        if order < SPREAD:
            found, values = kn.arrays(self.lowest)[4 * (order - 1) + place :][:2]
            at, there = kn.find(found, keys)
            return np.where(there, values[at], 0.0), there
        out, there = np.zeros(len(keys)), np.zeros(len(keys), bool)
        shard = self.shard_of(keys if contexts else keys >> np.uint64(8))
        rows = np.argsort(shard, kind="stable")
        for s, a, b in kn.runs(shard[rows]):
            if files := self.spread[order][s]:
                mine, (p, *of_contexts) = rows[a:b], kn.arrays(files[1])
                found, values = of_contexts if contexts else (kn.mapped(files[0]), p)
                at, there[mine] = kn.find(found, keys[mine])
                out[mine] = np.where(there[mine], values[at], 0.0)
        return out, there

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """The natural log probability of each n-gram's last byte after the bytes before it."""
        out, todo, off = np.zeros(len(keys)), np.arange(len(keys)), np.zeros(len(keys))
        for k in range(self.order, 0, -1):
            now = keys[todo] & _low(k)
            p, there = self._found(k, now, False)
            out[todo[there]] = p[there] + off[todo[there]]
            todo, now = todo[~there], now[~there]
            if len(todo) and k > 1:
                off[todo] += self._found(k, now >> np.uint64(8), True)[0]
        if len(todo):
            out[todo] = off[todo] + kn.arrays(self.lowest)[-1][0]
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", shard_bytes: int = SHARD_BYTES, order: int = ORDER) -> dict[str, Language]:
    """Each language's model; OTHER stands for null. More languages than a pass holds take several passes over the texts."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(text).cast("string").alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit(OTHER)).alias("l"))
    sizes = rows.groupBy("l").agg(F.sum(F.octet_length("t")).alias("size")).where("size > 0").orderBy("l").collect()
    model: dict[str, Language] = {}
    room = min(LANGUAGES, 1 << 64 - 8 * order)
    for i in range(0, len(sizes), room):
        model |= _train(spark, rows, {r["l"]: r["size"] for r in sizes[i : i + room]}, shard_bytes, order)
    return model


def _train(spark, rows: DataFrame, sizes: dict[str, int], shard_bytes: int, top: int) -> dict[str, Language]:
    """The models of some languages, from their bytes."""
    folder = new_path(spark, "quality-model")
    model: dict[str, Language] = {}
    for i, (name, size) in enumerate(sizes.items()):
        shards = min(SHARDS, 1 + size // shard_bytes)
        model[name] = Language(i, shards, sum(m.shards for m in model.values()), top, spread={k: [[] for _ in range(shards)] for k in range(SPREAD, top + 1)})
    numbers, at_language = {name: m.number for name, m in model.items()}, np.uint64(8 * top)
    shards, first = (np.array([getattr(m, x) for m in model.values()], np.uint64) for x in ("shards", "first_shard"))
    language_of = [m.number for m in model.values() for _ in range(m.shards)]

    def keys_of(c: tx.Chunk, b: pa.RecordBatch) -> np.ndarray:
        number = np.repeat(np.array([numbers.get(x, -1) for x in b.column(1).slice(c.first, len(c)).to_pylist()], np.int64), np.diff(c.offsets))
        mine = number >= 0
        return ngrams(c, top)[mine] | number[mine].astype(np.uint64) << at_language

    def shard_of(keys: np.ndarray) -> np.ndarray:
        number = keys >> at_language
        context = (keys & _low(top)) >> np.uint64(8)
        return (first[number] + tx.mix(context | number << at_language) % shards[number]).astype(np.int64)

    def merge(order: int) -> Callable[[pa.Table], pa.Table]:
        """Files a shard's n-grams of an order, and sends those of the order below on."""

        def run(table: pa.Table) -> pa.Table:
            shard, keys, counts = kn.gathered(table)
            files = [kn.saved(folder, f"{order}-{shard}-keys", keys & _low(top)), kn.saved(folder, f"{order}-{shard}-counts", kn.narrow(counts))]
            number = np.uint64(language_of[shard]) << at_language
            lower = kn.blobs(*kn.merged(keys & _low(order - 1) | number, np.ones(len(keys), np.uint64)), shard_of if order > SPREAD else lambda k: (k >> at_language).astype(np.int64))
            out = [{"key": shard, "files": files, "n": kn.count_of_counts(counts)}]
            return pa.Table.from_pylist(out + [{"key": r["shard"], "keys": r["keys"], "counts": r["counts"]} for r in lower.to_pylist()], _MERGED)

        return run

    def lowest(table: pa.Table) -> pa.Table:
        number, keys, counts = kn.gathered(table)
        return pa.table({"key": pa.array([number], pa.int64()), "file": [kn.saved(folder, f"low-{number}", *lowest_orders(keys & _low(top), counts))]})

    sent, filed = kn.counted(rows, keys_of, shard_of, 1 << 20), {}
    for k in range(top, SPREAD - 1, -1):
        found = stored(sent.groupBy("shard").applyInArrow(merge(k), "key long, files array<string>, n array<long>, keys binary, counts binary"), f"quality-{k}")
        filed[k] = found
        sent = found.where("files is null").select(F.col("key").cast("int").alias("shard"), "keys", "counts")
    by = list(model.values())
    for r in stored(sent.groupBy("shard").applyInArrow(lowest, "key long, file string"), "quality-low").collect():
        by[r["key"]].lowest = r["file"]
    for k in range(SPREAD, top + 1):
        _finish(spark, filed[k], by, language_of, k, folder)
        discard(filed[k])
    return model


_MERGED = pa.schema([("key", pa.int64()), ("files", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("keys", pa.binary()), ("counts", pa.binary())])


def _finish(spark, filed: DataFrame, by: list[Language], language_of: list[int], order: int, folder: str) -> None:
    """Make an order's probabilities by shard, when those of the order below are there."""
    shards = filed.where("files is not null").select("key", "files", "n")
    n = np.zeros((len(by), 4), np.int64)
    for r in shards.select("key", "n").collect():
        n[language_of[r["key"]]] += np.array(r["n"])
    d, given = [kn.discounts(x.tolist()) for x in n], spark.sparkContext.broadcast(by)

    def run(table: pa.Table) -> pa.Table:
        shard, files = table.column("key")[0].as_py(), table.column("files")[0].as_py()
        keys, counts, number = kn.mapped(files[0]), kn.mapped(files[1]).astype(np.uint64), language_of[shard]
        below = np.exp(given.value[number]._found(order - 1, keys & _low(order - 1), False)[0])
        files[1] = kn.saved(folder, f"{order}-{shard}", *interpolated(keys, counts, d[number], below)[1:])
        return pa.table({"key": pa.array([shard], pa.int64()), "files": pa.array([files], pa.list_(pa.string()))})

    # a row a shard
    for r in stored(shards.groupBy("key").applyInArrow(run, "key long, files array<string>"), f"quality-files-{order}").collect():
        m = by[language_of[r["key"]]]
        m.spread[order][r["key"] - m.first_shard] = r["files"]


def measure(docs: DataFrame, model: dict[str, Language], text: str = "text", lang: str = "lang", names: tuple[str, ...] = (*BASE, "n_bytes", "lang_band", "log_perplexity")) -> DataFrame:
    """The rows with base features, bytes, the language that judges them and log perplexity a byte."""
    ship(docs.sparkSession)
    kinds = [*([T.LongType()] * 6), T.StringType(), T.DoubleType()]
    given, sent = feed(docs, [text, lang], list(zip(names, kinds))), docs.sparkSession.sparkContext.broadcast(model)
    order = max((m.order for m in model.values()), default=ORDER)
    kept, (t, l), fields = given.kept, given.at, given.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = [OTHER if x is None else str(x) for x in b.column(l).to_pylist()]
            base, logs, sizes = [], [], []
            for c in tx.chunks(b.column(t)):
                base.append(base_features(c))
                keys, mine, lengths = ngrams(c, order), np.array(langs[c.first : c.first + len(c)], object), np.diff(c.offsets)
                sizes.append(lengths)
                p = np.zeros(len(keys))
                for name in set(mine.tolist()):
                    at = np.flatnonzero(np.repeat(mine == name, lengths))
                    if len(at):
                        different, which = np.unique(keys[at], return_inverse=True)
                        p[at] = sent.value[name].log_probabilities(different)[which] if name in sent.value else -np.log(256)
                sums = np.diff(np.concatenate([[0], np.cumsum(p)])[c.offsets])
                logs += [float(-s / n) if n else None for s, n in zip(sums, lengths)]
            if base:
                features = np.concatenate(base)
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], *(pa.array(features[:, k]) for k in range(5)), pa.array(np.concatenate(sizes)), pa.array(langs, pa.string()), pa.array(logs, pa.float64())], fields)

    return given.rows.mapInArrow(run, given.schema)


def judge(measured: DataFrame) -> DataFrame:
    """The measured rows with base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = measured.withColumn("base_failed", failed)
    passed = F.col("log_perplexity").isNotNull() & ~F.col("base_failed")
    rows = _with_percentiles(rows, passed, F.col("log_perplexity"), [0.5], "_m")
    unit = F.sqrt(1 + NOISE_BYTES / F.greatest("n_bytes", F.lit(1)))
    rows = rows.withColumn("_d", (F.col("log_perplexity") - F.col("_m")[0]) / unit)
    rows = _with_percentiles(rows, passed, F.col("_d"), [0.25, 0.75], "_q")
    low, high = F.col("_q")[0], F.col("_q")[1]
    reach = (high - low) * REACH
    inside = F.coalesce(F.col("_d").between(low - reach, high + reach), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & inside).drop("_m", "_d", "_q")


def _with_percentiles(rows: DataFrame, used: Column, value: Column, shares: list[float], name: str) -> DataFrame:
    """Rows with percentiles of a value over the used rows of their language, and a part of those over all."""
    histogram = rows.where(used).groupBy(F.col("lang_band").alias("_lang"), F.round(value / GRID).cast("long").alias("_g")).agg(F.count("*").alias("_c"))
    own = _percentiles(histogram, ["_lang"], shares, "_own")
    whole = _percentiles(histogram.groupBy("_g").agg(F.sum("_c").alias("_c")).withColumn("_lang", F.col("_c") < 0), ["_lang"], shares, "_all").select("_all")
    # one row a language, and one row
    joined = rows.join(F.broadcast(own), F.col("lang_band") == F.col("_lang"), "left").join(F.broadcast(whole), how="left")
    n = F.coalesce("_n", F.lit(0))
    mixed = [(n * F.coalesce(F.col("_own")[i], F.lit(0.0)) + FEW * F.col("_all")[i]) / (n + FEW) for i in range(len(shares))]
    return joined.withColumn(name, F.array(*mixed)).drop("_lang", "_own", "_n", "_all")


def _percentiles(histogram: DataFrame, by: list[str], shares: list[float], name: str) -> DataFrame:
    """(by, name, _n): the least values that so large a share of a histogram does not exceed. A histogram has as many rows as the grid has places."""
    up, all_ = Window.partitionBy(*by).orderBy("_g"), Window.partitionBy(*by)
    ranked = histogram.withColumn("_up", F.sum("_c").over(up)).withColumn("_n", F.sum("_c").over(all_))
    values = [F.min(F.when(F.col("_up") >= s * F.col("_n"), F.col("_g"))) * GRID for s in shares]
    return ranked.groupBy(*by).agg(F.array(*values).alias(name), F.max("_n").alias("_n"))


def query(spark, sf_dir):
    """op2: every document's base features and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    narrow = stored(measure(docs, train(docs, order=QUERY_ORDER)).select("doc_id", *BASE, "n_bytes", "lang_band", "log_perplexity"), "measured")
    return judge(narrow).select("doc_id", *BASE, "base_failed", "kept", F.exp("log_perplexity").alias("perplexity"))
