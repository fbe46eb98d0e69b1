"""Scores of texts under an interpolated modified Kneser-Ney model of three words.

Tokens are words (A-Z lower-cased) and one end a text; two begins stand before
it. The vocabulary is counted first; a word's number is its place among all
sorted word hashes, so two words are one exact 64-bit key. Triples are counted
by shard of their middle word: a shard has all that its middle words need at
both higher orders, the triples by their first two words and the pairs by how
many different words precede them. A word so common that it would fill a
shard has its triples spread over all by their first two words; what precedes
its pairs is summed in a second shuffle. How many different words precede a
word is summed in a third. Nothing is pruned.

All arrays are sorted, in five files a shard in the shared folder, mapped into
memory by the workers, which hold no open file for them. The driver sees only
lists of files, the common words' sums (COMMON words a shard at most) and a
few totals.

p(w | u v) = max(c(uvw) - D, 0) / c(uv.) + g(uv) p(w | v), the next order
likewise with the number of different words before a pair in place of its
count, the last one over the number of different pairs and with
g / (V + 1) for any word; each order has three discounts from its counts of
counts. After words never seen together the next lower order is used alone.

Defined cases: null and empty texts are an end alone; a null id is not in the
training part and not held out; repeated rows count and score each; texts of
any length are read whole; without training rows every token has probability
1; an empty table gives no rows; other columns go through, but for those named
like the added ones, which take their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import kneser_ney as kn
from quillmark.llm import textops as tx
from quillmark.llm.quality_classifier import fold
from quillmark.llm.runtime import discard, feed, new_path, ship, stored

#: Text of a shard, and shards at most.
SHARD_BYTES, SHARDS = 12 << 20, 1 << 16
FOLDS, HELD_FOLD = 7, 2
#: Words that are a share of 1 / (COMMON * shards) of all tokens or more are spread over all shards.
COMMON = 2
END = tx.stream(31, 1)[0]
UNKNOWN = np.uint64(0xFFFFFFFF)
CHUNK_BYTES = 4 << 20
_32 = np.uint64(32)


def tokens(c: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text with its end, and their bounds by text."""
    c = tx.lowered(c)
    w = tx.words(c)
    of = w.of + np.arange(len(w.of))
    out = np.full(of[-1], END, np.uint64)
    inside = np.ones(of[-1], bool)
    inside[of[1:] - 1] = False
    out[inside] = tx.word_hashes(c, w)
    return out, of


def triples(context: np.ndarray, word: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (context, word) in order, and the sums of their counts (1 each if None)."""
    kinds, number = np.unique(context, return_inverse=True)
    key, counts = kn.merged(number.astype(np.uint64) << _32 | word, counts)
    return kinds[(key >> _32).astype(np.int64)], key & UNKNOWN, counts


def search(values: np.ndarray, low: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value is among values[low:end], which are sorted, and whether it is there."""
    high, last = end, len(values) - 1
    while (open_ := low < high).any():
        middle = low + high >> 1
        less = values[np.minimum(middle, last)] < wanted
        low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
    return low, (low < end) & (values[np.minimum(low, last)] == wanted) if last >= 0 else np.zeros(len(wanted), bool)


@dataclass
class Keys:
    """Sorted 64-bit keys: different high halves, where each begins, and low halves."""

    arrays: list[np.ndarray]

    @staticmethod
    def parts(keys: np.ndarray) -> list[np.ndarray]:
        heads, first = np.unique(keys >> _32, return_index=True)
        return [heads.astype(np.uint32), kn.narrow(np.append(first, len(keys))), (keys & UNKNOWN).astype(np.uint32)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads, begin, lows = self.arrays
        at, there = kn.find(heads, (keys >> _32).astype(np.uint32))
        if not len(heads):
            return at, there
        low = begin[at].astype(np.int64)
        return search(lows, low, np.where(there, begin[at + 1].astype(np.int64), low), (keys & UNKNOWN).astype(np.uint32))


@dataclass
class Table:
    """Followers of contexts, in one file. Contexts seen once have their only follower beside them.

    Others have where their followers begin, sums by context, followers and
    their counts.
    """

    file: str

    @staticmethod
    def save(folder: str, name: str, context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> str:
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        sizes = np.diff(first, append=len(context))
        alone = (sizes == 1) & (counts[first] == 1)
        mine = ~np.repeat(alone, sizes)
        begin, n = np.concatenate([[0], np.cumsum(sizes[~alone])]), counts[mine]
        sums = [np.add.reduceat(x.astype(np.uint64), begin[:-1]) if len(n) else np.zeros(0, np.uint64) for x in (n, n == 1, n == 2, n > 2)]
        arrays = word[first[alone]].astype(np.uint32), kn.narrow(begin), kn.narrow(sums[0]), kn.narrow(np.stack(sums[1:], axis=1)), word[mine].astype(np.uint32), kn.narrow(n)
        return kn.saved(folder, name, *Keys.parts(context[first[alone]]), *Keys.parts(context[first[~alone]]), *arrays)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of (context, word), and (total, followers of count 1, 2, 3 or more) of the context; 0 where there is none."""
        arrays = kn.arrays(self.file)
        once, often, (only, begin, total, kinds, words, counts) = Keys(arrays[:3]), Keys(arrays[3:6]), arrays[6:]
        count, after = np.zeros(len(word), np.uint64), np.zeros((len(word), 4), np.uint64)
        at, there = once.find(context)
        mine = np.flatnonzero(there)
        after[mine, :2] = 1
        count[mine] = only[at[mine]] == word[mine]
        at, there = often.find(context)
        mine = np.flatnonzero(there)
        at = at[mine]
        after[mine, 0], after[mine, 1:] = total[at], kinds[at]
        place, hit = search(words, begin[at].astype(np.int64), begin[at + 1].astype(np.int64), word[mine].astype(np.uint32))
        count[mine[hit]] = counts[place[hit]]
        return count, after


@dataclass
class Model:
    parts: int
    shards: int
    #: By part: the file of word hashes and counts, and the first number of the part.
    words: list[str] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    #: Files of how many different words precede each, by range of ``per`` numbers.
    preceding: dict[int, str] = field(default_factory=dict)
    per: int = 1
    #: By shard: followers of two words, of one word, and keys and counts of pairs that begin with a common word.
    triples: dict[int, Table] = field(default_factory=dict)
    pairs: dict[int, Table] = field(default_factory=dict)
    common_pairs: dict[int, str] = field(default_factory=dict)
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    common_stats: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.uint64))
    total: int = 0
    size: int = 0
    #: Of triples, pairs and words.
    discounts: list[np.ndarray] = field(default_factory=lambda: [kn.discounts([0] * 4)] * 3)
    #: Different pairs, and the probability left to unseen words in the lowest order.
    kinds: int = 0
    rest: float = 1.0

    @property
    def begin(self) -> np.uint64:
        """The number of the places before a text."""
        return np.uint64(self.size)

    def part_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> _32) * np.uint64(self.parts) >> _32).astype(np.int64)

    def numbers(self, hashes: np.ndarray, also: tuple[str, ...] = ()) -> list[np.ndarray]:
        """The numbers of sorted word hashes, and counts or preceding words of each (0 if unknown)."""
        out = [np.full(len(hashes), UNKNOWN), *(np.zeros(len(hashes), np.uint64) for _ in also)]
        part = self.part_of(hashes)
        for p, a, b in kn.runs(part):
            if not self.words[p]:
                continue
            at, there = kn.find(kn.mapped(self.words[p]), hashes[a:b])
            out[0][a:b][there] = at[there].astype(np.uint64) + np.uint64(self.first[p])
            for k, name in enumerate(also, 1):
                out[k][a:b][there] = self._values(name, p, at[there])
        return out

    def _values(self, name: str, part: int, at: np.ndarray) -> np.ndarray:
        """Counts, or preceding words, of places in a part."""
        if name == "counts":
            return kn.arrays(self.words[part])[1][at]
        out, number = np.zeros(len(at), np.uint64), at + self.first[part]
        for k, a, b in kn.runs(number // self.per):
            if k in self.preceding:
                out[a:b] = kn.mapped(self.preceding[k])[number[a:b] - k * self.per]
        return out

    def sequences(self, c: tx.Chunk, number: np.ndarray, which: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two words before each token as one key, the nearer one first, and its own number."""
        w = number[which]
        v = np.concatenate([[self.begin], w[:-1]])
        v[of[:-1]] = self.begin
        u = np.concatenate([[self.begin], v[:-1]])
        u[of[:-1]] = self.begin
        return v << _32 | u, w

    def is_common(self, v: np.ndarray) -> np.ndarray:
        return kn.find(self.common, v)[1]

    def shard_of(self, context: np.ndarray) -> np.ndarray:
        """The shard of two words: that of the nearer one, or of both where that is common."""
        v = context >> _32
        return (np.where(self.is_common(v), tx.mix(context), tx.mix(v)) % np.uint64(self.shards)).astype(np.int64)

    def pair_shard_of(self, keys: np.ndarray) -> np.ndarray:
        return (tx.mix(keys) % np.uint64(self.shards)).astype(np.int64)

    def triple_stats(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._dealt(self.triples, self.shard_of(context), context, word)

    def pair_stats(self, v: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many different words precede each pair, and the sums of that over what follows its first word."""
        at, common = kn.find(self.common, v)
        count, after = self._dealt(self.pairs, np.where(common, -1, (tx.mix(v) % np.uint64(self.shards)).astype(np.int64)), v, word)
        after[common] = self.common_stats[at[common]]
        mine = np.flatnonzero(common)
        keys = v[mine] << _32 | word[mine]
        shard = self.pair_shard_of(keys)
        order = np.argsort(shard, kind="stable")
        for s, a, b in kn.runs(shard[order]):
            if file := self.common_pairs.get(s):
                found, counts = kn.arrays(file)
                at, there = kn.find(found, keys[order[a:b]])
                count[mine[order[a:b][there]]] = counts[at[there]]
        return count, after

    @staticmethod
    def _dealt(tables: dict[int, Table], shard: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, after = np.zeros(len(word), np.uint64), np.zeros((len(word), 4), np.uint64)
        order = np.argsort(shard, kind="stable")
        for s, a, b in kn.runs(shard[order]):
            if s in tables:
                mine = order[a:b]
                count[mine], after[mine] = tables[s].find(context[mine], word[mine])
        return count, after

    def _order(self, n: int, seen: np.ndarray, after: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of an order from counts, sums of the context, and the next lower order."""
        d, seen, after = self.discounts[n], seen.astype(float), after.astype(float)
        total = np.maximum(after[:, 0], 1)
        left = np.where(after[:, 0] > 0, after[:, 1:] @ d[1:] / total, 1.0)
        return np.maximum(seen - d[np.minimum(seen, 3).astype(int)], 0) / total + left * lower

    def scores(self, c: tx.Chunk) -> tuple[np.ndarray, ...]:
        """By text: tokens, known tokens, log10 under add-one counts and under the model."""
        flat, of = tokens(c)
        kinds, which = np.unique(flat, return_inverse=True)
        number, count, preceding = self.numbers(kinds, ("counts", "preceding"))
        base = np.log10((count + 1.0) / (self.total + 1.0 * (self.size + 1)))
        d = self.discounts[2][np.minimum(preceding, 3).astype(int)]
        lowest = np.maximum(preceding - d, 0) / max(self.kinds, 1) + self.rest / (self.size + 1)

        context, w = self.sequences(c, number, which, of)
        contexts, of_context = np.unique(context, return_inverse=True)
        different, place, back = np.unique(of_context.astype(np.uint64) << _32 | which.astype(np.uint64), return_index=True, return_inverse=True)
        context, w, word = context[place], w[place], which[place]
        v = context >> _32
        pairs, first, of_pair = np.unique(v << _32 | word.astype(np.uint64), return_index=True, return_inverse=True)
        middle = self._order(1, *self.pair_stats(v[first], w[first]), lowest[word[first]])
        p = np.log10(self._order(0, *self.triple_stats(context, w), middle[of_pair]))[back]
        known, start = count[which] > 0, of[:-1]
        return np.diff(of), np.add.reduceat(known.astype(np.int64), start), np.add.reduceat(base[which], start), np.add.reduceat(p, start)


def train(texts: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count and store a model of all the rows' texts."""
    spark = texts.sparkSession
    ship(spark)
    folder = new_path(spark, "model")
    texts = texts.select(F.col(text).cast("string").alias("t"))
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(4, min(SHARDS, ceil(size / shard_bytes)))
    model = Model(parts, parts)
    _count_words(texts, model, folder)
    if model.total:
        _count_triples(texts, model, folder)
    return model


def _count_words(texts: DataFrame, model: Model, folder: str) -> None:
    def write(table: pa.Table) -> pa.Table:
        part, keys, counts = kn.gathered(table)
        return pa.table({"part": [part], "n": [len(keys)], "total": [int(counts.sum())], "words": [kn.saved(folder, f"words-{part}", keys, counts)]})

    sent = kn.counted(texts, lambda c, b: tokens(c)[0], model.part_of, CHUNK_BYTES)
    rows = stored(sent.repartition(model.parts, "shard").groupBy("shard").applyInArrow(write, "part long, n long, total long, words string"), "words")
    got = {r["part"]: r for r in rows.toLocalIterator()}
    for p in range(model.parts):
        r = got.get(p)
        model.words.append(r["words"] if r else "")
        model.first.append(model.size)
        if r:
            model.size += r["n"]
            model.total += r["total"]
    if model.size >= int(UNKNOWN):
        raise ValueError("a vocabulary of over 4 billion words needs wider keys")
    # with the total known, at most COMMON * shards words of all parts reach it
    least, first = max(1, ceil(model.total / (COMMON * model.shards))), model.first

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file in zip(*(x.to_pylist() for x in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(kn.arrays(file)[1] >= least) + first[part])], ["number"])

    # texts begin as often as they end, so the places before a text are as common as the end
    if model.total:
        found = rows.select("part", "words").mapInArrow(top, "number long").collect()
        model.common = np.array(sorted({r["number"] for r in found} | {model.size}), np.uint64)


_ROWS = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("file", pa.string()), ("n", pa.list_(pa.int64())), ("keys", pa.binary()), ("counts", pa.binary())])
_KINDS = "kind string, key long, file string, n array<long>, keys binary, counts binary"


def _count_triples(texts: DataFrame, model: Model, folder: str) -> None:
    given = texts.sparkSession.sparkContext.broadcast(model)
    per = ceil(model.size / model.parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, size = given.value, [], 0

        def sent() -> pa.RecordBatch:
            context, word, counts = triples(*(np.concatenate(x) for x in zip(*held)))
            shard = m.shard_of(context)
            order = np.argsort(shard, kind="stable")
            parts = [(s, order[a:b]) for s, a, b in kn.runs(shard[order])]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), *(pa.array([pack(x[o]) for _, o in parts], pa.binary()) for pack, x in ((kn.pack_sorted, context), (kn.pack_small, word), (kn.pack_counts, counts)))], ["shard", "contexts", "words", "counts"])

        for b in batches:
            for c in tx.chunks(b.column(0), CHUNK_BYTES):
                flat, of = tokens(c)
                kinds, which = np.unique(flat, return_inverse=True)
                held.append(m.sequences(c, m.numbers(kinds)[0], which, of))
                size += len(flat)
                if size >= kn.HELD_KEYS // 2:
                    yield sent()
                    held.clear()
                    size = 0
        if size:
            yield sent()

    def before(pairs: np.ndarray) -> list[dict]:
        """How many different words each word follows, of complete pairs, by range of numbers."""
        found = kn.blobs(*kn.merged(pairs & UNKNOWN), lambda x: (x // np.uint64(per)).astype(np.int64))
        return [{"kind": "before", "key": r["shard"], "keys": r["keys"], "counts": r["counts"]} for r in found.to_pylist()]

    def write(table: pa.Table) -> pa.Table:
        m, shard = given.value, table.column("shard")[0].as_py()
        context, word, counts = triples(*(np.concatenate([unpack(x.as_buffer()) for x in table.column(n)]) for unpack, n in ((kn.unpack_sorted, "contexts"), (kn.unpack_small, "words"), (kn.unpack_counts, "counts"))))
        out = [{"kind": "triples", "key": shard, "file": Table.save(folder, f"triples-{shard}", context, word, counts), "n": kn.count_of_counts(counts)}]
        pairs, preceded = kn.merged((context >> _32) << _32 | word)
        del context, word, counts
        common = m.is_common(pairs >> _32)
        mine, n = pairs[~common], preceded[~common]
        out.append({"kind": "pairs", "key": shard, "file": Table.save(folder, f"pairs-{shard}", mine >> _32, mine & UNKNOWN, n), "n": [len(mine), *kn.count_of_counts(n)]})
        spread = kn.blobs(pairs[common], preceded[common], m.pair_shard_of)
        out += [{"kind": "common", "key": r["shard"], "keys": r["keys"], "counts": r["counts"]} for r in spread.to_pylist()]
        return pa.Table.from_pylist(out + before(mine), _ROWS)

    def write_common(table: pa.Table) -> pa.Table:
        shard, pairs, preceded = kn.gathered(table)
        v = pairs >> _32
        out = [{"kind": "pairs", "key": shard, "file": kn.saved(folder, f"common-{shard}", pairs, kn.narrow(preceded)), "n": [len(pairs), *kn.count_of_counts(preceded)]}]
        for number, a, b in kn.runs(v):
            n = preceded[a:b]
            out.append({"kind": "sums", "key": number, "n": [int(n.sum()), int((n == 1).sum()), int((n == 2).sum()), int((n > 2).sum())]})
        return pa.Table.from_pylist(out + before(pairs), _ROWS)

    sent = texts.mapInArrow(send, "shard int, contexts binary, words binary, counts binary")
    rows = stored(sent.repartition(model.shards, "shard").groupBy("shard").applyInArrow(write, _KINDS), "triples")
    blobs = rows.where("kind = 'common'").select(F.col("key").cast("int").alias("shard"), "keys", "counts")
    more = stored(blobs.repartition(model.shards, "shard").groupBy("shard").applyInArrow(write_common, _KINDS), "common")

    n = np.zeros((2, 4), np.int64)
    for r in rows.where("file is not null").select("kind", "key", "file", "n").toLocalIterator():
        is_pairs = r["kind"] == "pairs"
        (model.pairs if is_pairs else model.triples)[r["key"]] = Table(r["file"])
        n[int(is_pairs)] += np.array(r["n"][-4:])
        model.kinds += r["n"][0] if is_pairs else 0
    for r in more.where("file is not null").select("key", "file", "n").toLocalIterator():
        model.common_pairs[r["key"]] = r["file"]
        n[1] += np.array(r["n"][-4:])
        model.kinds += r["n"][0]
    sums = {r["key"]: r for r in more.where("kind = 'sums'").groupBy("key").agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(4))).toLocalIterator()}
    model.common_stats = np.array([[sums[int(v)][f"n{k}"] if int(v) in sums else 0 for k in range(4)] for v in model.common], np.uint64).reshape(-1, 4)
    words = _count_preceding(rows.unionAll(more), model, folder, per)
    model.discounts = [kn.discounts(n[0].tolist()), kn.discounts(n[1].tolist()), words]
    discard(rows, more)


def _count_preceding(rows: DataFrame, model: Model, folder: str, per: int) -> np.ndarray:
    """How many different words precede each: sums over shards, by ranges of ``per`` numbers; the discounts of words."""

    def write(table: pa.Table) -> pa.Table:
        k, keys, counts = kn.gathered(table)
        dense = np.zeros(per, np.uint64)
        dense[(keys - np.uint64(k * per)).astype(np.int64)] = counts
        return pa.table({"k": [k], "file": [kn.saved(folder, f"before-{k}", kn.narrow(dense))], "n": [kn.count_of_counts(counts) + [int((counts > 2).sum()), int(counts.sum())]]})

    sent = rows.where("kind = 'before'").select(F.col("key").cast("int").alias("shard"), "keys", "counts")
    got = stored(sent.repartition(model.parts, "shard").groupBy("shard").applyInArrow(write, "k long, file string, n array<long>"), "before").collect()
    n = np.zeros(6, np.int64)
    for r in got:
        model.preceding[r["k"]] = r["file"]
        n += np.array(r["n"])
    d = kn.discounts(n[:4].tolist())
    model.rest, model.per = float(np.array([n[0], n[1], n[4]]) @ d[1:] / max(1, n[5])), per
    return d


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, FOLDS) == HELD_FOLD, F.lit(False))


def in_training(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, FOLDS) != HELD_FOLD, F.lit(False))


def score(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, ...] = ("n_tokens", "n_known", "base_score", "score")) -> DataFrame:
    """The rows with tokens, known tokens and both scores of each text; one map, no shuffle."""
    ship(docs.sparkSession)
    kinds = (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    given, sent = feed(docs, [text], list(zip(names, kinds))), docs.sparkSession.sparkContext.broadcast(model)
    kept, at, fields = given.kept, given.at[0], given.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.scores(c) for c in tx.chunks(b.column(at), CHUNK_BYTES)]
            if got:
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], *(pa.array(np.concatenate(x)) for x in zip(*got))], fields)

    return given.rows.mapInArrow(run, given.schema)


def query(spark, sf_dir):
    """op6: every document's log10 probability under the model and under add-one counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(in_training(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
