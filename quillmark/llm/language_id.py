"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text of each language recognises all its
substrings. A document is parsed into phrases, each the longest match with
that text from where the last one ended; c phrases in N symbols cost c / N a
symbol. The language of the fewest such normalised phrases wins; equal ones go
to the first in sorted order. All languages are measured alike, so a language
of which little was learned explains little.

Symbols are A-Z in lower case, other letters' bytes as they are, and one
separator for each run of other bytes. All of each text is parsed, in lanes of
LANE symbols side by side, one vectorised step a symbol. A lane is parsed from
the beginning of a phrase first; then the phrase that is open at the end of
the lane before is carried into it, until both parses are in the same state,
from where on they are one. So results are those of one parse of the text.

Automata are dense tables of TOTAL symbols together, whatever the number of
languages, so what is broadcast does not grow with the input. Learned text is
drawn in pieces from many documents and places.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without learned languages so is every text; a null id is not held out and not
learned from; null languages are not learned; repeated rows are predicted
alike; texts of any length are parsed whole; an empty table gives no rows;
other columns go through, but for those named like the added ones, which take
their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import textops as tx
from quillmark.llm.quality_classifier import fold
from quillmark.llm.runtime import feed, ship

#: Symbols learned of a language at most, and of all together; languages share them evenly, as far as they have text.
SYMBOLS, TOTAL = 16_384, 8 * 16_384
#: Documents drawn of a language at least, by hash, and the length of the pieces taken from them.
DRAWN, PIECE = 96, 512
LANE, GROUP_BYTES = 2048, 6 << 20
FOLDS, HELD_FOLD = 4, 2

_SEPARATOR = 1
_BASE = np.full(256, _SEPARATOR, np.int16)
_BASE[97:123] = np.arange(2, 28)
_BASE[65:91] = _BASE[97:123]
_BASE[128:] = np.arange(28, 156)
ALPHABET = 156
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts and where each text's begin; runs of separators are one."""
    s = _BASE[data]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != _SEPARATOR) | (s[:-1] != _SEPARATOR)
    heads = offsets[:-1][offsets[:-1] < len(s)]
    keep[heads] = True
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return s[keep], bounds


class Automaton:
    """The suffix automaton of a symbol sequence as a dense table; 0 is both the root and no move."""

    def __init__(self, sequence: np.ndarray):
        moves, link, length, last = [{}], [-1], [0], 0
        for s in sequence.tolist():
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in moves[p]:
                moves[p][s] = new
                p = link[p]
            if p >= 0:
                q = moves[p][s]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(s) == q:
                        moves[p][s] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        used = np.unique(sequence)
        self.columns = np.zeros(ALPHABET, np.int32)
        self.columns[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        table = np.zeros((len(moves), self.width), np.int32)
        for state, out in enumerate(moves):
            for s, to in out.items():
                table[state, self.columns[s]] = to * self.width
        self.table = table.ravel()

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after a symbol, and phrases ended by it; in state 0 no phrase is open."""
        c = self.columns[symbol]
        to, begin = self.table[state + c], self.table[c]
        stuck = to == 0
        # a phrase ends before this symbol, or is this symbol, which no text learned has
        return np.where(stuck, begin, to), (stuck & (state > 0)).astype(np.int32) + (stuck & (begin == 0))

    def phrases(self, lanes: np.ndarray, size: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By lane, the phrases that end in it, and whether one is open at its end.

        lanes[t] has the t-th symbols of the lanes, longest lanes first, size
        their lengths; before has the lane that each continues, -1 for none.
        """
        n = lanes.shape[1]
        begin, state, count = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for t, m in enumerate(np.searchsorted(-size, -np.arange(len(lanes)), "left").tolist()):
            state[:m], ended = self._step(state[:m], lanes[t, :m])
            count[:m] += ended
        todo = np.flatnonzero(before >= 0)
        while len(todo := todo[begin[todo] != state[before[todo]]]):
            was, now = begin[todo], state[before[todo]]
            begin[todo] = now
            at, moved, t = todo, [], 0
            while len(at):
                symbol = lanes[t, at]
                was, less = self._step(was, symbol)
                now, more = self._step(now, symbol)
                count[at] += more - less
                t += 1
                apart, ends = was != now, size[at] == t
                over = apart & ends
                state[at[over]] = now[over]
                moved.append(at[over])
                apart &= ~ends
                at, was, now = at[apart], was[apart], now[apart]
            todo = np.flatnonzero(np.isin(before, np.concatenate(moved)))
        return count, state > 0


class Languages:
    """Automata of the texts of each language, of up to ``limits`` symbols."""

    def __init__(self, texts: dict[str, list[str]], limits: dict[str, int]):
        self.names = sorted(texts)
        self.automata = []
        for name in self.names:
            c = next(tx.chunks(pa.array([" ".join(texts[name])]), 1 << 40))
            self.automata.append(Automaton(symbols(c.data, c.offsets)[0][: limits[name]]))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for c in tx.chunks(texts, GROUP_BYTES):
            seq, bounds = symbols(c.data, c.offsets)
            cost = self._costs(seq, bounds)
            first = np.argmin(cost, axis=1) if self.names else np.zeros(len(c), int)
            for i in range(len(c)):
                raw = c.data[c.offsets[i] : c.offsets[i + 1]]
                if not self.names or not (_LETTER[raw].any() or (raw > 127).any() and any(ch.isalpha() for ch in raw.tobytes().decode())):
                    names.append("und")
                    scores.append(0.0)
                    continue
                best, rest = cost[i, first[i]], np.delete(cost[i], first[i])
                names.append(self.names[first[i]])
                scores.append(float(rest.min() / (rest.min() + best)) if len(rest) else 1.0)
        return names, np.array(scores)

    def _costs(self, seq: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases a symbol of each text under each language."""
        lengths = np.diff(bounds)
        per = -(-lengths // LANE)
        text_of = np.repeat(np.arange(len(lengths)), per)
        cost = np.zeros((len(lengths), len(self.names)))
        if not len(text_of):
            return cost
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(per) - per, per)
        start = bounds[:-1][text_of] + nth * LANE
        size = np.minimum(LANE, bounds[1:][text_of] - start)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order) + 1, np.int64)
        place[order], place[-1] = np.arange(len(order)), -1
        before = place[np.where(nth > 0, np.arange(len(order)) - 1, -1)][order]
        last = place[np.cumsum(per)[per > 0] - 1]
        text_of, start, size = text_of[order], start[order], size[order]
        lanes = np.zeros((len(size), int(size[0])), np.uint8)
        for row, a, n in zip(lanes, start.tolist(), size.tolist()):
            row[:n] = seq[a : a + n]
        lanes = np.ascontiguousarray(lanes.T)
        for k, a in enumerate(self.automata):
            count, open_ = a.phrases(lanes, size, before)
            cost[:, k] = np.bincount(text_of, count, len(lengths))
            cost[per > 0, k] += open_[last]
        return cost / np.maximum(lengths, 1)[:, None]


def _shares(have: list[int]) -> list[int]:
    """How many symbols each language gets of TOTAL: an even share, or all it has where that is less."""
    out, left = {}, TOTAL
    for rank, i in enumerate(sorted(range(len(have)), key=have.__getitem__)):
        out[i] = min(have[i], SYMBOLS, left // (len(have) - rank))
        left -= out[i]
    return [out[i] for i in range(len(have))]


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """Automata of a bounded sample of each language's documents outside the held-out fold.

    About so many documents of a language are drawn by hash as hold twice its
    share, and from each some pieces, evenly spread over its length.
    """
    spark = docs.sparkSession
    ship(spark)
    train = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (fold(F.col(doc_id), FOLDS) != HELD_FOLD))
    train = train.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    found = train.groupBy("l").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("size")).where("size > 0").orderBy("l").collect()
    if not found:
        return Languages({}, {})
    shares = dict(zip((r["l"] for r in found), _shares([r["size"] for r in found])))
    plan = []
    for r in found:
        want = 2 * shares[r["l"]]
        draw = max(DRAWN, want / min(PIECE, r["size"] / r["n"]))
        plan.append((r["l"], min(1.0, draw / r["n"]), want, int(np.ceil(want / (PIECE * min(r["n"], draw))))))
    # one row a language
    asked = F.broadcast(spark.createDataFrame(plan, "l string, share double, want int, most int"))
    drawn = train.join(asked, "l").where(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    size = F.char_length("t")
    pieces = F.least("most", F.ceil(size / PIECE)).cast("int")
    cut = F.transform(F.sequence(F.lit(1), pieces), lambda k: F.substring("t", F.floor((k - 1) * size / pieces).cast("int") + 1, F.lit(PIECE)))
    each = drawn.where(size > 0).select("l", "want", F.explode(cut).alias("t")).distinct().withColumn("h", F.xxhash64("t"))
    rows = Window.partitionBy("l").orderBy("h", "t").rowsBetween(Window.unboundedPreceding, -1)
    some = each.withColumn("sum", F.coalesce(F.sum(F.octet_length("t")).over(rows), F.lit(0))).where("sum < want")
    texts: dict[str, list[str]] = {}
    for r in some.select("l", "h", "t").orderBy("l", "h", "t").collect():
        texts.setdefault(r["l"], []).append(r["t"])
    return Languages(texts, shares)


def identify(docs: DataFrame, model: Languages, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows with predicted language and score; one map, no shuffle."""
    ship(docs.sparkSession)
    given, sent = feed(docs, [text], [(names[0], T.StringType()), (names[1], T.DoubleType())]), docs.sparkSession.sparkContext.broadcast(model)
    kept, at, fields = given.kept, given.at[0], given.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, scores = sent.value.predict(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(found, pa.string()), pa.array(scores, pa.float64())], fields)

    return given.rows.mapInArrow(run, given.schema)


def query(spark, sf_dir):
    """op8: every document's language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_FOLD, F.lit(False))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
