"""Packing documents into fixed windows by non-negative least squares.

A document is its token ids and one end id. Runs of a whole window are
sequences by themselves; what is left of a document is an item of 1 to
window - 1 ids. Items are packed a block at a time: shallow combinations of
one to three lengths that fill the window exactly are enumerated, repeat
counts for them are solved against the block's length histogram by
non-negative least squares, rounded, and dealt out; the items left over are
packed greedily, longest first, and are the only ones that are cut. The end of
a block, less than one window, becomes sequences whose lengths are powers of
two, which need no padding.

A block is part of one task's input, so packing is a single map without
shuffle or global state, each block is repeatable, and memory is bounded by
BLOCK_TOKENS whatever the size of the table.

Ids are the library's (`tokenizers`), made by `tiktoken` from the same file. Its
pattern matcher gives up on blank runs of about a million characters, so runs
of LONG_RUN are cut out first, at the places where the pattern would cut.

Defined cases: a null or empty text is its end id alone; repeated rows and
ids are documents of their own; a null id stays null; very long texts, also
of one letter or of blanks only, give many whole windows; an empty table gives
no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.byte_bpe import PATTERN, byte_alphabet, tokenizer_path
from quillmark.llm.runtime import ship

WINDOW, END_ID = 1024, 0
#: Ids of items held at once in a worker (4 bytes each), and rows of pieces sent at once.
BLOCK_TOKENS, SEND_TOKENS = 4_000_000, 1_000_000
#: Least squares end when no combination's own best step takes more than TOLERANCE off the sum of squares, far less
#: than a step that rounding can see. WIDTH combinations are tried at a time.
TOLERANCE, WIDTH = 0.01, 3000
#: Blank runs of so many characters are encoded apart.
LONG_RUN = 100_000
#: Fixed value: the characters that the pattern's \s stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The vocabulary of a byte-level BPE .json file.

    Entries are ranked by id, which is right when merges are listed in the
    order of the ids they make; that is checked here.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    ranks = {bytes(alphabet[ch] for ch in s): i for s, i in vocab.items() if s not in special}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def token_ids(path: str, text: str) -> np.ndarray:
    """The ids of a whole text of any length."""
    tokens = encoding(path)
    if len(text) < LONG_RUN or not _RUNS.search(text):
        return tokens.encode_to_numpy(text, allowed_special="all")
    out, specials = [], tokens.special_tokens_set
    for part in re.split("(" + "|".join(map(re.escape, sorted(specials))) + ")", text) if specials else [text]:
        at = 0
        for run in [] if part in specials else _RUNS.finditer(part):
            # the last blank before other characters is left to them; all before it is one piece
            end = run.end() - (run.end() < len(part))
            out.append(tokens.encode_to_numpy(part[at : run.start()]))
            out.append(encoding(path, r"[\s\S]+").encode_to_numpy(part[run.start() : end]))
            at = end
        out.append(tokens.encode_to_numpy(part[at:], allowed_special="all"))
    return np.concatenate(out)


@lru_cache(maxsize=4)
def combinations(window: int) -> np.ndarray:
    """All multisets of two or three lengths that sum to the window; third length 0 in pairs."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([window - a, a, np.zeros_like(a)], axis=1)
    x, y = np.meshgrid(np.arange(1, window), np.arange(1, window // 2), indexing="ij")
    z = window - x - y
    ok = (x >= y) & (y >= z) & (z >= 1)
    return np.concatenate([pairs, np.stack([x[ok], y[ok], z[ok]], axis=1)]).astype(np.int32)


def solve(histogram: np.ndarray, window: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, repeats) with repeats >= 0 minimising |A repeats - histogram|^2.

    Coordinate descent: a round takes the combinations of largest gain, skips
    those that share a length with one taken already, and minimises exactly
    over each of the others. Taken ones being disjoint, they do not disturb
    each other. It prefers few combinations used often to many used in part.
    Each round lowers the convex sum of squares by the tolerance or more, so
    rounds end by themselves; with the tolerance the result tends to the minimum.
    """
    columns = combinations(window)
    present = np.concatenate([[True], histogram[1:] > 0])
    columns = columns[present[columns].all(axis=1)]
    repeats = np.zeros(len(columns))
    if not len(columns):
        return columns, repeats
    left = histogram.astype(float)
    left[0] = 0
    norm = ((columns[:, :, None] == columns[:, None, :]) & (columns[:, :, None] > 0)).sum(axis=(1, 2)).astype(float)
    while True:
        toward = left[columns].sum(axis=1)
        step = np.maximum(toward / norm, -repeats)
        gain = step * (2 * toward - step * norm)
        best = np.argpartition(-gain, min(WIDTH, len(gain) - 1))[:WIDTH]
        best = best[gain[best] > tolerance]
        if not len(best):
            return columns, repeats
        used = set()
        for j in best[np.argsort(-gain[best], kind="stable")].tolist():
            lengths = [x for x in columns[j].tolist() if x]
            if used.isdisjoint(lengths):
                used.update(lengths)
                repeats[j] += step[j]
                for x in lengths:
                    left[x] -= step[j]


class Block:
    """Items to be packed together; first is the id of its first sequence."""

    def __init__(self, window: int):
        self.window, self.items, self.tokens = window, [], 0

    def add(self, doc: int, start: int, ids: np.ndarray) -> None:
        self.items.append((doc, start, ids))
        self.tokens += len(ids)

    def sequences(self) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """Lists of (document, start, ids), each within the window."""
        window = self.window
        stacks: dict[int, list] = {}
        for item in self.items:
            stacks.setdefault(len(item[2]), []).append(item)
        histogram = np.bincount([len(x[2]) for x in self.items], minlength=window + 1)
        columns, repeats = solve(histogram, window)
        for j in np.argsort(-repeats, kind="stable").tolist():
            times = int(repeats[j] + 0.5)
            if not times:
                break
            lengths = [x for x in columns[j].tolist() if x]
            times = min(times, *(len(stacks.get(x, ())) // lengths.count(x) for x in lengths))
            for _ in range(times):
                yield [stacks[x].pop() for x in lengths]
        yield from self._greedy([x for _, xs in sorted(stacks.items()) for x in xs])

    def _greedy(self, rest: list[tuple[int, int, np.ndarray]]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """Longest first with the longest that fits; where none fits, the shortest left is cut.

        rest is sorted by length. The last, short sequence is cut into powers of two.
        """
        window = self.window
        by = [[] for _ in range(window + 1)]
        for item in rest:
            by[len(item[2])].append(item)
        total, top, held = sum(len(x[2]) for x in rest), window, len(rest)
        tail: list[tuple[int, int, np.ndarray]] = []
        while held:
            room, sequence = min(window, total), []
            total -= room
            short = room < window
            while room:
                while top and not by[top]:
                    top -= 1
                n = min(top, room)
                while n and not by[n]:
                    n -= 1
                if n:
                    sequence.append(by[n].pop())
                    held -= 1
                else:
                    n = room
                    m = next(k for k in range(room + 1, top + 1) if by[k])
                    doc, start, ids = by[m].pop()
                    sequence.append((doc, start, ids[:n]))
                    by[m - n].append((doc, start + n, ids[n:]))
                room -= n
            if short:
                tail = sequence
            else:
                yield sequence
        size, rest_of_tail = sum(len(x[2]) for x in tail), tail[::-1]
        for power in (1 << k for k in range(window.bit_length(), -1, -1)):
            if size & power:
                sequence, room = [], power
                while room:
                    doc, start, ids = rest_of_tail.pop()
                    sequence.append((doc, start, ids[:room]))
                    if len(ids) > room:
                        rest_of_tail.append((doc, start + room, ids[room:]))
                    room -= len(sequence[-1][2])
                yield sequence


class _Out:
    """Rows of pieces on their way to Spark."""

    def __init__(self, first: int, kind: pa.DataType, names: list[str]):
        self.next, self.kind, self.names = first, kind, names
        self.clear()

    def clear(self) -> None:
        self.doc, self.start, self.ids, self.total, self.sequence, self.offset, self.tokens = [], [], [], [], [], [], 0

    def put(self, sequence, doc_ids: list, totals: list[int]) -> None:
        at = 0
        for doc, start, ids in sequence:
            self.doc.append(doc_ids[doc])
            self.total.append(totals[doc])
            self.start.append(start)
            self.ids.append(ids)
            self.sequence.append(self.next)
            self.offset.append(at)
            at += len(ids)
        self.tokens += at
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        lengths = pa.array([len(x) for x in self.ids], pa.int64())
        blobs = pa.array([x.astype("<u4").tobytes() for x in self.ids], pa.binary())
        columns = [pa.array(self.doc, self.kind), pa.array(self.start, pa.int64()), lengths, blobs, *(pa.array(x, pa.int64()) for x in (self.total, self.sequence, self.offset))]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, self.names)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    long = T.LongType()
    out = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("start", long), T.StructField("length", long), T.StructField("ids", T.BinaryType()), *(T.StructField(n, long) for n in ("doc_tokens", "sequence_id", "offset"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, rows = None, None
        doc_ids, totals, block = [], [], Block(window)
        for b in batches:
            if rows is None:
                kind = b.column(0).type
                rows = _Out((TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, kind, out.names)
            for i, value in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(token_ids(path, value.as_py() or ""), np.uint32(end_id)).astype(np.uint32)
                at = len(doc_ids)
                doc_ids.append(i)
                totals.append(len(ids))
                whole = len(ids) - len(ids) % window
                for k in range(0, whole, window):
                    rows.put([(at, k, ids[k : k + window])], doc_ids, totals)
                    if rows.tokens >= SEND_TOKENS:
                        yield rows.batch()
                if whole < len(ids):
                    block.add(at, whole, ids[whole:].copy())
                if block.tokens >= BLOCK_TOKENS:
                    for sequence in block.sequences():
                        rows.put(sequence, doc_ids, totals)
                        if rows.tokens >= SEND_TOKENS:
                            yield rows.batch()
                    doc_ids, totals, block = [], [], Block(window)
        if rows is not None:
            for sequence in block.sequences():
                rows.put(sequence, doc_ids, totals)
                if rows.tokens >= SEND_TOKENS:
                    yield rows.batch()
            yield rows.batch()

    return docs.select(doc_id, text).mapInArrow(run, out)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def query(spark, sf_dir):
    """op3: every piece of every document in its sequence."""
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
