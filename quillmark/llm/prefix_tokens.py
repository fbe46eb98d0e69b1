"""Exact token counts of every prefix of a text by dynamic programming.

In byte pair encoding, cutting the last token off a piece's encoding leaves
the encoding of what is left. So the encoding of each prefix is known by its
last token alone: the one vocabulary entry that ends the prefix and forms a
stable pair with the last token of the prefix before it. One pass over a piece
gives the count at each of its prefixes, and counts add up over pieces.

Counts are stored as one signed byte a character, the change of the count from
the prefix before (counts can fall, as longer tokens form). The count of any
prefix is a running sum, so truncation and budget questions need no encoding.

Prefixes end inside whitespace runs and contractions, where the pieces of the
prefix differ from those of the whole text; both are counted as the prefix
alone would be. A special token's string counts one where it is complete, as
the library does by default.

Defined cases: null and empty texts have no bytes, no tokens and no changes;
texts of any length are counted whole; repeated rows count each; null ids play
no part; an empty table gives no rows; other columns go through, but for those
named like the added ones, which take their place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.byte_bpe import CONTRACTIONS, PATTERN, byte_alphabet, tokenizer_path
from quillmark.llm.runtime import feed, ship

#: A worker keeps the counts of up to twice so many pieces of up to so many characters.
CACHED, CACHED_CHARS = 250_000, 40
LIMIT = 512


class Vocabulary:
    """Tokens and special tokens of a byte-level BPE file, and which tokens may stand together."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[ch] for ch in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        size = 1 + max(self.tokens.values())
        self.parts: list[tuple[int, int]] = [(-1, -1)] * size
        self.rank = [-1] * size
        self.merge: dict[int, int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            x, y = map(raw, m.split(" ") if isinstance(m, str) else m)
            a, b, whole = self.tokens[x], self.tokens[y], self.tokens[x + y]
            self.merge[a << 32 | b], self.parts[whole], self.rank[whole] = r, (a, b), r
        # finds all tokens that end at each byte, in one pass over bytes as characters
        found = ahocorasick.Automaton()
        for token, i in self.tokens.items():
            found.add_word(token.decode("latin-1"), (i, len(token)))
        found.make_automaton()
        self.ending = found.iter

    def stable(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens gives the same two tokens.

        Merges are undone latest first on both sides of the boundary. The
        boundary would have been merged over if at some stage the two tokens
        beside it merge earlier than the one formed next; of merges of one
        rank, the left one comes first.
        """
        rank, limit = self.rank, len(self.rank)
        while True:
            if self.merge.get(a << 32 | b, limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.parts[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.parts[b][0]
            else:
                return True


class PrefixCounter(dict):
    """Maps a piece to its changes of count, one signed byte a character."""

    def __init__(self, path: str):
        super().__init__()
        self.v = Vocabulary(path)
        self.old: dict[str, bytes] = {}
        self.stable: dict[int, bool] = {}
        self.find = regex.compile(PATTERN).findall
        self.runs = re.compile(r"\s\s").search  # finds some control characters too, which does no harm
        self.blank = regex.compile(r"\s+").fullmatch
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.v.special)) + ")").split if self.v.special else None
        for c in CONTRACTIONS:
            counts = [0] + [sum(self.counts(p)[-1] for p in self.find(c[:k])) for k in range(1, len(c) + 1)]
            self.old[c] = _changes(counts)
        self.contractions = dict(self.old)

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece) or self.contractions.get(piece)
        if found is None:
            found = _changes([0, *self.counts(piece)])
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def counts(self, piece: str) -> list[int]:
        """The token count of each prefix of one piece, by character."""
        data, stable, known = piece.encode(), self.v.stable, self.stable
        if len(known) > CACHED:
            known.clear()
        n = len(data)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end, (t, size) in self.v.ending(data.decode("latin-1")):
            i = end + 1
            if last[i] >= 0:
                continue
            at = i - size
            if at:
                pair = last[at] << 32 | t
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = stable(last[at], t)
                if not fits:
                    continue
            last[i], count[i] = t, count[at] + 1
        if n == len(piece):
            return count[1:]
        return [count[i] for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]

    def ordinary(self, text: str) -> bytes:
        """The changes of a text without special tokens."""
        pieces = self.find(text)
        if not self.runs(text):
            return b"".join(map(self.__getitem__, pieces))
        out, i = [], 0
        while i < len(pieces):
            piece = pieces[i]
            if not self.blank(piece):
                out.append(self[piece])
                i += 1
                continue
            j, before = i, 0
            while j < len(pieces) and self.blank(pieces[j]):
                before += _total(self[pieces[j]])
                j += 1
            follow = pieces[j] if j < len(pieces) else ""
            own = self.blank(follow[:1]) is not None
            run = "".join(pieces[i:j]) + (follow[0] if own else "")
            out.append(changes := self[run])
            if follow:
                rest = np.cumsum(np.frombuffer(self[follow], np.int8), dtype=np.int64)[own:] + before
                if len(rest):
                    out.append(_changes([_total(changes), *rest.tolist()]))
            i = j + 1
        return b"".join(out)

    def changes(self, text: str) -> bytes:
        if not any(x in text for x in self.v.special):
            return self.ordinary(text)
        parts, out = self.split(text), []
        for plain, special in zip(parts[::2], [*parts[1::2], ""]):
            got = self.ordinary(plain + special)
            if special:
                done, open_ = _total(self.ordinary(plain)), _total(got[:-1])
                got = got[:-1] + _changes([open_, done + 1])
            out.append(got)
        return b"".join(out)


def _changes(counts: list[int]) -> bytes:
    steps = [b - a for a, b in zip(counts, counts[1:])]
    if steps and not -128 <= min(steps) <= max(steps) < 128:
        raise ValueError("a count changes by over 127 at one character")
    return bytes([x & 255 for x in steps])


def _total(changes: bytes) -> int:
    return int(np.frombuffer(changes, np.int8).sum(dtype=np.int64))


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def with_prefix_counts(docs: DataFrame, text: str = "text", path: str | None = None, names: tuple[str, str, str | None] = ("n_bytes", "n_tokens", "prefix_changes")) -> DataFrame:
    """The rows with n_bytes, n_tokens and the stored changes of each text.

    A single map. A None as third name leaves the stored changes out of the rows.
    """
    ship(docs.sparkSession)
    path, keep = path or tokenizer_path(), names[2] is not None
    given = feed(docs, [text], [(names[0], T.LongType()), (names[1], T.LongType()), *([(names[2], T.BinaryType())] if keep else [])])
    kept, at, fields = given.kept, given.at[0], given.schema.fieldNames()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            sizes, totals, stored = [], [], []
            for value in b.column(at):
                s = value.as_py() or ""
                d = c.changes(s)
                sizes.append(len(s.encode()))
                totals.append(_total(d))
                if keep:
                    stored.append(d)
            columns = [*b.columns[:kept], pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())] + ([pa.array(stored, pa.binary())] if keep else [])
            yield pa.RecordBatch.from_arrays(columns, fields)

    return given.rows.mapInArrow(count, given.schema)


def tokens_at(changes: Column, n_chars: Column) -> Column:
    """The token count of the prefix of n_chars characters, from stored changes."""

    @F.pandas_udf("long")
    def at(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _total(bytes(x)[: max(0, int(k))]) for x, k in zip(d, n)], dtype="Int64")

    return at(changes, n_chars)


def chars_within(changes: Column, budget: int) -> Column:
    """The length in characters of the longest prefix of at most ``budget`` tokens."""

    @F.pandas_udf("long")
    def fits(d: pd.Series) -> pd.Series:
        out = []
        for x in d:
            ok = np.flatnonzero(np.cumsum(np.frombuffer(x or b"", np.int8), dtype=np.int64) <= budget)
            out.append(int(ok[-1]) + 1 if len(ok) else 0)
        return pd.Series(out)

    return fits(changes)


def query(spark, sf_dir):
    """op9: the token count of every document, and whether it passes the limit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = with_prefix_counts(docs).withColumn("chars_in_limit", chars_within(F.col("prefix_changes"), LIMIT))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "chars_in_limit")
