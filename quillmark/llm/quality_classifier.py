"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed byte trigrams, case kept, and repeats of the word before. A
bounded, class-balanced sample of labelled documents gives weights (inverse
document frequency) and a latent basis (truncated singular value
decomposition). The labelled vectors and the basis are broadcast; their size
is fixed by the parameters. Each document is projected, its cosines with all
labelled vectors are computed in blocks, and its nearest neighbours vote with
weights that rise with similarity, corrected for the classes' shares.

Only texts enter a score. Defined cases: a null or empty text, or one shorter
than a trigram, scores the share of label 1; several labels of one id count as their
mean, rounded half up; labels other than 0 and 1, null ids and labels without a
document are not learned from; with labels of one class or none, all score
that class's share (1 without labels). Ids may be of any type; those of two
types meet as text. Repeated rows score alike; texts of any length are read
whole; an empty table gives no rows. Other columns are handed through, but for
one named like the added score, which takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import textops as tx
from quillmark.llm.runtime import discard, feed, ship, stored

#: Labelled documents of each class to learn from, chosen by hash of id.
SAMPLE = 2000
TERMS, LATENT, NEIGHBOURS, SHARPNESS, REPEATS = 4096, 64, 25, 8.0, 1.5
THRESHOLD, FOLDS, HELD_FOLD = 0.3, 5, 0
_SHIFT = np.uint32(32 - 12)
#: Texts whose term counts are held at once, 48 kB each.
CHUNK_TEXTS = 256


def term_counts(c: tx.Chunk) -> np.ndarray:
    """Texts by terms. The last term is the share of words equal to the word before."""
    n = len(c)
    out = np.zeros((n, TERMS), np.float32)
    if len(c.data) > 2:
        b = c.data.astype(np.uint32)
        code = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> _SHIFT
        lengths = np.maximum(np.diff(c.offsets) - 2, 0)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.repeat(c.offsets[:-1] - bounds[:-1], lengths) + np.arange(bounds[-1])
        at = np.repeat(np.arange(n) * TERMS, lengths) + code[inside]
        out = np.bincount(at, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)
    w = tx.words(c)
    h = tx.word_hashes(c, w)
    same = np.flatnonzero(h[1:] == h[:-1]) + 1
    text_of = np.searchsorted(w.of, same, "right") - 1
    same = text_of[~np.isin(same, w.of)]
    out[:, -1] = np.bincount(same, minlength=n)[:n] / np.maximum(np.diff(w.of), 1)
    return out


@dataclass
class Model:
    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, share: float) -> Model:
        weights = np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + 0.1
        x = _terms(counts, weights)
        rng = np.random.default_rng(5)
        y = x @ rng.standard_normal((x.shape[1], min(LATENT + 16, *x.shape))).astype(np.float32)
        for _ in range(4):
            y = x @ (x.T @ np.linalg.qr(y)[0])
        basis = np.linalg.svd(np.linalg.qr(y)[0].T @ x, full_matrices=False)[2][:LATENT].T.astype(np.float32)
        return cls(weights, basis, _unit(x @ basis), labels.astype(np.float32), share)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.share)
        if not len(self.vectors) or not 0 < self.share < 1:
            return out
        some = np.flatnonzero(counts.any(axis=1))
        q = _unit(_terms(counts[some], self.weights) @ self.basis)
        k = min(NEIGHBOURS, len(self.vectors))
        sampled = float(self.labels.mean())
        good, bad = self.share / sampled, (1 - self.share) / (1 - sampled)
        for a in range(0, len(some), 512):
            cosines = q[a : a + 512] @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.exp(SHARPNESS * (np.take_along_axis(cosines, near, axis=1) - 1))
            of_one = self.labels[near]
            one, zero = (votes * of_one).sum(axis=1) * good, (votes * (1 - of_one)).sum(axis=1) * bad
            out[some[a : a + 512]] = one / (one + zero)
        return out


def _terms(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted terms at unit length, with the repeated share as a term of up to REPEATS times that; in place of counts."""
    share = counts[:, -1].copy()
    x = np.log1p(counts, out=counts)
    x *= weights
    x[:, -1] = 0
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    x[:, -1] = REPEATS * share
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from labelled documents outside the held-out fold."""
    ship(docs.sparkSession)
    alike = docs.schema[doc_id].dataType == labels.schema[doc_id].dataType
    as_id = (lambda c: c) if alike else lambda c: c.cast("string")
    usable = labels.where(F.col(label).isin(0, 1) & (fold(F.col(doc_id), FOLDS) != HELD_FOLD))
    one = usable.groupBy(as_id(F.col(doc_id)).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    one = stored(one, "labelled")
    n, n_one = one.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = n_one / n if n else 1.0
    picked = [one.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionAll(picked[1]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tx.chunks(b.column(1), chunk_texts=CHUNK_TEXTS):
                blobs = [x.astype(np.float16).tobytes() for x in np.minimum(term_counts(c), 6e4)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, len(c)), b.column(2).slice(c.first, len(c)), pa.array(blobs, pa.binary())], ["id", "y", "x"])

    texts = docs.select(as_id(F.col(doc_id)).alias("id"), F.col(text).alias("t")).join(chosen, "id").select(F.xxhash64("id").alias("id"), "t", "y")
    got = texts.mapInArrow(count, "id long, y int, x binary").orderBy("id", "y", "x").limit(4 * sample).toArrow()
    discard(one)
    y = np.array(got.column("y").to_pylist(), np.float32)
    x = np.empty((len(y), TERMS), np.float32)
    for i, blob in enumerate(got.column("x")):
        x[i] = np.frombuffer(blob.as_buffer(), np.float16)
    del got
    if len(x) < 2 or not 0 < y.mean() < 1:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, share if len(set(y.tolist())) != 1 else float(y[0]))
    return Model.fit(x, y, share)


def _scorer(docs: DataFrame, model: Model):
    given = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(given.value.scores(term_counts(c)) for c in tx.chunks(texts, chunk_texts=CHUNK_TEXTS))])

    return scores


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with the model's score; one map, no shuffle."""
    ship(docs.sparkSession)
    given, scores = feed(docs, [text], [(name, T.DoubleType())]), _scorer(docs, model)
    kept, at, names = given.kept, given.at[0], given.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(scores(b.column(at)))], names)

    return given.rows.mapInArrow(run, given.schema)


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, that score at least the threshold."""
    ship(docs.sparkSession)
    at, scores = docs.columns.index(text), _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    """op5: every document's quality score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_FOLD, F.lit(False))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
