"""Near duplicates by MinHash banding and sequential Bayesian verification.

Documents are sets of word shingles. Those with equal sets form one class and
only the class's least id goes further. Signatures are cut into bands; texts
that agree on a band are candidates. A candidate pair's signatures are then
compared batch by batch, and the pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below the chosen
miss probability. Survivors are verified exactly on their full sets, and the
verified links are joined into components.

A group of g similar texts is not expanded into its pairs. Members of a band's
bucket are compared with the bucket's least id; what that leaves in different
components is compared pair by pair, inside small buckets by a join and inside
large ones block against block inside a task, which emits only verified links
that join two components. There a member's id and signature go out once for
each block of its bucket; full sets stay in files, and a task reads those of
the pairs that comparison leaves. So no candidate is capped, and components
come out as if all pairs had been verified.

Defined cases: a text with fewer words than a shingle is one shingle; a text
that is null, empty or without words has an empty set and links with nothing;
texts of any length are read whole; rows that repeat an id stand for one
document, which is linked by each of its texts; ids may be of any type that
has an order; a null id gets no component and is kept; an empty table gives no
rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import textops as tx
from quillmark.llm.runtime import discard, filesystem, new_path, ship, stored

#: Up to so many ids are broadcast to pick the texts to verify; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Buckets up to SMALL members are compared by a join, larger ones in blocks of about BLOCK.
SMALL, BLOCK = 16, 512
#: Sets of 8 MB at most that a task comparing blocks keeps from one pair to the next.
KEPT_SETS, KEPT_HASHES = 8, 1 << 20
#: The low bits of a bucket's key are its band.
BAND_MASK = 255


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least num / den on shingles of some words."""

    words: int = 5
    num: int = 80
    den: int = 100
    rows: int = 5
    #: Chance that a pair right at the threshold shares no band.
    band_miss: float = 1e-6
    #: Posterior probability of a link below which a candidate is dropped.
    miss: float = 1e-6
    batch: int = 20

    def __post_init__(self) -> None:
        if self.bands > BAND_MASK + 1:
            raise ValueError(f"{self.bands} bands; take fewer rows for so low a threshold")

    @cached_property
    def bands(self) -> int:
        return ceil(log(self.band_miss) / log(1 - (self.num / self.den) ** self.rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @cached_property
    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, matches needed to go on), with a uniform prior on similarity.

        The posterior after m of n matches is Beta(m + 1, n - m + 1), whose
        upper tail at t is the chance of at most m successes in n + 1 trials.
        """
        t, out = self.num / self.den, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            tail = 0.0
            for m in range(n + 1):
                tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if tail >= self.miss:
                    break
            out.append((n, m))
        return out


def sketches(docs: DataFrame, sim: Similarity, doc_id: str, text: str) -> DataFrame:
    """(id, n shingles, 128-bit set fingerprint, MinHash signature) of each row."""
    hashes = sim.hashes
    factors, terms = tx.stream(21, hashes) | np.uint64(1), tx.stream(22, hashes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tx.chunks(b.column(1)):
                sets = list(tx.shingle_sets(c, sim.words))
                sizes = np.array([len(s) for s in sets], np.int64)
                signature = np.zeros((len(sets), hashes), np.uint32)
                prints = np.zeros((2, len(sets)), np.uint64)
                some = np.flatnonzero(sizes)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    at = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    for k in (0, 1):
                        prints[k, some] = np.add.reduceat(tx.mix(flat ^ terms[k]), at)
                    work, out = np.empty_like(flat), np.empty(len(flat), np.uint32)
                    for k in range(hashes):
                        np.multiply(flat, factors[k], out=work)
                        work += terms[k]
                        np.right_shift(work, np.uint64(32), out=out, casting="unsafe")
                        signature[some, k] = np.minimum.reduceat(out, at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.first, len(c)), pa.array(sizes), *(pa.array(p.view(np.int64)) for p in prints), _blobs(signature)],
                    ["id", "n", "fp1", "fp2", "sig"],
                )

    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(sign, f"id {_kind(docs, doc_id)}, n long, fp1 long, fp2 long, sig binary")


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _blobs(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, hashes)


def _banded(reps: DataFrame, sim: Similarity) -> DataFrame:
    bands, rows, hashes = sim.bands, sim.rows, sim.hashes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = tx.stream(23, rows) | np.uint64(1)
        for b in batches:
            parts = _matrix(b.column(1), hashes).reshape(-1, bands, rows).astype(np.uint64)
            keys = tx.mix((tx.mix(parts * steps).sum(axis=2, dtype=np.uint64)) + tx.stream(24, bands))
            keys = keys & ~np.uint64(BAND_MASK) | np.arange(bands, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), bands)))], ["bucket", "id"])

    return reps.select("id", "sig").mapInArrow(cut, f"bucket long, id {_kind(reps, 'id')}")


def _plausible(pairs: DataFrame, sketch: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs (a, b) that sequential comparison of signatures does not rule out."""
    steps, hashes = sim.least_matches, sim.hashes

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column(2), hashes), _matrix(batch.column(3), hashes)
            alive, matches, done = np.arange(len(x)), np.zeros(len(x), np.int32), 0
            for n, least in steps:
                matches[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1, dtype=np.int32)
                alive, done = alive[matches[alive] >= least], n
            yield batch.select([0, 1]).take(pa.array(alive))
            tx.relax()

    sig = sketch.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(prune, "a {0}, b {0}".format(_kind(sketch, "id")))


def _texts(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, t) of the wanted ids."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).join(wanted, "id", "left_semi")


def _full_sets(docs: DataFrame, ids: DataFrame, sim: Similarity, doc_id: str, text: str) -> DataFrame:
    """(id, s) with the full shingle set of each wanted id's text."""
    n = sim.words

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tx.chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, len(c)), pa.array([s.tobytes() for s in tx.shingle_sets(c, n)], pa.binary())], ["id", "s"])

    return stored(_texts(docs, ids, doc_id, text).mapInArrow(full, f"id {_kind(docs, doc_id)}, s binary"), "sets")


def _filed_sets(docs: DataFrame, ids: DataFrame, sim: Similarity, doc_id: str, text: str) -> DataFrame:
    """(id, file, start, n): where each wanted id's full set is in files of the shared folder, one a task's attempt."""
    n, folder = sim.words, new_path(docs.sparkSession, "set-files")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name, at = f"{uuid.uuid4().hex}.u64", 0
        with fs.open_output_stream(f"{path}/{name}") as out:
            for b in batches:
                for c in tx.chunks(b.column(1)):
                    sizes = []
                    for s in tx.shingle_sets(c, n):
                        out.write(s.tobytes())
                        sizes.append(len(s))
                    ends = at + np.cumsum(sizes)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, len(c)), pa.array([f"{folder}/{name}"] * len(c)), pa.array(ends - sizes), pa.array(sizes, pa.int64())], ["id", "file", "start", "n"])
                    at = int(ends[-1])

    return stored(_texts(docs, ids, doc_id, text).mapInArrow(full, f"id {_kind(docs, doc_id)}, file string, start long, n long"), "set-places")


@lru_cache(maxsize=KEPT_SETS)
def _filed(file: str, start: int, n: int) -> np.ndarray:
    fs, path = filesystem(file)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at(8 * n, 8 * start), np.uint64)


def _linked(x: np.ndarray, y: np.ndarray, sim: Similarity) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or sim.den * len(x) < sim.num * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return sim.den * both >= sim.num * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, docs: DataFrame, sim: Similarity, doc_id: str, text: str) -> DataFrame:
    """The links among pairs: those similar enough on their full shingle sets."""
    pairs = stored(pairs, "survivors")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = ([np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(k)] for k in (2, 3))
            keep = [i for i, (x, y) in enumerate(zip(*sets)) if _linked(x, y, sim)]
            yield b.select([0, 1]).take(pa.array(keep, pa.int64()))
            tx.relax()

    sets = _full_sets(docs, ids, sim, doc_id, text)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    links = stored(both.select("a", "b", "sa", "sb").mapInArrow(exact, "a {0}, b {0}".format(_kind(docs, doc_id))).distinct(), "links")
    discard(pairs, ids, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for each id on a link, comp being the least id it reaches.

    Each round takes the least label of the neighbours and then the label's
    own label, so paths shorten by doubling; a round is a stored table.
    """
    edges = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = stored(step.join(jump, "comp", "left").select("id", "old", F.least("comp", "far").alias("comp")), "labels")
        changed = new.where("comp != old").limit(1).count()
        discard(labels)
        if not changed:
            discard(edges)
            return new.select("id", "comp")
        labels = stored(new.select("id", "comp"), "labels")
        discard(new)


def _apart(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the buckets of three or more that still span components."""
    held = members.where("size >= 3").join(comps, "id", "left").select("bucket", "id", "size", F.coalesce("comp", "id").alias("comp"))
    held = stored(held, "held")
    open_ = held.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return stored(held.join(open_, "bucket", "left_semi"), "apart")


def _blocked(apart: DataFrame, sketch: DataFrame, docs: DataFrame, sim: Similarity, doc_id: str, text: str) -> DataFrame:
    """Links across components inside large buckets, found and verified block against block.

    A pair is left to the first band it shares: that band's bucket also spans
    components, so it is compared there. Of the verified pairs of a task only
    those are emitted that join two components, fewer than it has members.
    """
    steps, hashes, rows = sim.least_matches, sim.hashes, sim.rows

    def compare(g: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint32).reshape(-1, hashes)
        ids, order = g.column("id").to_pylist(), np.empty(g.num_rows, np.int64)
        order[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        comp, block = g.column("comp").combine_chunks().dictionary_encode().indices.to_numpy(), g.column("block").to_numpy()
        bucket, i, j = (g.column(n)[0].as_py() for n in ("bucket", "i", "j"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        alive, matches, done = comp[left][:, None] != comp[right][None, :], np.zeros((len(left), len(right)), np.int32), 0
        for n, least in steps:
            for k in range(done, n):
                matches += sig[left, k][:, None] == sig[right, k][None, :]
            alive &= matches >= least
            done = n
        x, y = np.nonzero(alive & (order[left][:, None] < order[right][None, :]) if i == j else alive)
        best = np.argsort(-matches[x, y], kind="stable")
        x, y = left[x[best]], right[y[best]]
        earlier = rows * (bucket & BAND_MASK)
        if earlier:
            first = np.concatenate([~(sig[x[k : k + 4096], :earlier] == sig[y[k : k + 4096], :earlier]).reshape(-1, earlier // rows, rows).all(axis=2).any(axis=1) for k in range(0, len(x), 4096)] or [np.zeros(0, bool)])
            x, y = x[first], y[first]
        parent = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        places, found = list(zip(*(g.column(n).to_pylist() for n in ("file", "start", "n")))), []

        def whole(k: int) -> np.ndarray:
            return (_filed if places[k][2] <= KEPT_HASHES else _filed.__wrapped__)(*places[k])

        for a, b in zip(x.tolist(), y.tolist()):
            p, q = top(comp[a]), top(comp[b])
            if p != q and _linked(whole(a), whole(b), sim):
                parent[p] = q
                found.append((ids[a], ids[b]) if order[a] < order[b] else (ids[b], ids[a]))
        _filed.cache_clear()
        tx.relax()
        kind = g.schema.field("id").type
        return pa.table({"a": pa.array([f[0] for f in found], kind), "b": pa.array([f[1] for f in found], kind)})

    large = apart.where(F.col("size") > SMALL)
    places = _filed_sets(docs, stored(large.select("id").distinct(), "ids"), sim, doc_id, text)
    blocks = large.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    blocks = blocks.select("bucket", "id", "comp", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    return blocks.join(sketch.select("id", "sig").join(places, "id"), "id").groupBy("bucket", "i", "j").applyInArrow(compare, "a {0}, b {0}".format(_kind(docs, doc_id))).distinct()


def _of_one_id(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links of ids that have several texts with the classes of these."""
    several = rows.where("n > 0 and id is not null").groupBy("id").agg(*(f(c).alias(f"{k}{c}") for c in ("fp1", "fp2") for k, f in (("lo", F.min), ("hi", F.max))))
    several = stored(several.where("lofp1 < hifp1 or lofp2 < hifp2").select("id"), "several")
    if several.isEmpty():
        return None
    return rows.join(several, "id", "left_semi").join(classes, ["fp1", "fp2"]).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, sim: Similarity | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; kept is one id a component, the least."""
    sim = sim or Similarity()
    ship(docs.sparkSession)
    rows = stored(sketches(docs, sim, doc_id, text), "sketches")
    classes = stored(rows.where("n > 0 and id is not null").groupBy("fp1", "fp2").agg(F.min("id").alias("rep")), "classes")
    reps = rows.where("n > 0").join(classes.withColumnRenamed("rep", "id"), ["fp1", "fp2", "id"]).select("id", "sig")
    reps = stored(reps, "reps")

    banded = _banded(reps, sim)
    buckets = banded.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size >= 2")
    members = stored(banded.join(stored(buckets, "buckets"), "bucket").distinct(), "members")

    heads = members.where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(_plausible(heads, reps, sim), docs, sim, doc_id, text)
    of_one = _of_one_id(rows, classes)
    if of_one is not None:
        links = links.unionAll(stored(of_one, "links"))
    comps = components(links)
    apart = _apart(members, comps)
    if apart.where(F.col("size") <= SMALL).limit(1).count():
        few = apart.where(F.col("size") <= SMALL)
        x, y = few.select("bucket", F.col("id").alias("a"), F.col("comp").alias("ca")), few.select("bucket", F.col("id").alias("b"), F.col("comp").alias("cb"))
        pairs = x.join(y, "bucket").where("a < b and ca != cb").select("a", "b").distinct()
        links = links.unionAll(_verified(_plausible(pairs, reps, sim), docs, sim, doc_id, text))
        comps = components(links)
        apart = _apart(members, comps)
    if apart.where(F.col("size") > SMALL).limit(1).count():
        links = links.unionAll(stored(_blocked(apart, reps, docs, sim, doc_id, text), "links"))
        comps = components(links)

    named = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("fp1", "fp2", F.coalesce("comp", "rep").alias("comp"))
    out = rows.select("id", "n", "fp1", "fp2").join(named, ["fp1", "fp2"], "left")
    comp = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, sim: Similarity | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, without those that another of their component stands for."""
    gone = stored(near_duplicates(docs, sim, doc_id, text).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")


#: The query's contract: three words, 85 of 100.
QUERY = Similarity(words=3, num=85, den=100)


def query(spark, sf_dir):
    """op4: every document with its component of near duplicates."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY)


SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i : i + 2], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
u as materialized (select a, b from e union select b, a from e),
r(id, c) as (select doc_id, doc_id from w union select r.id, u.b from r join u on r.c = u.a),
m as (select id, min(c) as c from r group by id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id, w.doc_id = m.c as kept from w left join n using (doc_id) join m on m.id = w.doc_id
"""
