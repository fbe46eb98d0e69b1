"""Counting in Spark and sorted hash arrays for modified Kneser-Ney models.

Keys are unsigned 64-bit integers. A task counts its keys in numpy and sends
them as compressed blobs of sorted keys, one a shard; a shard's task merges
its blobs and writes its arrays to the shared folder, under a name of its own
attempt, so a lost executor's work is simply done again. Workers map the files
into memory and share their pages.
"""

from __future__ import annotations

import json
import mmap
import os
import resource
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quillmark.llm import textops as tx
from quillmark.llm.runtime import filesystem

#: Keys a task holds before it counts and sends them (8 bytes each).
HELD_KEYS = 4_000_000
#: Where arrays begin in a file.
ALIGN = 64
# a map keeps its file open before Python 3.13
_NO_FILE = {"trackfd": False} if sys.version_info >= (3, 13) else {}
#: Files a worker maps at once: a quarter of Linux's usual bound of maps, and half its open files where each map holds one.
MAPS = 16_000 if _NO_FILE else min(16_000, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 2)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, byte planes apart."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Numbers below 2**32 in their order, byte planes apart."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_small(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(counts.astype(np.uint64).tobytes())


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint64)


def merged(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts (1 each if None)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        sums = np.diff(first, append=len(keys)).astype(np.uint64)
    else:
        sums = np.add.reduceat(counts, first) if len(keys) else np.zeros(0, np.uint64)
    return keys[first], sums


def counted(docs: DataFrame, keys_of: Callable[[tx.Chunk, pa.RecordBatch], np.ndarray], shard_of: Callable[[np.ndarray], np.ndarray], chunk_bytes: int = 4 << 20) -> DataFrame:
    """(shard, keys, counts) blobs of what keys_of gives for the first column's texts.

    Other columns of docs reach keys_of in the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for c in tx.chunks(b.column(0), chunk_bytes):
                held.append(keys_of(c, b))
                size += len(held[-1])
                if size >= HELD_KEYS:
                    yield sent(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield sent(np.concatenate(held))

    def sent(keys: np.ndarray) -> pa.RecordBatch:
        return blobs(*merged(keys), shard_of)

    return docs.mapInArrow(run, "shard int, keys binary, counts binary")


def blobs(keys: np.ndarray, counts: np.ndarray, shard_of: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """Sorted keys dealt to shards, sorted within each."""
    shard = shard_of(keys)
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    parts = list(zip(first.tolist(), [*first[1:].tolist(), len(shard)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[first].astype(np.int32)), pa.array([pack_sorted(keys[a:b]) for a, b in parts], pa.binary()), pa.array([pack_counts(counts[a:b]) for a, b in parts], pa.binary())], ["shard", "keys", "counts"]
    )


def gathered(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """A shard's number, distinct keys and sums, from its blobs."""
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = [unpack_counts(x) for x in table.column("counts").to_pylist()]
    return table.column("shard")[0].as_py(), *merged(np.concatenate(keys), np.concatenate(counts))


def narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def saved(folder: str, name: str, *arrays: np.ndarray) -> str:
    """Write arrays to one file of the shared folder; the name is this attempt's alone.

    A list of their kinds and shapes stands first; it and each array begin at multiples of ALIGN bytes.
    """
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    at = f"{name}-{uuid.uuid4().hex[:12]}.arrays"
    arrays = [np.ascontiguousarray(x) for x in arrays]
    head = json.dumps([[x.dtype.str, x.shape] for x in arrays]).encode()
    head = len(head).to_bytes(8, "little") + head
    with fs.open_output_stream(f"{path}/{at}") as out:
        out.write(head + bytes(-len(head) % ALIGN))
        for x in arrays:
            out.write(x.reshape(-1).view(np.uint8))
            out.write(bytes(-x.nbytes % ALIGN))
    return f"{folder}/{at}"


_MAPPED: dict[str, list[np.ndarray]] = {}


def arrays(uri: str) -> list[np.ndarray]:
    """Saved arrays, memory-mapped. From a remote store a copy without a name is mapped.

    MAPS files stay mapped; of more, those used longest ago are let go.
    """
    got = _MAPPED.pop(uri, None)
    if got is None:
        fs, path = filesystem(uri)
        if fs.type_name == "local":
            got = _map(path)
        else:
            handle, local = tempfile.mkstemp(suffix=".arrays")
            with os.fdopen(handle, "wb") as out, fs.open_input_stream(path) as source:
                while piece := source.read(8 << 20):
                    out.write(piece)
            got = _map(local)
            os.unlink(local)
        while len(_MAPPED) >= MAPS:
            del _MAPPED[next(iter(_MAPPED))]
    _MAPPED[uri] = got
    return got


def mapped(uri: str) -> np.ndarray:
    """The only array of a file, or its first."""
    return arrays(uri)[0]


def _map(path: str) -> list[np.ndarray]:
    with open(path, "rb") as f:
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_NO_FILE)
    at, out = 8 + int.from_bytes(m[:8], "little"), []
    for kind, shape in json.loads(m[8:at]):
        at += -at % ALIGN
        out.append(np.ndarray(tuple(shape), kind, m, at))
        at += out[-1].nbytes
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys hold wanted ones, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    if len(values):
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        yield from zip(values[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)])


def discounts(n: list[int]) -> np.ndarray:
    """The modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from n[k-1] keys of count k, k to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(d, 1))])


def count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]
