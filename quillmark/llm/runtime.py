"""Where operators keep intermediate tables, in storage that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.sources import session

_FOLDERS: dict[str, str] = {}
_TUNED: set[str] = set()
#: Bytes of an Arrow batch on its way to a worker, where the session names no bound of its own. Rows alone do not bound it.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors, and bound the Arrow batches they exchange by bytes."""
    session.ship(spark)
    sc, key = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if sc.applicationId not in _TUNED:
        _TUNED.add(sc.applicationId)
        if not sc.getConf().contains(key):
            spark.conf.set(key, str(BATCH_BYTES))


@dataclass
class Feed:
    """Rows for a map that adds columns: the first ``kept`` go through, ``at`` are the places of those it reads."""

    rows: DataFrame
    kept: int
    at: list[int]
    schema: T.StructType


def feed(docs: DataFrame, reads: list[str], adds: list[tuple[str, T.DataType]]) -> Feed:
    """What a map over docs needs to read some columns and add others.

    An added column takes the place of an input column of the same name, in
    whatever case, as ``withColumn`` does; one that is also read is still read.
    """
    taken = {n.lower() for n, _ in adds}
    kept = [f for f in docs.schema.fields if f.name.lower() not in taken]
    names = [f.name for f in kept]
    hidden = [c for c in reads if c not in names]
    rows = docs.select(*(F.col(f"`{n}`") for n in names), *(F.col(f"`{c}`").alias(f"__read{i}") for i, c in enumerate(hidden)))
    at = [names.index(c) if c in names else len(names) + hidden.index(c) for c in reads]
    return Feed(rows, len(kept), at, T.StructType([*kept, *(T.StructField(n, k) for n, k in adds)]))


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application inside spark.checkpoint.dir.

    The setting names storage that the driver and all executors see. Only a
    local master, where driver and executors are one process on one machine,
    gets a temporary folder when it is unset; a cluster has to name one.
    """
    sc = spark.sparkContext
    if sc.applicationId in _FOLDERS:
        return _FOLDERS[sc.applicationId]
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
    _FOLDERS[sc.applicationId] = folder
    atexit.register(_remove_quietly, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: later stages read files that outlive any executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by stored() that no later plan reads."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path:
            _remove_quietly(path)


def filesystem(uri: str):
    """The file system of a URI and the path in it; loaded when first needed."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _remove_quietly(uri: str) -> None:
    try:
        fs, path = filesystem(uri)
        if fs.get_file_info(path).type.name != "NotFound":
            fs.delete_dir(path)
    except Exception:  # leftover files do no harm; the folder's owner clears it
        pass
