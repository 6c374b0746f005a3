"""Helpers shared by the training-data operators: tables, checkpoints, batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of a local master."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        at = sc._jsc.sc().getCheckpointDir()
        if at.isDefined():
            found = at.get()
        else:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="routeloom-")
            sc.setCheckpointDir(found)
            found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder then stays with the cluster's cleaner
        pass


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, so a lost executor costs
    no earlier stage. The files go when the Python process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/routeloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove what cut() wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


#: Bytes of an Arrow batch on its way to a Python worker (Spark's own bound is 64 MB and 10,000 rows).
BATCH_BYTES = 8 << 20


def ready(df: DataFrame) -> None:
    """Before Python runs on executors: keep batches small whatever the length of texts, since an executor holds a few
    for each of its cores; and send this package along where executors would not find it by themselves."""
    conf, sc = df.sparkSession.conf, df.sparkSession.sparkContext
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", conf.get(name)) or 0) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    there = {Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if root not in there and sc.applicationId not in _sent and not str(root).endswith((".zip", ".egg")):
        archive = Path(tempfile.mkdtemp(prefix="routeloom-")) / "routeloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted((root / "routeloom").rglob("*.py")):
                z.write(path, path.relative_to(root))
        sc.addPyFile(str(archive))
        _sent.add(sc.applicationId)


_sent: set[str] = set()


def fresh(name: str, taken) -> str:
    """A column name that none of the taken ones equals, whatever their case."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def text_bytes(col: str = "text"):
    """The text as bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first, last) row ranges of a binary or string array, each of about limit bytes."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type in (pa.binary(), pa.string()) else np.int64)
    offsets = offsets[column.offset : column.offset + n + 1]
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, int(offsets[first]) + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array without nulls; offsets start at 0."""
    kind = np.int32 if column.type in (pa.binary(), pa.string()) else np.int64
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bpe_path() -> str:
    """The default tokenizer; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_held: dict = {}


def held(kind: str, key, make):
    """What an operator keeps in a Python worker between tasks (a tokenizer, an automaton, vectors): one thing at a
    time, since workers outlive the operators that they serve and their memory is the executor's."""
    if (kind, key) not in _held:
        _held.clear()
        release()
        _held[kind, key] = make()
    return _held[kind, key]


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
