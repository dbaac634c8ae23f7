"""What the operators of this subpackage share: table access, shared-folder staging and word hashing."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the contracts, [\x20\x09-\x0D]. Fixed values.
WS = " \t\n\x0b\f\r"
#: Of an Arrow batch between Spark and a Python worker.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="cohortlens-"))
        found = _OWN[0]
    return found.rstrip("/")


_OWN: list[str] = []


_RUN = uuid.uuid4().hex


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage in a place that outlives executors, and gives Catalyst the real size of the
    table, so that it broadcasts it only when it is below ``spark.sql.autoBroadcastJoinThreshold``.
    The folders go when the driver's Python ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/llm-{_RUN}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if root not in _STAGED:
        _STAGED.add(root)
        atexit.register(_remove, spark, root)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again, so that a long chain of them doesn't pile up."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"/llm-{_RUN}/" in path:
                _remove(df.sparkSession, path)


_STAGED: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already; the folder is scratch space
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python workers can import it wherever they start.

    Arrow batches are bounded in bytes, as texts differ in length by orders of magnitude: a batch is held by the
    executor and by its worker, for each running task.
    """
    sc = spark.sparkContext
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    if getattr(sc, "_cohortlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    at = os.path.join(tempfile.mkdtemp(prefix="cohortlens-zip-"), "cohortlens_pkg.zip")
    with zipfile.ZipFile(at, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "cohortlens")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(at)
    sc._cohortlens_shipped = True


def frugal(run):
    """``run``, an Arrow function, giving the memory that a task has freed back to the machine when it ends.

    Spark keeps Python workers for the next task, and with them what their allocators hold back.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: the worker just keeps what it holds
        pass


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; the fast ``lower`` where the text is ASCII throughout."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, 1 << 20)
        for base, which in ((_BASE, "_POW"), (_BASE_INV, "_INV")):
            out = np.full(n, np.uint64(base), np.uint64)
            out[0] = 1
            globals()[which] = np.multiply.accumulate(out)
    return _POW, _INV


_IS_WS = np.zeros(256, bool)
_IS_WS[[ord(x) for x in WS]] = True


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the runs of other bytes than ASCII white space."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_IS_WS[buf]
    edge = np.flatnonzero(np.diff(inside))
    return edge[0::2], edge[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[s:e] for each span, equal for equal bytes wherever they stand."""
    pow_, inv = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pow_[: len(buf)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def chunks_of(texts: list, most_bytes: int = 1_000_000):
    """Slices of the list whose texts hold about most_bytes at most; one longer text is a slice of its own."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > begin and held + n > most_bytes:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)
