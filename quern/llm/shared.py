"""What the operators share: the cluster's shared folder, written tables, bounded Arrow batches and worker memory."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_caches: list[Callable[[], None]] = []
_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, removed at exit; a local one only where that setting is absent and the master is local (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_dirs.get(sc.applicationId)
        if base is None:
            base = _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="quern-")
            sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"
    for made in _made[-1:]:
        made.append(path)
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may already be gone at exit
        pass


@contextmanager
def removing(spark: SparkSession) -> Iterator[None]:
    """Folders made inside are removed at the end, so results that need them must have been written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def written(df: DataFrame, compression: str = "zstd", path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    path = path or shared_dir(df.sparkSession)
    df.write.option("compression", compression).option("parquet.block.size", str(32 << 20)).parquet(path)  # writers hold a block in memory
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of results that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` returns, and remove the tables and shuffle files that it left on the way."""
    path = shared_dir(spark)
    with removing(spark):
        out = written(make(), path=path)
    tidy(spark)
    return out


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join with ``table``, which has one row a key and its number of ``rows`` in column ``count``.

    Keys with more than a thousandth of all ``total`` rows (so a thousand keys at most) are broadcast, and their rows stay where
    they are; the others are shuffled.
    """
    many = F.col(count) > max(total // 1000, 1000)
    hot, cold = table.where(many).drop(count), table.where(~many).drop(count)
    here = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return here.unionByName(rest)


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Let Arrow batches to Python workers hold at most about ``limit`` bytes, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = spark.conf.get(name).lower().removesuffix("b")
    if not set_to.isdigit() or not 0 < int(set_to) <= limit:
        spark.conf.set(name, str(limit))


def cached_until_release(drop: Callable[[], None]) -> None:
    """Say how to empty a cache that a Python worker keeps between its tasks."""
    _caches.append(drop)


def release_caches() -> None:
    """Empty what other operators cached in this reused Python worker, and give the memory back."""
    if not _caches:
        return
    while _caches:
        _caches.pop()()
    gc.collect()
    give_back()


def give_back() -> None:
    """Give the system the memory that this Python worker freed but still holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds at most ``limit`` bytes a slice (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
        ends = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + n + 1].astype(np.int64)
        at = 0
        while at < n:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, nulls as empty: (flat uint8, int64 offsets)."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, off - off[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, for all i in turn."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    some = lengths > 0
    if not total:
        return out
    s, n = starts[some], lengths[some]
    first = np.cumsum(n) - n
    out[first] = s
    out[first[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
