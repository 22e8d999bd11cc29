"""What the operators of this subpackage share: words, Arrow batches, tables that cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker turns into arrays at a time.
CHUNK_BYTES = 8 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or the one set on the context. Where neither is set, a
    temporary folder of this machine if all runs in this process (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quarrymill-"))
    return context._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables in the shared folder that cut an operator's lineage.

    Each is written once and read back, so that a lost executor costs its own tasks and no earlier stage. drop()
    removes those whose readers have run; what the returned DataFrame still reads goes when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n, self.there = 0, {}
        _made.append((spark, self.base))

    def table(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        # the table cuts the lineage, so what was shuffled to make it can go as soon as it is written
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.there[path] = None
        return out

    def drop(self, *tables: DataFrame) -> None:
        for x in tables:
            _delete(self.spark, x.scratch_path)
            self.there.pop(x.scratch_path, None)

    def only(self, *tables: DataFrame) -> None:
        """Removes all tables but these, once nothing else will be read."""
        wanted = {x.scratch_path for x in tables}
        for path in [p for p in self.there if p not in wanted]:
            _delete(self.spark, path)
            del self.there[path]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, base in _made:
        try:
            _delete(spark, base)
        except Exception:  # the session may have ended before Python does; the cluster clears its folder then
            return


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts as UTF-8; null: empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about limit bytes of text; a longer text has a slice of its own."""
    size = np.asarray(pa.compute.binary_length(batch.column("text")).fill_null(0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def trim() -> None:
    """Gives memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: it gives memory back in its own time
        return


def trimmed(run: Callable) -> Callable:
    """For mapInArrow: a worker that waits for its next task holds no more than its table."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """A Python worker's table of what it has seen, for its later tasks too: one operator's at a time, so that workers
    that serve one operator after another don't hold the tables of all."""
    if name not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            trim()
        _kept[name] = make()
    return _kept[name]


class WordHash(dict):
    """64-bit hash of each word, kept for words seen lately; its size is bounded."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_all(docs: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts in a row, and where each text's begin (one entry more than texts)."""
    parts = [x.split() for x in docs]
    bounds = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=bounds[1:])
    return [w for x in parts for w in x], bounds


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on, for every place with k words left in the row."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    out, width = h, 1
    power = base
    bits = bin(k)[3:]
    for b in bits:  # double the width, then add a word where the binary form of k has a one
        n = len(out) - width
        out = out[:n] * np.uint64(power) + out[width : width + n]
        width, power = 2 * width, power * power % 2**64
        if b == "1":
            n = len(h) - width
            out = out[:n] * np.uint64(base) + h[width : width + n]
            width, power = width + 1, power * base % 2**64
    return mix(out)


def sha256_hex(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
