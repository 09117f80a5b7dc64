"""What the operators of this subpackage share: stored stages and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch that an operator works on at once; a larger row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 20


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Gives back to the system what a worker's allocators keep: workers outlive their tasks, side by side with the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most BATCH_ROWS rows and about BATCH_BYTES bytes: bounds what a worker unpacks at once."""
    for batch in batches:
        n = batch.num_rows
        rows = max(1, min(BATCH_ROWS, n * BATCH_BYTES // max(1, batch.nbytes)))
        stack = [(a, min(rows, n - a)) for a in range(0, n, rows)][::-1]
        while stack:
            a, k = stack.pop()
            part = batch.slice(a, k)
            if k > 1 and part.nbytes > 2 * BATCH_BYTES:
                stack += [(a + k // 2, k - k // 2), (a, k // 2)]
            else:
                yield part
    release()


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, local mode gets a temporary one; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="keystrata-")
    return _local["dir"]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored stage."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch
        pass


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a stage to the shared folder and reads it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(discard, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + (1 << 17))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, _INV)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result can be used."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[bytes], limit: int = CHUNK):
    """Index ranges of texts that together hold about ``limit`` bytes."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], is_word: np.ndarray, lower: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin (one entry more than texts).

    A word is a maximal run of bytes for which ``is_word`` holds; ``lower`` maps bytes first.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = lower[data]
    mask = is_word[data]
    edge = np.flatnonzero(np.diff(mask, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return hashes, np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))


SPACED_WORD = ~_SEP
