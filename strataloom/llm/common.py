"""Helpers that several operators share: sessions, shared folders, blocks of texts, words."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])

#: Bytes of text that one vectorised step works on; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of an Arrow batch on its way to Python: executors and workers hold a few of them.
BATCH_BYTES = 8 << 20

#: Rows of a table that is broadcast at most (two 16-byte keys each, so about 30 MB); more are joined by shuffle.
BROADCAST_ROWS = 200_000

#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, space.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


try:  # glibc has it
    _MALLOC_TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _MALLOC_TRIM = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark opens the path."""
    # Workers that are not started from the repository find the package through this.
    spark.sparkContext.environment.setdefault("PYTHONPATH", REPO)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's checkpoint folder, for files that several executors read.

    Where the session names none and runs on this machine alone (tests), a temporary folder is set that goes with the
    process; a cluster without the setting is an error, as its machines would each write to a disk of their own. Tables
    in a cluster's folder stay until they are removed there, as results are read lazily.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            top = found.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder, and executors need one that they share")
        else:
            own = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            top = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows; df is a stored table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text and the label of at most `rows` documents, chosen by a hash of their ids: one row an id.

    Null labels and ids teach nothing, nor do ids whose labels differ; of texts that share an id the smallest counts.
    """
    told = labels.select("doc_id", label).dropna().groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("_most"))
    chosen = told.where(F.col(label) == F.col("_most")).drop("_most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` ids: two columns of a few bytes.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", label).agg(F.min("text").alias("text"))


def input_bytes(df: DataFrame) -> int:
    """What the optimizer knows of the input's size, from file sizes, without a job."""
    try:
        return max(1, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    except Exception:  # a plan without statistics
        return 1 << 30


def as_bytes(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        kind = np.int64
    else:
        kind = np.int32
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(lengths: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `limit` bytes each; every row is in one of them."""
    if not len(lengths):
        return
    total = np.cumsum(lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), len(lengths)]
    for a, b in itertools.pairwise(cuts):
        if b > a:
            yield a, b


def trim() -> None:
    """Gives freed memory back to the system; workers are used again and would keep their peaks."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM is not None:
        _MALLOC_TRIM(0)


def batches(it: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of `it` in tables of about `limit` bytes of `column`; small batches are joined."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in it:
        _, off = as_bytes(batch.column(batch.schema.get_field_index(column)))
        for a, b in blocks(np.diff(off), limit):
            held.append(batch.slice(a, b - a))
            size += int(off[b] - off[a])
            if size >= limit // 2:
                whole, held, size = pa.Table.from_batches(held), [], 0
                yield whole
                del whole
                trim()
    if held:
        yield pa.Table.from_batches(held)
        del held
    trim()


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block of texts.

    codes: for each word its index in `dictionary`; of document d, the words
    offsets[d]:offsets[d + 1]. Equal words have equal codes.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        solid = ~_SPACE[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = off[:-1][off[:-1] < len(data)]
        first[inner] = solid[inner]
        self.starts = np.flatnonzero(first)
        packed = data[solid]
        short = np.int32 if len(data) < 2**31 else np.int64
        place = (np.cumsum(solid, dtype=short)[self.starts] - 1).astype(np.int64)
        edges = np.append(place, len(packed))
        kind, of = (np.int32, pa.binary()) if len(packed) < 2**31 - 1 else (np.int64, pa.large_binary())
        words = pa.Array.from_buffers(of, len(self.starts), [None, pa.py_buffer(edges.astype(kind)), pa.py_buffer(packed)])
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
        self.dictionary = coded.dictionary
        self.offsets = np.searchsorted(self.starts, off)
        self.solid = solid
        self.sizes = np.diff(edges)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def documents(self) -> np.ndarray:
        """For each word its document's index."""
        return np.repeat(np.arange(len(self.offsets) - 1, dtype=np.int64), self.counts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + counts[i] - 1, one run after the other."""
    counts = counts.astype(np.int64, copy=False)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64, copy=False) - (ends - counts), counts)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hashed(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each entry's bytes, alike on every machine."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for x in dictionary.to_pylist()), dtype=np.uint64, count=len(dictionary))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of `width` consecutive entries of h; shorter than h by width - 1."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out, done, part, size = 0x9E3779B97F4A7C15, None, 0, h, 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                piece = part[done : done + n] * np.uint64(pow(base, done, 2**64))
                out = piece if out is None else out + piece
                done += size
            if size * 2 > width:
                break
            part = part[:-size] + part[size:] * np.uint64(pow(base, size, 2**64)) if len(part) > size else part[:0]
            size *= 2
    return mixed(out)
