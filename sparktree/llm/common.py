"""Shared helpers: scratch tables, Arrow batches, vectorised word hashing."""

from __future__ import annotations

import atexit
import hashlib
import secrets
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at a time, unless one document is longer.
SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch that Spark sends to a Python worker.
BATCH_BYTES = 4 << 20

_scratch: list[tuple[SparkSession, str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    return "/tmp/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, "path", path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a
    lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Like ``materialize``, as a table bucketed by ``key``: later groupings by
    ``key`` read it without a shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    _scratch.append((spark, "table", table))
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def drop_scratch() -> None:
    """Delete all scratch tables written so far. Call it only when no DataFrame that
    an operator returned is still to be evaluated; it also runs at exit."""
    while _scratch:
        spark, kind, what = _scratch.pop()
        try:
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS `{what}`")
            else:
                path = spark._jvm.org.apache.hadoop.fs.Path(what)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            continue


atexit.register(drop_scratch)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs now."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Give a Python worker's free memory back: workers live on from task to task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def tidied(run):
    """``run``, a function of an iterator, that leaves no free memory behind."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Let Spark end an Arrow batch at BATCH_BYTES, from now on in this session. Its own
    bounds, 10,000 rows and 64 MB, hold tens of MB of texts in both processes, and the
    JVM keeps most of what its threads have once allocated for them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(df: DataFrame, text: str) -> int:
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary(column) -> pa.Array:
    """An Arrow string column as UTF-8 bytes, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return column
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def slices(batch: pa.RecordBatch | pa.Table, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Cut a batch where its text reaches ``most`` bytes."""
    if not batch.num_rows:
        return
    raw = binary(batch.column(batch.schema.get_field_index(text)))
    _, ends = flat(raw)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column one after another, and each row's end in them."""
    wide = pa.types.is_large_binary(raw.type)
    offsets = np.frombuffer(raw.buffers()[1], np.int64 if wide else np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
    data = raw.buffers()[2] if len(raw) else None
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets[1:] - offsets[0]


_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    return mix(mix(a + _ODD) + b)


def placed(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """What a byte at a place in a word adds to the word's hash."""
    return mix(((place << np.uint64(8)) | byte) + _ODD)


def sized_hash(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of a word of so many bytes from the sum of what they add."""
    return mix(total + size.astype(np.uint64) * _ODD)


#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def drawn_seed() -> int:
    """A seed for word hashes that texts can't have been made for; drawn once for a run and shipped."""
    return secrets.randbits(63)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words at these places. Each block of eight bytes is mixed
    into what the blocks before it made, twice with different beginnings; words of over
    LONG_WORD bytes are hashed by keyed BLAKE2b."""
    size = end - start
    own = mix(np.array([seed, seed ^ 0x5DEECE66D], np.uint64) + _ODD)
    both = [mix(own[i] + size.astype(np.uint64) * _ODD) for i in (0, 1)]
    bytes_at = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)
    at = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(at):
        block = np.ascontiguousarray(bytes_at[start[at] + done]).view(np.uint64).ravel()
        left = np.minimum(size[at] - done, 8).astype(np.uint64)
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        both[0][at] = mix(both[0][at] ^ block)
        both[1][at] = mix((both[1][at] + block) * (own[0] | np.uint64(1)))
        done += 8
        at = at[size[at] > done]
    key = int(seed).to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=16, key=key).digest()
        both[0][i], both[1][i] = np.frombuffer(digest, np.uint64)
    return both[0], both[1]


#: Which bytes make words: all but 0x20 and 0x09-0x0D.
PLAIN = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


class Words:
    """The words (runs of ``inside`` bytes) of a binary column.

    ``start``/``end``: byte ranges in ``buf``; ``first``: index of each row's first
    word, with the number of words at its end; ``hash``: a 64-bit hash of each word under
    ``seed``.
    """

    def __init__(self, raw: pa.Array, lower: bool = False, inside: np.ndarray = PLAIN, seed: int = 0):
        buf, row_end = flat(raw)
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
        inside = inside[buf]
        before = np.zeros(len(buf), bool)
        before[1:] = inside[:-1]
        row_start = np.concatenate([[0], row_end[:-1]]).astype(np.int64) if len(row_end) else np.zeros(0, np.int64)
        before[row_start[row_start < len(buf)]] = False
        self.buf, self.row_start, self.row_end = buf, row_start, row_end
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(buf), bool)
        after[:-1] = inside[1:]
        after[row_end[(row_end > 0)] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.append(np.searchsorted(self.start, row_start), len(self.start))
        self._hash = self._check = None
        self.seed = seed

    def _hashes(self) -> None:
        self._hash, self._check = word_hashes(self.buf, self.start, self.end, self.seed)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hashes()
        return self._hash

    @property
    def check(self) -> np.ndarray:
        """A second hash of each word, for those that must not meet by chance or design."""
        if self._check is None:
            self._hashes()
        return self._check

    def windows(self, k: int, of: str = "hash") -> np.ndarray:
        """A hash of the k words from each word on, across rows (see ``whole``): windows
        of a power of two are paired from their halves, others from two that overlap."""
        out, size = getattr(self, of), 1
        if len(out) < k:
            return np.zeros(0, np.uint64)
        while 2 * size <= k:
            out = paired(out[: len(out) - size], out[size:])
            size *= 2
        return paired(out[: len(out) - (k - size)], out[k - size :]) if size < k else out

    def row(self) -> np.ndarray:
        """Each word's row."""
        return np.repeat(np.arange(len(self.row_start)), np.diff(self.first))

    def whole(self, k: int) -> np.ndarray:
        """Of the k-word windows, those that lie in one row."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        ends = np.repeat(self.first[1:], np.diff(self.first))[:n]
        return np.arange(n) + k <= ends


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start, count of them, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + shift
