"""Shared helpers: scratch folders, Arrow buffers, vectorised word and k-gram hashing.

All text work runs over UTF-8 bytes in numpy, in blocks of about half a megabyte, so memory does not depend on
how many rows an Arrow batch holds.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 19
U = np.uint64


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share; it is the session's spark.checkpoint.dir.

    Where that is unset a session of one process, as in tests, gets a folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are long: keep Arrow batches to a few megabytes unless the session has asked for a size itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def row_key():
    """128 bits that name a row by its doc_id and text; rows that repeat in both share it, and every result."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\x1f"), F.coalesce(F.col("text"), F.lit("")))))


def text_key():
    """128 bits that name a text."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes each; a longer text has a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


class Roller:
    """Hashes of all windows of a block that are a fixed, short number of bytes long, from prefix sums modulo 2**64.

    Such sums have systematic collisions among ranges of 1,024 bytes and more, so they serve for windows up to 512 only;
    whatever may be longer goes through `range_hashes`.
    """

    _pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data) + 1
        have = Roller._pow.get(seed)
        if have is None or len(have[0]) < n:
            base = 0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64) | 5  # 5 modulo 8: of the longest period
            base -= base & 2
            size = max(n, BLOCK * 5 // 4)
            p, q = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            p[0] = q[0] = 1
            have = (np.cumprod(p), np.cumprod(q))
            if size <= 4 * BLOCK:
                Roller._pow[seed] = have
        self.inv = have[1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_table(seed)[data] * have[0][: n - 1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of at most 512 bytes."""
        assert not len(start) or int((end - start).max()) <= 512
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of each k bytes."""
        assert k <= 512
        m = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:m]) * self.inv[:m]) if m > 0 else np.zeros(0, np.uint64)


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Ranges longer than this are hashed one by one.
LONG = 512


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a little-endian number; zeros follow the data."""
    padded = np.zeros(len(data) + 9, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte ranges of any length: eight bytes a round, each round through the finaliser."""
    n = end - start
    out = mix(n.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))
    at, todo, p = lanes(data), np.flatnonzero((n > 0) & (n <= LONG)), 0
    where, left, h = start[todo], n[todo], out[todo]
    while len(todo):
        h = mix(h ^ (at[where] & _MASK[np.minimum(left, 8)]))
        p += 8
        more = left > 8
        if not more.all():
            done = ~more
            out[todo[done]] = h[done]
            todo, where, left, h = todo[more], where[more], left[more], h[more]
        where, left = where + 8, left - 8
    for i in np.flatnonzero(n > LONG):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=int(seed).to_bytes(4, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block of texts.

    start and end are byte positions within the block, doc the row of each word, first[d]:first[d+1] the words of row d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        base = int(offsets[0])
        self.offsets = offsets - base
        raw = data[base : int(offsets[-1])]
        self.data = _LOWER[raw] if lower else raw
        n = len(raw)
        solid = ~_SPACE[self.data]
        begin = np.ones(n + 1, bool)
        begin[1:n] = ~solid[:-1]
        begin[self.offsets] = True
        self.start = np.flatnonzero(solid & begin[:n])
        stop = np.ones(n + 1, bool)
        stop[:n] = ~solid
        stop[self.offsets] = True
        self.end = np.flatnonzero(solid & stop[1:]) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(self.offsets)))
        self.hash = range_hashes(self.data, self.start, self.end) if hashes else None


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """An order-dependent hash of each k values in a row."""
    m = len(values) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = values[:m].copy()
    for i in range(1, k):
        h *= U(0x9E3779B97F4A7C15)
        h += values[i : i + m]
    return mix(h)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles, ordered by row and hash; the whole text where it has fewer words."""
    h = windows(w.hash, k)
    m = len(h)
    good = w.doc[:m] == w.doc[k - 1 :] if m else np.zeros(0, bool)
    rows, values = [w.doc[:m][good]], [h[good]]
    n = np.diff(w.first)
    for d in np.flatnonzero((n > 0) & (n < k)):
        v = np.array([n[d]], np.uint64)
        for i in range(w.first[d], w.first[d + 1]):
            v = v * U(0xC2B2AE3D27D4EB4F) + w.hash[i : i + 1]
        rows.append(np.array([d]))
        values.append(mix(v))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
    return row, value


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + length[i] - 1 of each i, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)


def long_binary(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array whose i-th value holds lengths[i] items of flat."""
    offs = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * flat.itemsize, out=offs[1:])
    if offs[-1] < 2**31 - 1:
        return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
