"""What the text operators share: reading tables, staging, and words of Arrow batches.

Words are found on the UTF-8 bytes of a whole batch at once. ``SPACED`` words are runs
of anything but space and \\x09-\\x0D; ``PLAIN`` words are runs of a-z, 0-9 and every
code point above \\x7F after lower-casing A-Z.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import session

#: Bytes of text that are worked on at once in a task; a longer single text goes alone.
BLOCK_BYTES = 1 << 19

#: Bits of the filter of ``likely``: broadcast, an eighth in bytes.
LIKELY_BITS = 1 << 25

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
SPACED = np.zeros(256, bool)
SPACED[[32, *range(9, 14)]] = True
PLAIN = np.zeros(256, bool)
PLAIN[0:48] = PLAIN[58:97] = PLAIN[123:128] = True

_ROOT = 0x9E3779B97F4A7C15 | 5
_BACK = pow(_ROOT, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")  # long texts come in smaller batches
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_noting: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders that ``stage`` makes inside."""
    made: list[str] = []
    _noting.append(made)
    try:
        yield made
    finally:
        _noting.remove(made)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends
    there, and a lost executor costs no recomputation of what came before."""
    path = session.work_folder(df.sparkSession, f"llm/{name}")
    for made in _noting:
        made.append(path)
    df.write.parquet(path + "/t")
    return df.sparkSession.read.schema(df.schema).parquet(path + "/t")


#: What a worker remembers from task to task.
remembered: dict[str, object] = {}


def let_go(*keep: str) -> None:
    """Give back what earlier stages left in this worker: what it remembers, but for
    ``keep``, powers, and memory that Arrow and the allocator hold without using it."""
    global _powers
    for name in set(remembered) - set(keep):
        del remembered[name]
    _powers = None
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def with_label(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Documents that have a label; of several rows for one id the largest value holds.
    Texts move once, to meet the narrow side, which is built as the hash table."""
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label")))
    return docs.join(one.hint("shuffle_hash"), "doc_id")


def likely(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``docs`` whose whole number ``key`` is in ``ids``, and few others: a filter of fixed
    size keeps the rest from being moved."""
    bit = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(LIKELY_BITS))
    held = ids.where(F.col(key).isNotNull()).select(F.floor(bit / 32768).alias("part"), (bit % 32768).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    bits = np.zeros((LIKELY_BITS // 32768, 4096), np.uint8)
    for r in held.toArrow().to_pylist():
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits.ravel())

    def run(batches):
        let_go()
        for batch in batches:
            at = batch.column("_bit").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)).drop_columns(["_bit"])

    return docs.select("*", bit.alias("_bit")).mapInArrow(run, docs.schema)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of ``column`` (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing steps of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        made = []
        for root in (_ROOT, _BACK):
            x = np.full(size, root, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = made[0], made[1]
    return _powers


@dataclass
class Words:
    """The words of a block of texts: bytes, byte range of each word, 64-bit hash of
    each word, and for each text the range of its words (``at`` has one more entry)."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.start[i]:self.end[i]].tobytes()


def words(texts: pa.Array, separators: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Words of every text of an Arrow string array; a null has none."""
    flat = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(flat) else np.zeros(0, np.uint8)
    at = offsets - offsets[0] if len(flat) else np.zeros(1, np.int64)
    if lower:
        raw = LOWERED[raw]
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(raw, none, none, none.astype(np.uint64), np.zeros(len(at), np.int64))
    inside = ~separators[raw]
    first = np.ones(n + 1, bool)  # a word may start here: after a separator or at a text's start
    first[1:] = ~np.append(inside, False)[:-1]
    first[at] = True
    start = np.flatnonzero(inside & first[:-1])
    end = np.flatnonzero(inside & (np.append(~inside[1:], True) | first[1:])) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(raw * up[:n], out=total[1:])
    size = end - start
    h = (total[end] - total[start]) * down[start] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return Words(raw, start, end, mixed(h), np.searchsorted(start, at))


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` values; as many as there are starts with n values left."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    x = np.full(size, seed, np.uint64)
    for j in range(n):
        x *= np.uint64(0x9FB21C651E98DF25)
        x += h[j:j + size]
    return mixed(x)


def whole(at: np.ndarray, n: int) -> np.ndarray:
    """Whether a run of ``n`` words that starts here stays inside its text."""
    total = int(at[-1])
    if total < n:
        return np.zeros(0, bool)
    end = np.repeat(at[1:], np.diff(at))
    return np.arange(total - n + 1) + n <= end[:total - n + 1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """List column from flat values and the range of each row."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))
