"""Resampling towards a target: documents drawn by how well their words fit it.

A feature is a run of consecutive words; its bucket is the CRC-32 of its bytes. Counts per
bucket over all documents and over the target give each bucket a gain, a document weighs
the gains of its features, and a draw with Gumbel noise takes the best.

Words are found by an Aho-Corasick dictionary: patterns are words between two delimiters,
so only whole words match, and each carries the CRC and the length of its word as payload.
A scan of a block gives the payloads in order; the CRC of a run of words is composed of the
payloads of its words, since the CRC of joined texts follows from their CRCs and lengths.
Each worker's dictionary learns the words it missed, up to ``ENTRIES`` words of at most
``LONGEST`` bytes; for words outside it the payload is computed where they stand, so the
bound moves work only.
"""

from __future__ import annotations

import itertools
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm import common

BUCKETS = 10_000
RUN = 1
FEW_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Words of a worker's dictionary, and the bytes of the longest one: some 20 MB.
ENTRIES, LONGEST = 1 << 16, 40
POLYNOMIAL = 0xEDB88320

_SPACE = np.where(common.PLAIN[common.LOWERED], 32, common.LOWERED).astype(np.uint8)


def _after_bytes(length: int) -> np.ndarray:
    """For each bit of a CRC-32 what becomes of it when ``length`` zero bytes follow."""
    made: dict[int, np.ndarray] = common.remembered.setdefault("crc_powers", {})
    if not made:
        one = np.left_shift(np.uint64(1), np.arange(32, dtype=np.uint64))
        for _ in range(8):
            one = (one >> np.uint64(1)) ^ np.where(one & np.uint64(1), np.uint64(POLYNOMIAL), np.uint64(0))
        made[0] = one
    out, k = np.left_shift(np.uint64(1), np.arange(32, dtype=np.uint64)), 0
    while length:
        if k not in made:
            made[k] = _apply(np.broadcast_to(made[k - 1], (32, 32)), made[k - 1])
        if length & 1:
            out = _apply(np.broadcast_to(made[k], (32, 32)), out)
        length, k = length >> 1, k + 1
    return out


def _apply(bits: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """``bits`` (one row of 32 for each value) applied to the set bits of ``crc``."""
    out = np.zeros(len(crc), np.uint64)
    for j in range(32):
        out ^= np.where((crc >> np.uint64(j)) & np.uint64(1), bits[:, j], np.uint64(0))
    return out


def composed(crc: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of joined texts, given those of both parts and the bytes of the second."""
    sizes, which = np.unique(length, return_inverse=True)
    tables = np.array([_after_bytes(int(n)) for n in sizes], np.uint64).reshape(-1, 32)
    return _apply(tables[which], crc) ^ more


class Dictionary:
    """Words between delimiters as an automaton, with the CRC and length of each."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.crc, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.automaton = None
        self.missed: set[bytes] = set()

    def learn(self) -> None:
        """Take in the words missed so far, once they are many against those held."""
        if len(self.missed) < max(64, len(self.ids) // 4) or len(self.ids) >= ENTRIES:
            return
        for w in sorted(self.missed)[:ENTRIES - len(self.ids)]:
            self.ids[w] = len(self.ids)
        self.missed.clear()
        self.crc = np.array([zlib.crc32(w) for w in self.ids], np.uint64)
        self.size = np.array([len(w) for w in self.ids], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for w, i in self.ids.items():
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def payloads(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of the words of ``raw``, which stand between spaces."""
        crc, size = np.zeros(len(start), np.uint64), end - start
        known = np.zeros(len(start), bool)
        if self.automaton is not None:
            hits = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(raw.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(end, hits[:, 0])  # a match ends at the delimiter behind its word
            crc[at], size[at], known[at] = self.crc[hits[:, 1]], self.size[hits[:, 1]], True
        room = len(self.ids) < ENTRIES
        for i in np.flatnonzero(~known):
            w = raw[start[i]:end[i]]
            crc[i] = zlib.crc32(w)
            if room and len(w) <= LONGEST and len(self.missed) < ENTRIES:
                self.missed.add(w)
        return crc, size


def scanned(texts: pa.Array, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, at, n_words): the buckets of all features of a block of texts, text by text,
    the range of each text (one more entry), and the words of each. A null has none."""
    book = common.remembered.setdefault("dictionary", None) or Dictionary()
    common.remembered["dictionary"] = book
    n = len(texts)
    flat = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + n + 1] if n else np.zeros(1, np.int64)
    data = flat.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    spaced = np.append(np.insert(_SPACE[body], at[:-1], 32), np.uint8(32))  # a delimiter before each text, and behind all
    inside = spaced != 32
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    crc, size = book.payloads(spaced.tobytes(), start, end)
    book.learn()
    first = np.searchsorted(start, at + np.arange(n + 1))
    doc = np.repeat(np.arange(n), np.diff(first))
    owners, found, run_crc = [doc], [crc], crc
    space = np.uint64(zlib.crc32(b" "))
    for k in range(2, run + 1):
        if len(crc) < k:
            break
        ones = np.ones(len(run_crc) - 1, np.int64)
        run_crc = composed(composed(run_crc[:-1], np.full(len(ones), space, np.uint64), ones), crc[k - 1:], size[k - 1:])
        whole = doc[k - 1:] == doc[:len(doc) - k + 1]
        owners.append(doc[:len(whole)][whole])
        found.append(run_crc[whole])
    owner, value = np.concatenate(owners), np.concatenate(found) % np.uint64(buckets)
    order = np.argsort(owner, kind="stable") if run > 1 else slice(None)
    owner, value = owner[order], value[order].astype(np.int64)
    return value, np.searchsorted(owner, np.arange(n + 1)), np.diff(first)


def counts(texts: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features per bucket over all rows. A task gives out one row per bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in common.blocks(batch, "text"):
                total += np.bincount(scanned(part.column("text"), run, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: how much likelier its features are in the target, in
    thousandths of a nat, floored. Counts start at one, so no bucket is impossible."""
    have, want = (counts(t, text, run, buckets).withColumnRenamed("n", c) for t, c in ((docs, "s"), (target, "t")))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = common.stage(every.join(have, "bucket", "left").join(want, "bucket", "left").select(
        "bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "counts")
    sums = both.agg(F.struct(F.sum("s").alias("s"), F.sum("t").alias("t"))).scalar()
    up = (F.col("t") + 1).cast("double") * (sums["s"] + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (sums["t"] + buckets).cast("double")
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).cast("bigint").alias("gain"))


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the key alone (null counts as the empty text)."""
    drawn = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(drawn, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def score(docs: DataFrame, gain: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, buckets: int = BUCKETS,
          seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score. The gains, one
    number per bucket, are sent to all tasks."""
    table = np.zeros(buckets, np.int64)
    held = gain.toArrow()
    table[held.column("bucket").to_numpy()] = held.column("gain").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(table)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["id"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def weigh(batches):
        for batch in batches:
            for part in common.blocks(batch, "text"):
                bucket, at, words = scanned(part.column("text"), run, buckets)
                total = np.append(0, np.cumsum(sent.value[bucket]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(words, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(total[at[1:]] - total[at[:-1]], pa.int64())], names=schema.names)

    return source.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def ranked(scored: DataFrame, few_words: int = FEW_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``scored`` with ``rank``: 1, 2, 3... for those drawn, else null.

    Of the N rows with ``few_words`` words or more the floor(percent N / 100) with the
    highest scores are drawn; ties go to the smaller id (null first), repeated rows in any
    order. Rows are sorted over all tasks and written with their places: a rank is the rows
    of the parts before plus the place in its own part, so no task sees all rows.
    """
    scored = common.stage(scored, "scored")
    can = F.col("n_words") >= few_words
    n = scored.where(can).count() * percent // 100
    placed = common.stage(scored.where(can).orderBy(F.desc("score"), "id").withColumns({
        "part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "ranks")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    shift = parts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    rank = (F.col("place") + F.col("shift")).cast("bigint")
    best = placed.join(shift, "part").withColumn("rank", F.when(rank <= n, rank)).select(*scored.columns, "rank")
    return best.union(scored.where(~can).withColumn("rank", F.lit(None).cast("bigint")))


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, buckets: int = BUCKETS,
         few_words: int = FEW_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every row of ``docs``, drawn towards
    the texts of ``target``.

    Null and empty texts have no features and weigh nothing; they are drawn only if
    ``few_words`` is 0. Rows with a null id share their noise. Texts of any length are read
    whole. Of ``docs`` only ``key`` and ``text`` are read, of ``target`` only ``text``. An
    empty target makes frequent words weigh less; an empty table gives no rows.
    """
    return ranked(score(docs, gains(docs, target, text, run, buckets), key, text, run, buckets, seed), few_words, percent)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = draw(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
