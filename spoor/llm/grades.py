"""Quality grades by ordinal regression with a cumulative link.

One weight per hashed feature of the text, shared by all grades, gives a text's value;
ordered thresholds turn it into P(grade <= k) = logistic(threshold_k - value), hence an
expected grade and tail probabilities. Features are words and word endings, averaged over
the text, so a value is a mean of looked-up weights. Fitted in numpy on a bounded sample
of graded rows, drawn by hash from all of them; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm import common

BITS = 16
SIZE = 1 << BITS
#: Graded rows that the fit sees, about.
SAMPLE = 6000
EPOCHS, RATE, BATCH, RIDGE = 30, 0.05, 256, 1e-5
SCALE = 20.0  # of a mean of weights
HELD_OUT = 2
LEAST_GRADE, LEAST_TAIL = 1, 0.3


def features(w: common.Words) -> np.ndarray:
    """Two numbers below 2 * SIZE per word: the word, and its last three bytes."""
    word = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    if not len(word):
        return np.zeros((0, 2), np.int64)
    tail = np.zeros(len(word), np.uint64)
    for j in (1, 2, 3):
        at = w.end - j
        tail = tail * np.uint64(257) + np.where(at >= w.start, w.raw[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return np.stack([word, SIZE + (common.mixed(tail) >> np.uint64(64 - BITS)).astype(np.int64)], axis=1)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # rising, one less than there are grades

    def values(self, w: common.Words) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[features(w)].sum(axis=1))])
        n = np.diff(w.at)
        return SCALE * (total[w.at[1:]] - total[w.at[:-1]]) / np.maximum(n, 1)

    def tails(self, value: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, …: a column per threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - value[:, None], -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, seed: int = 3) -> Ordinal:
    """Adam on the log-likelihood. ``rows``: each text's features. Thresholds stay
    ordered: the first is free, the others add exponentials."""
    rng = np.random.default_rng(seed)
    weights = np.zeros(2 * SIZE)
    share = np.clip(np.array([(grades <= k).mean() if len(grades) else 0.5 for k in range(n_grades - 1)]), 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    shape = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    lows = lambda s: np.concatenate([s[:1], np.exp(s[1:])]).cumsum()
    m1, m2 = [np.zeros_like(weights), np.zeros_like(shape)], [np.zeros_like(weights), np.zeros_like(shape)]
    usable = np.array([i for i, r in enumerate(rows) if len(r)], np.int64)
    step = 0
    for epoch in range(EPOCHS if len(usable) else 0):
        order = rng.permutation(usable)
        for s in range(0, len(order), BATCH):
            pick = order[s:s + BATCH]
            flat = np.concatenate([rows[i].ravel() for i in pick])
            size = np.array([rows[i].size for i in pick])
            doc = np.repeat(np.arange(len(pick)), size)
            value = SCALE * 2 * np.bincount(doc, weights=weights[flat], minlength=len(pick)) / size
            cuts, y = np.concatenate([[-np.inf], lows(shape), [np.inf]]), grades[pick]
            low, high = (1 / (1 + np.exp(-np.clip(cuts[k] - value, -50, 50))) for k in (y, y + 1))
            p = np.maximum(high - low, 1e-12)
            pull = (low + high - 1) / len(pick)  # of the log-likelihood, by value
            g_cut = np.zeros(n_grades + 1)
            np.add.at(g_cut, y + 1, high * (1 - high) / p / len(pick))
            np.add.at(g_cut, y, -low * (1 - low) / p / len(pick))
            g_cut = g_cut[1:-1]
            g_shape = g_cut[::-1].cumsum()[::-1] * np.concatenate([[1.0], np.exp(shape[1:])])
            g_weights = np.bincount(flat, weights=(pull * SCALE * 2 / size)[doc], minlength=2 * SIZE) - RIDGE * weights
            step += 1
            for v, g, a, b in zip((weights, shape), (g_weights, g_shape), m1, m2):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v += RATE * 0.93 ** epoch * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return Ordinal(weights.astype(np.float32), lows(shape))


def sampled(docs: DataFrame, graded: DataFrame, size: int, text: str = "text") -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of about ``size`` graded rows outside the held-out fold."""
    open_fold = common.fold(F.col("doc_id")) != HELD_OUT
    graded = graded.where(open_fold)
    there = graded.count()
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, size / max(there, 1)))
    rows = docs.where(open_fold & chosen).select("doc_id", text).join(graded.where(chosen).hint("shuffle_hash"), "doc_id")

    def run(batches):
        for batch in batches:
            for part in common.blocks(batch, text):
                w = common.words(part.column(text))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("grade"), common.lists(features(w).ravel().astype(np.int32), w.at * 2, pa.int32())], names=["doc_id", "grade", "f"])

    got = rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("grade", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType()))])).toArrow().sort_by("doc_id")
    lists = got.column("f").combine_chunks()
    flat, off = lists.values.to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(lists.offsets)
    return [flat[off[i]:off[i + 1]] for i in range(len(lists))], got.column("grade").to_numpy().astype(np.int64)


def score(docs: DataFrame, graded: DataFrame, n_grades: int, key: str = "doc_id", text: str = "text", size: int = SAMPLE) -> DataFrame:
    """Key, held_out, expected_grade and ``tails`` (P(grade >= k), k from 1) of each row.

    ``graded``: doc_id and grade (0 to ``n_grades`` - 1), one row per id. Null and empty
    texts have value 0. Without graded rows all get the same.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(*sampled(docs, graded, size, text), n_grades))
    schema = T.StructType([docs.schema[key], T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part in common.blocks(batch, text):
                m = model.value
                tails = m.tails(m.values(common.words(part.column(text)))).astype(np.float64)
                at = np.arange(len(tails) + 1) * tails.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(tails.sum(axis=1)), common.lists(tails.ravel(), at, pa.float64())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema).withColumn("held_out", common.fold(F.col(key)) == HELD_OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good. Kept: P(grade >= 1) is at least 0.3."""
    labels = common.table(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    graded = labels.groupBy("doc_id").agg(
        F.when(F.max("quality") == 0, 0).when(F.coalesce(F.max("toxic"), F.lit(0)) == 1, 1).otherwise(2).alias("grade"))
    out = score(common.table(spark, sf_dir, "documents").select("doc_id", "text"), graded, 3)
    tail = F.element_at("tails", LEAST_GRADE)
    return out.select("doc_id", "held_out", "expected_grade", tail.alias("tail_prob"), F.element_at("tails", 2).alias("top_prob"), (tail >= LEAST_TAIL).alias("kept"))
