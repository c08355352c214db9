"""Language by a byte convolutional network.

Bytes are embedded; filters of several widths slide over a window of fixed length; the
largest answer of each filter goes to a softmax over the languages. Trained in numpy on a
bounded sample of labelled windows, drawn by hash from all labelled texts. A text is cut
into windows, every byte in one, and its language is that of the largest mean probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm import common

LENGTH = 256  # bytes of a window
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 8, 4
#: Windows per language that training sees, about; and of all languages together, about:
#: with very many languages each has fewer, but all have some.
SAMPLE, TOTAL = 1500, 300_000
EPOCHS, RATE, BATCH = 12, 0.02, 128
HELD_OUT = 2
WIDEST = max(WIDTHS)


@dataclass
class Network:
    names: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # WIDEST * EMBEDDING x filters; narrower ones are zero beyond their width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest answer per filter of each window (n x LENGTH bytes), its place, and
        the embedded bytes."""
        x = self.embedding[windows]
        n, k = len(windows), LENGTH - WIDEST + 1
        spread = np.concatenate([x[:, j:j + k] for j in range(WIDEST)], axis=2)
        answers = (spread.reshape(n * k, -1) @ self.filters).reshape(n, k, -1)
        place = answers.argmax(axis=1) if self.training else None
        best = answers.max(axis=1) + self.bias
        return np.maximum(best, 0), place, spread

    training = False

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self.features(windows)[0] @ self.out + self.out_bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], seed: int = 7) -> Network:
    """Adam on the cross-entropy; the gradient of a maximum reaches one place only."""
    rng = np.random.default_rng(seed)
    f = FILTERS * len(WIDTHS)
    used = np.zeros((WIDEST, EMBEDDING, f), np.float32)
    for i, width in enumerate(WIDTHS):
        used[:width, :, i * FILTERS:(i + 1) * FILTERS] = 1
    used = used.reshape(-1, f)
    net = Network(names, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), (rng.normal(0, 0.4, used.shape) * used).astype(np.float32),
                  np.zeros(f, np.float32), rng.normal(0, 0.3, (f, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    net.training = True
    values = [net.embedding, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    count = np.bincount(labels, minlength=len(names))
    weight = (len(labels) / (len(names) * np.maximum(count, 1))).astype(np.float32)[labels]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(windows))
        for s in range(0, len(order), BATCH):
            pick = order[s:s + BATCH]
            best, place, spread = net.features(windows[pick])
            logits = best @ net.out + net.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= weight[pick, None] / len(pick)
            back = (p @ net.out.T) * (best > 0)
            rows = spread[np.arange(len(pick))[:, None], place]  # window, filter, inputs
            to_filters = np.einsum("nfk,nf->kf", rows, back) * used
            inputs = back[:, :, None] * net.filters.T[None]  # window, filter, inputs
            to_embedding = np.zeros_like(net.embedding)
            at = windows[pick][np.arange(len(pick))[:, None, None], place[:, :, None] + np.arange(WIDEST)]
            np.add.at(to_embedding, at, inputs.reshape(*at.shape, EMBEDDING))
            step += 1
            for v, g, m1, m2 in zip(values, (to_embedding, to_filters, back.sum(0), best.T @ p, p.sum(0)), first, second):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                v -= (RATE * 0.9 ** epoch) * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-7)
    net.training = False
    return net


def cut(raw: bytes) -> np.ndarray:
    """Windows over all bytes of a text; the last one is filled up with spaces."""
    n = max(1, -(-len(raw) // LENGTH))
    return np.frombuffer(raw.ljust(n * LENGTH), np.uint8).reshape(n, LENGTH)


def sample(docs: DataFrame, key: str, lang: str, text: str, per_language: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and names: two windows a text, anywhere in it, of texts chosen by a hash
    of key and text so that about ``per_language`` windows come from each language."""
    # Written, so that its size is known and the texts need not move to meet it.
    seen = common.stage(docs.groupBy(lang).agg(F.count(F.lit(1)).alias("_n")), "languages")
    names = sorted(r[0] for r in seen.select(lang).collect())
    if not names:
        return np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), ["und"]
    texts = max(1.0, min(per_language, TOTAL / len(names)) / 2)
    chance, place = (F.xxhash64(F.lit(k), F.col(key).cast("string"), F.col(text)) for k in (5, 6))
    chosen = docs.join(seen, lang).where((F.pmod(chance, F.lit(1 << 30)) + 0.5) * F.col("_n") < F.lit(texts * (1 << 30)))

    def run(batches):
        for batch in batches:
            raws, of = [], []
            for t, name, x in zip(*(batch.column(c).to_pylist() for c in (text, lang, "h"))):
                raw = t.encode()
                for k in (x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF):
                    at = k % max(1, len(raw) - LENGTH + 1)
                    raws.append(raw[at:at + LENGTH])
                    of.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(raws, pa.binary()), pa.array(of, pa.string())], names=["raw", "name"])

    rows = chosen.select(text, lang, place.alias("h")).mapInArrow(run, "raw binary, name string").toPandas().sort_values(["name", "raw"])
    number = {x: i for i, x in enumerate(names)}
    windows = np.concatenate([cut(bytes(r)) for r in rows["raw"]]) if len(rows) else np.zeros((0, LENGTH), np.uint8)
    return windows, np.array([number[x] for x in rows["name"]], np.int64), names


def predict(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred and score (mean probability) of each row; ``und`` with score 0 for
    null texts and texts without a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        net = sent.value
        names = np.array([*net.names, "und"], object)
        for batch in batches:
            for part in common.blocks(batch, text, 256 << 10):
                raws = [x or b"" for x in part.column(text).cast(pa.large_binary()).to_pylist()]
                n = np.array([max(1, -(-len(r) // LENGTH)) for r in raws])
                windows = np.frombuffer(b"".join(r.ljust(k * LENGTH) for r, k in zip(raws, n)), np.uint8).reshape(-1, LENGTH)
                p = np.concatenate([net.probabilities(windows[i:i + 64]) for i in range(0, len(windows), 64)])
                mean = np.add.reduceat(p, np.concatenate([[0], np.cumsum(n)[:-1]])) / n[:, None]
                letters = pc.fill_null(pc.match_substring_regex(part.column(text), r"\pL"), False).to_numpy(zero_copy_only=False)
                best = np.where(letters, mean.argmax(axis=1), len(net.names))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(names[best], pa.string()),
                                                  pa.array(np.where(letters, mean.max(axis=1), 0.0).astype(np.float64))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE) -> DataFrame:
    """Trains on rows with a language outside the held-out fold, then predicts all rows.

    Without any such row everything with a letter is ``und``. Repeated rows each count.
    """
    known = docs.where((common.fold(F.col(key)) != HELD_OUT) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    windows, labels, names = sample(known.select(key, text, F.col(lang).cast("string").alias(lang)), key, lang, text, per_language)
    out = predict(docs, train(windows, labels, names), key, text)
    return out.withColumn("held_out", common.fold(F.col(key)) == HELD_OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
