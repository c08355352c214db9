"""Repeated substrings by seed and extend.

Seeds are winnowed: of the 15 runs of 6 words in a window of 20, the least hash is the
window's seed, so equal windows have equal seeds, however they lie. Seeds are joined
across texts, and only where a seed occurs in several texts is the match extended: the
windows around it, to the left and to the right, are compared by hash with those of the
other texts, and neighbouring equal windows grow together to maximal repeats. A window
belongs to the text that comes first; every word that a later text's equal window covers
is removed.

Texts are compared once per distinct sequence of words. No pairs of texts are made: per
window only the first text is kept, by an aggregation that starts before the shuffle.

Order of documents: by id, null ids last, then by digest. Rows with one id and the same
words are one document. Window hashes have 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm import common

WINDOW, SEED = 20, 6
NOTHING = hashlib.sha256(b"").hexdigest()


def seeds_and_windows(w: common.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start of a block: whether it stays in its text, seed, hash."""
    inside = common.whole(w.at, window)
    if not len(inside):
        return inside, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least, have, want = common.grams(w.hash, SEED, 1), 1, window - SEED + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return inside, least, common.mixed(common.grams(w.hash, window, 2) ^ least)


def _digest(text: bytes) -> tuple[str, int, int]:
    d = hashlib.sha256(b" ".join(text.split()))
    a, b = np.frombuffer(d.digest()[:16], np.int64)
    return d.hexdigest(), int(a), int(b)


def _digests(texts: pa.Array) -> tuple[list[str], pa.Array, pa.Array]:
    made = [_digest(t or b"") for t in texts.cast(pa.large_binary()).to_pylist()]
    return [x[0] for x in made], pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.int64())


def profiles(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """Narrow facts of each row: digest (hex and as two numbers), words, whether a window
    repeats inside the text, and its distinct seeds."""
    schema = T.StructType([docs.schema[key], *[T.StructField(n, t) for n, t in (
        ("n_words", T.LongType()), ("sha", T.StringType()), ("ka", T.LongType()), ("kb", T.LongType()), ("inner", T.BooleanType()),
        ("seeds", T.ArrayType(T.LongType())))]])

    def run(batches):
        common.let_go()
        for batch in batches:
            for part in common.blocks(batch, text):
                w = common.words(part.column(text))
                inside, seed, whole = seeds_and_windows(w, window)
                sha, ka, kb = _digests(part.column(text))
                own, at, inner = [], [0], []
                for d in range(part.num_rows):
                    a, b = w.at[d], max(w.at[d], w.at[d + 1] - window + 1)
                    s = np.unique(seed[a:b]) if b > a else seed[:0]
                    h = np.sort(whole[a:b])
                    inner.append(bool((h[1:] == h[:-1]).any()))
                    own.append(s)
                    at.append(at[-1] + len(s))
                flat = common.signed(np.concatenate([*own, np.zeros(0, np.uint64)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(np.diff(w.at), pa.int64()), pa.array(sha), ka, kb, pa.array(inner), common.lists(flat, np.array(at), pa.int64())],
                    names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """Every column plus the two numbers of the text's digest."""
    schema = T.StructType([*docs.schema.fields, T.StructField("ka", T.LongType()), T.StructField("kb", T.LongType())])

    def run(batches):
        common.let_go()
        for batch in batches:
            _, ka, kb = _digests(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, ka, kb], names=schema.names)

    return docs.mapInArrow(run, schema)


def _list(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    """A list column's rows as arrays; a null is an empty one."""
    col = batch.column(column)
    off, values = np.asarray(col.offsets), col.values.to_numpy(zero_copy_only=False).view(np.uint64)
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    return [values[off[i]:off[i + 1]] if valid[i] else values[:0] for i in range(len(col))]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(profiles, verdicts): the profile of each row, and for each distinct text ``ka``,
    ``kb``, ``first_id`` (its first document) and, where words go in that document,
    ``spans`` (removed ranges of words, maximal), n_removed and kept_sha."""
    facts = common.stage(profiles(docs, key, text, window), "profiles")
    texts = facts.groupBy("ka", "kb").agg(
        F.min(key).alias("first_id"), F.max("n_words").alias("n"), F.max("inner").alias("inner"))
    # A global order of distinct texts; written, so that the numbers stay what they are.
    texts = common.stage(texts.orderBy(F.col("first_id").asc_nulls_last(), "ka", "kb").withColumn("ord", F.monotonically_increasing_id()), "texts")

    at = facts.select("ka", F.explode("seeds").alias("seed"))
    shared = at.groupBy("seed").agg(F.min("ka").alias("lo"), F.max("ka").alias("hi")).where("lo < hi").select("seed")
    marked = at.join(shared, "seed", "left_semi").groupBy("ka").agg(F.collect_set("seed").alias("seeds"))
    work = texts.join(marked, "ka", "left").where("inner OR seeds IS NOT NULL").select("ka", "kb", "first_id", "ord", "seeds")
    work = common.stage(work, "work")

    rows = _keyed(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_text")
    met = rows.alias("d").join(work.alias("w"), (F.col("d.ka") == F.col("w.ka")) & (F.col("d.kb") == F.col("w.kb")) & F.col("_id").eqNullSafe(F.col("first_id"))).select(
        "ord", F.col("_text").alias("text"), "seeds")

    def extend(batches):
        common.let_go()
        for batch in batches:
            for part in common.blocks(batch, "text"):
                w = common.words(part.column("text"))
                _, seed, whole = seeds_and_windows(w, window)
                out, sizes = [], []
                for d, (own, marks) in enumerate(zip(range(part.num_rows), _list(part, "seeds"))):
                    a, b = w.at[d], max(w.at[d], w.at[d + 1] - window + 1)
                    hit = np.unique(whole[a:b][np.isin(seed[a:b], marks)]) if len(marks) else whole[:0]
                    out.append(hit)
                    sizes.append(len(hit))
                flat = common.signed(np.concatenate([*out, np.zeros(0, np.uint64)]))
                yield pa.RecordBatch.from_arrays([pa.array(flat), part.column("ord").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))], names=["h", "ord"])

    first = (met.mapInArrow(extend, "h long, ord long").groupBy("h").agg(F.min("ord").alias("ord"))
             .groupBy("ord").agg(F.collect_list("h").alias("own")))
    both = met.join(first, "ord", "left")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("ord", T.LongType()), T.StructField("spans", span), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha", T.StringType())])

    def judge(batches):
        common.let_go()
        for batch in batches:
            for part in common.blocks(batch, "text"):
                w = common.words(part.column("text"))
                _, seed, whole = seeds_and_windows(w, window)
                spans, removed, sha = [], [], []
                for d, (marks, own) in enumerate(zip(_list(part, "seeds"), _list(part, "own"))):
                    n = int(w.at[d + 1] - w.at[d])
                    a, b = w.at[d], max(w.at[d], w.at[d + 1] - window + 1)
                    h = whole[a:b]
                    later = np.ones(len(h), bool)  # not the first such window of its own text
                    later[np.unique(h, return_index=True)[1]] = False
                    gone = later | (np.isin(seed[a:b], marks) & ~np.isin(h, own))
                    edge = np.zeros(n + 1, np.int64)
                    p = np.flatnonzero(gone)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + window, -1)
                    cover = np.concatenate([[0], np.cumsum(edge)[:n] > 0, [0]]).astype(np.int8)
                    turn = np.flatnonzero(np.diff(cover))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2])])
                    removed.append(int((turn[1::2] - turn[::2]).sum()))
                    keep = np.flatnonzero(cover[1:-1] == 0) + a
                    sha.append(hashlib.sha256(b" ".join(w.bytes_of(i) for i in keep)).hexdigest() if removed[-1] else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("ord"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                    names=schema.names).filter(pa.array([x > 0 for x in removed]))

    found = both.mapInArrow(judge, schema).dropDuplicates(["ord"])
    return facts, common.stage(texts.join(found, "ord", "left").drop("inner", "ord"), "verdicts")


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, kept_sha256.

    Null or empty text: no words, the digest of nothing. A later copy of a text with a
    window loses all its words. Texts below ``window`` words are left alone.
    """
    facts, verdicts = repeats(docs, key, text, window)
    copy = F.col("first_id").isNotNull() & ~F.col("f." + key).eqNullSafe(F.col("first_id")) & (F.col("n_words") >= window)
    return (facts.drop("seeds").alias("f").join(verdicts.alias("v"), ["ka", "kb"], "left").select(
        F.col("f." + key), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256")))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words cut out of the texts, white space around the rest as
    it was; a text that loses all its words goes."""
    _, verdicts = repeats(docs, key, text, window)
    schema = docs.schema
    rows = _keyed(docs, text).join(verdicts.select(F.col("ka").alias("_ka"), F.col("kb").alias("_kb"), "first_id", "n", "spans"),
                                   (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb")), "left")
    copy = F.col("first_id").isNotNull() & ~F.col(key).eqNullSafe(F.col("first_id")) & (F.col("n") >= window)
    rows = rows.where(~copy).select(*docs.columns, F.col("spans").alias("_spans"))

    def cut(batches):
        common.let_go()
        for batch in batches:
            for part in common.blocks(batch, text):
                w = common.words(part.column(text))
                texts, keep = [], []
                lead = np.concatenate([[0], np.cumsum([len(t or b"") for t in part.column(text).cast(pa.large_binary()).to_pylist()])])
                for d, (t, spans) in enumerate(zip(part.column(text).to_pylist(), part.column("_spans").to_pylist())):
                    left = True
                    if spans:
                        out, at = [], int(lead[d])
                        for x in spans:
                            out.append(w.raw[at:w.start[w.at[d] + x["start"]]].tobytes())
                            at = int(w.end[w.at[d] + x["end"] - 1])
                        t = b"".join([*out, w.raw[at:lead[d + 1]].tobytes()]).decode()
                        left = bool(t.strip())
                    texts.append(t)
                    keep.append(left)
                cols = {text: pa.array(texts, part.schema.field(text).type)}
                yield pa.RecordBatch.from_arrays([cols.get(c, part.column(c)) for c in schema.names], schema=pa.schema(
                    [part.schema.field(c) for c in schema.names])).filter(pa.array(keep))

    return rows.mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
