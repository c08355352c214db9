"""Packing documents into sequences by minimum bin slack.

A document's ids are cut into full windows and a rest. Full windows are sequences of
their own. Rests are dealt evenly over tasks; each task fills one sequence after another:
the longest rest left goes in, then a subset-sum over the lengths left, one bit per
reachable total, finds the multiset that fills the window closest to capacity, and the
counts per length are read back from the totals before each step.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spoor.llm import common, tokens

CAPACITY, END = 4096, 2
#: Pieces that one task packs; more pieces mean more tasks.
GROUP = 20_000


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per window of each document: key, start, length, ids_crc32, doc_tokens.
    A null text is an empty one, whose only id is the end."""
    schema = T.StructType([docs.schema[key], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]])

    def run(batches):
        common.let_go(path)  # what the encoder knows stays
        enc = tokens.encoder(path)
        for batch in batches:
            for part in common.blocks(batch, text, 4 * common.BLOCK_BYTES):
                ids, at = enc.encode(part.column(text))
                rows, cols = [], ([], [], [], [])
                for d in range(part.num_rows):
                    own = np.append(ids[at[d]:at[d + 1]], np.uint32(end)).astype("<u4")
                    for s in range(0, len(own), capacity):
                        piece = own[s:s + capacity]
                        rows.append(d)
                        for c, v in zip(cols, (s, len(piece), zlib.crc32(piece.tobytes()), len(own))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]],
                                                 names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def fill(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """Counts per length whose total comes closest to ``capacity`` from below."""
    reached, steps = 1, []
    mask, full = (1 << (capacity + 1)) - 1, 1 << capacity
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left:
            take = min(take, left)
            steps.append((reached, length, take))
            reached |= (reached << (length * take)) & mask
            left -= take
            take *= 2
        if reached & full:
            break
    total, used = reached.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(steps):
        if total and not before >> total & 1:
            used[length] += take
            total -= length * take
    return used


def sequences(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Places of ``lengths`` (each at most ``capacity``) in order of sequences."""
    stacks: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        stacks[lengths[i]].append(i)
    counts = {x: len(s) for x, s in stacks.items()}
    out = []

    def take(length: int, n: int) -> list[int]:
        counts[length] -= n
        if not counts[length]:
            del counts[length]
        return [stacks[length].pop() for _ in range(n)]

    while counts:
        longest = max(counts)
        row = take(longest, 1)
        if longest < capacity:
            for length, n in fill(capacity - longest, counts).items():
                row += take(length, n)
        out.append(row)
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``cut`` (rows with ``length`` from 1 to ``capacity``) plus sequence_id and offset.

    Rows are dealt evenly and without a key, so no task gets more however keys repeat.
    A sequence belongs to one task; at the end of each task some may stay short.
    """
    groups = max(1, -(-cut.count() // group))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        common.let_go()
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        whole = pa.Table.from_batches(rows).combine_chunks()
        lengths = whole.column("length").to_pylist()
        order, ids, offsets = [], [], []
        base = TaskContext.get().partitionId() << 32
        for k, places in enumerate(sequences(lengths, capacity)):
            at = 0
            for i in places:
                order.append(i)
                ids.append(base + k)
                offsets.append(at)
                at += lengths[i]
        out = whole.take(pa.array(order)).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    return cut.repartition(groups).mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, **kw) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Null keys and repeated rows are packed like others; an empty table gives no rows.
    """
    return pack(common.stage(pieces(docs, path, **kw), "pieces"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"), tokenizer_path())
