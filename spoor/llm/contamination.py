"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items' words are numbered and every item is added to one automaton, built anew from its
start state. Documents are streamed through it: at each word the automaton gives the
longest run of words ending there that occurs in some item. A run of ``WINDOW`` words or
more, or a whole shorter item, is a hit; hit spans longer than a limit are cut out, and
documents covered beyond a limit go.

Items are taken in blocks of at most ``BLOCK_WORDS`` words; documents are streamed
against one block at a time, so an automaton's size is bounded whatever the number of
items, and one block is all that is broadcast. Before the automaton steps word by word, whole
batches are cut down to runs of words whose neighbouring pairs all occur in the block.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import common

WINDOW = 10
BLOCK_WORDS = 200_000


class Automaton:
    """Suffix automaton over word numbers of several items."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        hashes = [common.words(pa.array([b" ".join(w)], pa.binary()), common.PLAIN).hash for _, w in items]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        texts = [np.searchsorted(self.vocabulary, h).tolist() for h in hashes]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: State of each short item's whole text, and the items that hold a state's words.
        self.short: dict[int, set[str]] = defaultdict(set)
        self.holders: list[set[str]] = [set()]
        ends: list[tuple[int, str]] = []
        for (item, _), text in zip(items, texts):
            last = 0
            for w in text:
                last = self._add(last, w)
                ends.append((last, item))
        self.holders = [set() for _ in self.next]
        for state, item in ends:  # an item holds all that its prefixes' suffixes hold
            while state > 0 and item not in self.holders[state]:
                self.holders[state].add(item)
                state = self.link[state]
        for (item, _), text in zip(items, texts):
            if 0 < len(text) < WINDOW:
                state = 0
                for w in text:
                    state = self.next[state][w]
                self.short[state].add(item)
        lengths = [len(t) for t in texts if t]
        #: No hit is shorter than this.
        self.least = min(WINDOW, min(lengths, default=WINDOW))
        pairs = [np.array(t[:-1]) * len(self.vocabulary) + np.array(t[1:]) for t in texts if len(t) > 1]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]).astype(np.int64))

    def _add(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # an earlier item has this already
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q)
        at = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = at
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[at] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return at

    def _split(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def runs(self, ids: list[int]):
        """(end, length, items) of each hit in a run of known words: at every end the
        longest run if it has ``WINDOW`` words, and whole short items."""
        state = length = 0
        nxt, link, size = self.next, self.link, self.length
        for i, w in enumerate(ids):
            while state and w not in nxt[state]:
                state = link[state]
                length = size[state]
            if w in nxt[state]:
                state, length = nxt[state][w], length + 1
            if length < self.least:
                continue
            found, reach, s = set(), 0, state
            if length >= WINDOW:
                reach = length
                while link[s] > 0 and size[link[s]] >= WINDOW:
                    s = link[s]
                found |= self.holders[s]
                s = link[s]
            while self.short and s > 0:
                if s in self.short and size[s] <= length:
                    found |= self.short[s]
                    reach = max(reach, size[s])
                s = link[s]
            if reach:
                yield i + 1, reach, found


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> int:
    """Number of blocks that keep a block near ``block_words`` words."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-int(total) // (4 * block_words)))


def _item_words(text: str | None) -> list[bytes]:
    w = common.words(pa.array([text], pa.string()), common.PLAIN, lower=True)
    return [w.bytes_of(i) for i in range(len(w.start))]


def matches(docs: DataFrame, items: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every column of ``docs`` plus n_words, ``spans`` (hit ranges of words, start and
    end, merged) and ``items`` (ids as text, sorted) by one or several passes over blocks.

    Null texts and items have no words; items without words never match. Items with one
    id count once. Repeated documents each get their row.
    """
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    blocks = item_blocks(items, block_words)
    out = docs.withColumns({"n_words": F.lit(0).cast("bigint"), "spans": F.lit(None).cast("array<struct<start:int,end:int>>"),
                            "items": F.array().cast("array<string>")})
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        model = docs.sparkSession.sparkContext.broadcast(
            Automaton([(r.item_id, _item_words(r.text)) for r in sorted(rows, key=lambda r: (r.item_id, r.text or ""))]))
        out = out.mapInArrow(_stream(model, text), out.schema)
    return out


def _stream(model, text):
    def run(batches):
        common.let_go()
        for batch in batches:
            for part in common.blocks(batch, text):
                yield _hits(part, text, model.value)

    return run


def _hits(batch: pa.RecordBatch, text: str, a: Automaton) -> pa.RecordBatch:
    w = common.words(batch.column(text), common.PLAIN, lower=True)
    n = np.diff(w.at)
    doc = w.doc()
    vocabulary = a.vocabulary
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    found: dict[int, set[str]] = defaultdict(set)
    for d, (old, kept) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
        if old:
            spans[d], found[d] = [(x["start"], x["end"]) for x in old], set(kept)
    if len(vocabulary) and len(w.hash):
        ids = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
        known = vocabulary[ids] == w.hash
        # A run goes on while neighbours are in one text, known, and a pair of the block.
        pair = ids[:-1].astype(np.int64) * len(vocabulary) + ids[1:]
        at = np.minimum(np.searchsorted(a.pairs, pair), max(0, len(a.pairs) - 1))
        joined = known[:-1] & known[1:] & (doc[:-1] == doc[1:]) & ((a.pairs[at] == pair) if len(a.pairs) else False)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2] + 1
        if a.least == 1:  # single words count too
            lone = np.flatnonzero(known)
            lone = lone[~np.concatenate([joined, [False]])[lone] & ~np.concatenate([[False], joined])[lone]]
            starts, ends = np.concatenate([starts, lone]), np.concatenate([ends, lone + 1])
        for s, e in zip(starts, ends):
            if e - s < a.least:
                continue
            d = int(doc[s])
            base = int(s - w.at[d])
            for end, length, held in a.runs(ids[s:e].tolist()):
                spans[d].append((base + end - length, base + end))
                found[d] |= held
    merged, texts, at = [], [], [0]
    for d in range(len(n)):
        last = None
        for s, e in sorted(spans.get(d, ())):
            if last and s <= last["end"]:
                last["end"] = max(last["end"], e)
            else:
                last = {"start": s, "end": e}
                merged.append(last)
        at.append(len(merged))
        texts.append(sorted(found.get(d, ())))
    kinds = {f.name: f.type for f in batch.schema}
    values = pa.array(merged, pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    cols = {"n_words": pa.array(n.astype(np.int64)), "spans": pa.ListArray.from_arrays(pa.array(at, pa.int32()), values),
            "items": pa.array(texts, pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([cols[c].cast(kinds[c]) if c in cols else batch.column(c) for c in batch.schema.names], schema=batch.schema)


def clean(docs: DataFrame, items: DataFrame, span_limit: int = 1, coverage_limit: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without hit spans of ``span_limit`` words or more and without documents of
    which more than ``coverage_limit`` of the words are hit.

    Bytes from a span's first word to its last one's end are cut; all else stays as it
    was. A text without hits is unchanged, a null text stays null.
    """
    schema = docs.schema

    def cut(batches):
        common.let_go()
        for batch in batches:
            for part in common.blocks(batch, text):
                w = common.words(part.column(text), common.PLAIN, lower=True)
                raws, keep = [], []
                begin = np.concatenate([[0], np.cumsum([len(t or b"") for t in part.column(text).cast(pa.large_binary()).to_pylist()])])
                for d, (t, spans) in enumerate(zip(part.column(text).to_pylist(), part.column("spans").to_pylist())):
                    spans = spans or []
                    hit, n = sum(x["end"] - x["start"] for x in spans), int(w.at[d + 1] - w.at[d])
                    spans = [x for x in spans if x["end"] - x["start"] >= span_limit]
                    keep.append(hit <= coverage_limit * n)
                    if spans:
                        raw, at, out = t.encode(), 0, []
                        base = int(begin[d])
                        for x in spans:
                            s, e = int(w.start[w.at[d] + x["start"]]) - base, int(w.end[w.at[d] + x["end"] - 1]) - base
                            out.append(raw[at:s])
                            at = e
                        t = b"".join([*out, raw[at:]]).decode()
                    raws.append(t)
                cols = {text: pa.array(raws, part.schema.field(text).type)}
                yield pa.RecordBatch.from_arrays([cols.get(c, part.column(c)) for c in schema.names], schema=pa.schema(
                    [part.schema.field(c) for c in schema.names])).filter(pa.array(keep))

    return matches(docs, items, text).mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("bigint")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
