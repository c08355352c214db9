"""Exact copies, conversation trie and resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spoor.llm import bits, copies, resampling, trie

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def frame(spark, rows, schema, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# ---- copies ------------------------------------------------------------------------

TEXTS = [(1, "Hello"), (2, "hello"), (3, "héllo"), (4, "HÉLLO"), (5, None), (6, ""), (7, "a b"), (7, "A b"), (7, "a b"), (None, "hello"), (None, "alone"),
         (None, "alone"), (8, "x" * 200_000), (9, "X" * 200_000), (10, "own"), (11, None)] + [(100 + i, "hot") for i in range(60)]


def plain_copies(rows, best):
    groups = defaultdict(list)
    for key, text in rows:
        groups[(text or "").translate(LOW)].append(key)
    out = []
    for text, keys in groups.items():
        keep = best((k for k in keys if k is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        spare = keys.count(keep) - 1  # rows of the id that stays which go
        for k in keys:
            stays = k == keep and spare <= 0
            spare -= k == keep
            out.append((k, keep, len(keys), stays, sha))
    return Counter(out)


def marked(df):
    return Counter((r.id, r.keep_id, r.group_size, r.kept, bytes(r.sha).hex()) for r in df.collect())


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("digest", [copies.digest_128, lambda raw: F.substring(raw, 1, 1)])
def test_copies_agree_with_plain_version(spark, keep, best, digest):
    docs = frame(spark, TEXTS, "doc_id long, text string")
    assert marked(copies.mark(docs, keep=keep, digest=digest)) == plain_copies(TEXTS, best)


def test_clean_keeps_one_row_of_each_text_and_any_columns(spark):
    names = ["id", "sha", "one", "n", "kept", "row", "digest", "raw", "bucket", "map", "_sha", "keep_id", "keep_row"]
    docs = frame(spark, TEXTS, "doc_id long, text string").select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in names])
    got = copies.clean(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    want = [(k, (t or "").translate(LOW)) for k, t in dict.fromkeys(TEXTS)]
    texts = Counter((r.text or "").translate(LOW) for r in rows)
    assert set(texts) == {t for _, t in want} and set(texts.values()) == {1}
    assert {r.doc_id for r in rows if (r.text or "").translate(LOW) in ("hello", "hot", "a b")} == {1, 100, 7}
    assert all(r[c] == f"own {c}" for r in rows for c in names)


def test_copies_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert copies.mark(docs).count() == 0 and copies.clean(docs).count() == 0


def test_filter_lets_all_of_its_keys_through(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).alias("bucket"), F.lit(2).alias("map"))
    held = rows.where("k % 40 = 0")
    got = bits.passing(rows, "k", bits.maps(held, "k", 8), 8)
    assert got.columns == rows.columns
    passed = {r.k for r in got.collect()}
    assert {k for k in range(20_000) if k % 40 == 0} <= passed and len(passed) < 700


# ---- trie ----------------------------------------------------------------------------

def rebuilt(rows, heads):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            convs[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    convs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    if not heads:
        return convs
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    return {c: convs.get(c - int(math.fmod(c, 5)), [])[:h[c]] + v[h[c]:] for c, v in convs.items()}


def plain_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, who in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(who) - 1) * len(n[-1][1].encode()) if n else 0
    sha = lambda n: hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()
    return sorted((m[0], len(n), members[n[:-1]][0] if n else -1, len(m), kids[n], leaves[n], saved[n], sha(n)) for n, m in members.items())


def got_trie(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed=3):
    rng = np.random.default_rng(seed)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", None), (7, 0, None, "é" * 9), (7, 0, None, "é" * 9)]
    for c in range(40, 90):
        rows += [(c, t, ["user", "assistant"][t % 2], f"w{rng.integers(0, 2)}") for t in range(rng.integers(1, 7))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 130) for t in range(5)]  # copies
    rows += [(c, t, "user", f"long {t}") for c in (200, 201) for t in range(23)]
    rows += [(202, t, "user", f"long {t}" if t < 11 else f"other {t}") for t in range(31)]
    rows += [(300, t, "user", "") for t in range(2)] + [(303, t, "user", "x") for t in range(3)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("cells,piece", [(None, trie.PIECE), (1 << 15, 4), (1 << 16, 1)])
def test_trie_agrees_with_plain_version(spark, cells, piece):
    rows = conversations()
    turns = trie.ordered(frame(spark, rows, SCHEMA))
    assert got_trie(trie.trie(*trie.headed(turns), cells=cells, piece=piece)) == plain_trie(rebuilt(rows, True))
    assert got_trie(trie.trie(*trie.plain(turns), cells=cells, piece=piece)) == plain_trie(rebuilt(rows, False))


def test_trie_is_right_when_the_sketch_proves_little(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 8)
    rows = conversations(5)
    turns = trie.ordered(frame(spark, rows, SCHEMA))
    for cells in (8, 64):
        assert got_trie(trie.trie(*trie.headed(turns), cells=cells, piece=3)) == plain_trie(rebuilt(rows, True))


def test_trie_of_nothing_and_of_empty_conversations(spark):
    assert trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = frame(spark, [(c, 0, "user", "x") for c in (1, 2) if zlib.crc32(str(c).encode()) % 9], SCHEMA, 1)
    assert got_trie(trie.trie(*trie.headed(trie.ordered(alone)))) == plain_trie(rebuilt([tuple(r) for r in alone.collect()], True))


# ---- resampling ------------------------------------------------------------------------

def words(text):
    return PLAIN.findall((text or "").translate(LOW))


def features(text, run):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def plain_draw(docs, target, run, buckets, few, percent, seed="2024"):
    s, t = (Counter(f % buckets for x in texts for f in features(x, run)) for texts in ([x for _, x in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)}
    rows = []
    for key, x in docs:
        f = features(x, run)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[v % buckets] for v in f)
        rows.append([key, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= few), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[:len(able) * percent // 100]):
        r.append(rank + 1)
    return Counter(tuple(r) if len(r) == 6 else (*r, None) for r in rows)


def some_texts():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "été", "A1", "x" * 90]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, "some Words, here!"), (502, "\x00a\x7fb-c\n\td"), (503, "long " * 50_000), (3, docs[3][1]), (3, docs[3][1])]
    return docs, [" ".join(rng.choice(vocabulary[:40], 30)) for _ in range(9)] + [None]


@pytest.mark.parametrize("run,buckets,few,percent", [(1, 10_000, 20, 10), (3, 97, 5, 50), (2, 1000, 0, 100)])
def test_draw_agrees_with_plain_version(spark, run, buckets, few, percent):
    docs, target = some_texts()
    got = resampling.draw(frame(spark, docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("bucket", F.lit(1)),
                          frame(spark, [(t,) for t in target], "text string"), run=run, buckets=buckets, few_words=few, percent=percent)
    assert Counter((r.id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got.collect()) == plain_draw(docs, target, run, buckets, few, percent)


def test_draw_with_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.draw(none, none).count() == 0
    docs = [(i, "only these words " * 10) for i in range(30)]
    got = resampling.draw(frame(spark, docs, "doc_id long, text string"), none)
    assert Counter((r.id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got.collect()) == plain_draw(docs, [], 1, 10_000, 20, 10)


def test_composed_crc_is_that_of_the_joined_text():
    one, two = [b"", b"a", b"hello", "é".encode() * 300], [b"x", b" world", b"", b"\x00" * 1000]
    crc = lambda texts: np.array([zlib.crc32(t) for t in texts], np.uint64)
    got = resampling.composed(crc(one), crc(two), np.array([len(t) for t in two]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(one, two)]


def test_dictionary_bounds_change_nothing(monkeypatch):
    from spoor.llm import common
    docs, _ = some_texts()
    texts = pa.array([x for _, x in docs])
    want = [sorted(f % 50 for f in features(x, 2)) for _, x in docs]
    for entries, longest in ((1 << 16, 40), (70, 3), (0, 40)):
        monkeypatch.setattr(resampling, "ENTRIES", entries)
        monkeypatch.setattr(resampling, "LONGEST", longest)
        common.remembered.pop("dictionary", None)
        for _ in range(3):  # the later scans meet a learned dictionary
            value, at, _ = resampling.scanned(texts, 2, 50)
            assert [sorted(value[a:b].tolist()) for a, b in zip(at, at[1:])] == want
