"""The text operators against plain versions on small tables with odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm import (common, contamination, grades, graph, languages, licenses, packing, quality_rules, sharding,
                       similar, substrings, tokens, toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long"
LABELS = "doc_id long, quality int, toxic int"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(common.UPPER, common.LOWER)


def spaced(t):
    return SPACED.findall(t or "")


def plain(t):
    return PLAIN.findall((t or "").translate(LOWER))


def prose(seed, n, size=400):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, size, n)]


def texts():
    base = prose(1, 120, 100_000)
    out = [" ".join(base), " ".join(base), None, "", " \n\t ", "one two", "one  two", " ".join(base[:60]), "Über  straße\x0bnaïve 日本 \U0001F600 x"]
    for i in range(12):  # near copies by one changed word
        w = list(base)
        w[5 + 9 * i] = f"changed{i}"
        out.append(" ".join(w))
    passage = prose(2, 55, 100_000)
    for i in range(12):  # a passage in otherwise different texts
        out.append(" ".join([*prose(100 + i, 40, 100_000), *passage, *prose(200 + i, 300, 100_000)]))
    out.append(" ".join(["spam spam eggs"] * 700))
    out.append("\n".join(["same line here now ok"] * 30 + ["other $$$ ### line"]))
    out.append(" ".join(prose(9, 30_000, 5_000)))  # very long
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts())]
    rows += [rows[0], (None, "no id here", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [r.asDict() for r in df.collect()]


# ---- words ----------------------------------------------------------------------

def test_words_are_those_of_the_regex():
    t = [*texts(), "A\x00b", "Ünïcode ẞ", "\x7fa_b", "x" * 5000]
    arr = pa.array(t, pa.string())
    for sep, lower, find in ((common.SPACED, False, spaced), (common.PLAIN, True, plain)):
        w = common.words(arr, sep, lower)
        got = [[w.bytes_of(i).decode() for i in range(w.at[d], w.at[d + 1])] for d in range(len(t))]
        assert got == [find(x) for x in t]
        by = defaultdict(set)
        for i, h in enumerate(w.hash.tolist()):
            by[w.bytes_of(i)].add(h)
        assert all(len(v) == 1 for v in by.values()) and len(set(w.hash.tolist())) == len(by)
    sliced = common.words(arr[3:7])
    assert np.diff(sliced.at).tolist() == [len(spaced(x)) for x in t[3:7]]


# ---- 1 licenses -----------------------------------------------------------------

def test_license_scan(spark, empty):
    cases = ["Under the MIT  License.", "the apache-license and the GNU General Public License, version 3",
             "SPDX-License-Identifier: BSD-3-Clause", "permission slip", None, "", "mit license " * 3000,
             "licensed under the GNU Lesser General Public License"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id long, text string, scan string").drop("scan")
    got = [r["scan"] for r in collected(licenses.scan(df))]
    assert [g["labels"] for g in got][:3] == ["mit", "apache,gpl,gpl-3.0", "bsd-3-clause"]
    assert got[3]["labels"] == "" and got[3]["first_word"] is None and got[4]["n_words"] == got[5]["n_words"] == 0
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"]) == (3000, 0, 5998)
    assert got[7]["base_labels"] == "gpl" and got[7]["labels"] == "gpl,lgpl" and got[2]["score"] == 1.0
    assert len(licenses.rules()) > 300
    assert licenses.scan(empty).count() == 0


def test_license_words(docs):
    for r in collected(licenses.scan(docs)):
        assert r["scan"]["n_words"] == len(plain(r["text"]))


# ---- 2 quality rules ------------------------------------------------------------

def test_measures(docs):
    for r in collected(quality_rules.measured(docs.withColumn("t", F.col("text")))):
        w = spaced(r["t"])
        win = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if win[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (r["t"] or "").split("\n") if SPACED.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit))
        assert (r["n_dup_lines"], r["n_lines"]) == (len(lines) - len(set(lines)), len(lines))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["t"] or ""))


def test_binomial_tail(spark):
    from math import comb

    cases = [(10, 0, .1), (50, 3, .2), (400, 1, .0125), (2000, 12, .01), (2000, 30, .01)]
    for n, k, p in cases:
        want = sum(comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
        assert got == pytest.approx(1.0 if k >= n * p else want, rel=1e-9)


def test_thresholds_hold_back_and_cut(spark, docs, empty):
    good = [("en", 1, [0, 0, 0, 5])] * 3000 + [("en", 1, [60, 0, 0, 5])] * 2
    bad = [("en", 0, [60, 0, 0, 5])] * 300 + [("xx", 0, [90, 0, 0, 5])] * 5
    df = spark.createDataFrame(good + bad, "s string, good int, values array<int>")
    got = {r.s: r.cutoffs for r in quality_rules.thresholds(df, "s").collect()}
    assert got == {"en": [60, None, None, None]}
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 1), (3, None, None)], LABELS)
    out = quality_rules.judge(docs, labels)
    assert out.count() == docs.count() and quality_rules.judge(empty, labels).count() == 0
    assert out.where("base_failed AND kept").count() == 0


# ---- 3 substrings ---------------------------------------------------------------

def brute_removed(rows, window=20):
    order = sorted({(i is None, i or 0, hashlib.sha256(" ".join(spaced(t)).encode()).digest()[:16], " ".join(spaced(t))) for i, t in rows})
    seen, out = set(), {}
    for null, i, _, text in order:
        w, gone = text.split(" ") if text else [], set()
        mine = [" ".join(w[p:p + window]) for p in range(len(w) - window + 1)]
        for p, x in enumerate(mine):
            if x in seen:
                gone |= set(range(p, p + window))
            seen.add(x)
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[None if null else i, text] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substrings(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_removed(rows)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs).collect())
    assert got == Counter((i, *want[i, " ".join(spaced(t))]) for i, t in rows)
    assert substrings.removed(empty).count() == 0
    cleaned = substrings.clean(docs)
    assert cleaned.columns == docs.columns
    for r in cleaned.collect():
        assert hashlib.sha256(" ".join(spaced(r.text)).encode()).hexdigest() in {v[2] for (i, _), v in want.items() if i == r.doc_id}


# ---- 5 similar ------------------------------------------------------------------

def brute_classes(rows):
    sets = []
    for i, t in rows:
        w = spaced(t)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("long,rounds", [(32, 4), (2, 4), (2, 1)])
def test_similar(docs, long, rounds):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter(tuple(r) for r in similar.classes(docs, long=long, rounds=rounds).collect())
    assert got == brute_classes(rows)


def test_similar_with_lists_counted_apart_and_split(docs, monkeypatch):
    for name, value in (("SEEN", 1), ("EACH", 1), ("SPLIT", 2), ("HEAVY", 50)):
        monkeypatch.setattr(similar, name, value)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in similar.classes(docs, long=2, rounds=2).collect()) == brute_classes(rows)


def test_similar_odd_tables(docs, empty):
    assert similar.classes(empty).count() == 0
    kept = similar.keep_one(docs)
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({c for i, n, c in want if i is not None and n} | {i for i, n, c in want if i is not None and not n})
    assert kept.columns == docs.columns


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in pairs if a != b for n in (a, b)}


# ---- 4, 6, 9 fitted models ------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(1200):
        lang = ("en", "zz")[i % 2]
        w = [("the", "qux")[i % 2] + str(x) for x in rng.integers(0, 300, 40)]
        toxic, junk = i % 7 == 0, i % 5 == 0
        if toxic:
            w[::8] = [("vile", "nasty")[i % 2]] * 5
        if junk:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w), lang, "s", 1, 1))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], LABELS)


def test_toxicity(spark, labelled, empty):
    docs, labels = labelled
    odd = spark.createDataFrame([(9001, None, None, None, None, None), (9002, "", None, None, None, None), (None, "vile vile", None, None, None, None)], SCHEMA)
    got = toxicity.score(docs.union(odd), labels).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", "left").toPandas()
    held = got[got.held_out & got.toxic.notna()]
    assert len(got) == 1203 and (held.predicted == held.toxic).mean() > 0.97
    assert got.score.between(0, 1).all() and (got.held_out == [zlib.crc32(("" if i != i else str(int(i))).encode()) % 4 == 2 for i in got.doc_id]).all()
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and 980 < kept.count() < 1060
    assert toxicity.score(empty, labels).count() == 0


def test_discounts_leave_what_a_class_really_has():
    empty = {"key": np.zeros(0, np.int64)}
    word = {"key": np.array([1, 2]), "toxic": np.array([50, 100]), "ordinary": np.array([0, 1000])}
    m = toxicity.build(word, empty, {"key": np.array([1, 2]), "n": np.array([1, 9])}, empty)
    ratio = np.log(m.word_p[0] / m.word_p[1])
    assert ratio[1] > 1 and abs(ratio[2]) < 0.7 and m.word_p.sum(axis=1) == pytest.approx([1, 1])


def test_grades(labelled, empty):
    docs, labels = labelled
    graded = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 0, 0).otherwise(2 - F.col("toxic")).alias("grade"))
    got = grades.score(docs, graded, 3).join(graded, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.expected_grade.round()) == held.grade).mean() > 0.9
    tails = np.stack(got.tails.tolist())
    assert (tails[:, 0] >= tails[:, 1]).all() and np.allclose(tails.sum(axis=1), got.expected_grade)
    assert grades.score(empty, graded.limit(0), 3).count() == 0


def test_languages(spark, labelled, empty):
    docs, _ = labelled
    odd = spark.createDataFrame([(9001, None, "en", None, None, None), (9002, "12 34 !?", "en", None, None, None), (None, "qux1 qux2 qux3", None, None, None, None)], SCHEMA)
    got = languages.identify(docs.union(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert len(got) == 1203 and (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    assert set(got[got.doc_id.isin([9001, 9002])].lang_pred) == {"und"}
    assert languages.identify(empty).count() == 0


# ---- 7 packing ------------------------------------------------------------------

def test_every_language_and_every_place_is_learned_from(spark):
    rows = [(i, "common words of everyday ", "aa") for i in range(400)] + [(1000 + k, f"rare text number {k}", f"l{k:03d}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows, labels, names = languages.sample(df, "doc_id", "lang", "text", 100)
    assert names == sorted({r[2] for r in rows}) and len(windows) == len(labels)
    assert set(labels) == set(range(301))  # each of the 300 rare ones, too
    assert 40 <= (labels == 0).sum() <= 200
    text = "a" * 70_000 + "b" * 200_000
    df = spark.createDataFrame([(i, text, "aa") for i in range(40)], "doc_id long, text string, lang string")
    windows, _, _ = languages.sample(df, "doc_id", "lang", "text", 1000)
    assert (windows == ord("b")).all(axis=1).sum() > (windows == ord("a")).all(axis=1).sum() > 0


def test_fill_and_sequences():
    rng = np.random.default_rng(2)
    for _ in range(40):
        cap = int(rng.integers(5, 60))
        items = rng.integers(1, 40, 8).tolist()
        best = max(s for s in (sum(x for k, x in enumerate(items) if m >> k & 1) for m in range(256)) if s <= cap)
        used = packing.fill(cap, Counter(items))
        assert sum(k * v for k, v in used.items()) == best and all(v <= Counter(items)[k] for k, v in used.items())
    lengths = rng.integers(1, 4096, 600).tolist()
    seqs = packing.sequences(lengths)
    assert sorted(i for s in seqs for i in s) == list(range(600)) and all(sum(lengths[i] for i in s) <= 4096 for s in seqs)
    assert len(seqs) <= sum(lengths) / 4096 * 1.02 + 1


def test_packing_round_trip(spark, docs, empty):
    path = packing.tokenizer_path()
    whole = tokens.Encoder(path).whole
    special = spark.createDataFrame([(500, "a <|endoftext|> b 's it's don't 12 ÉCOLE ﬁ Σίσυφος", "x", "x", 1, 1)], SCHEMA)
    all_docs = docs.union(special)
    got = packing.packed(all_docs, path).toPandas()
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in {(r.doc_id, r.text) for r in all_docs.collect()} if i is not None}
    for i, own in ids.items():
        mine = got[got.doc_id == i].drop_duplicates("start").sort_values("start")
        assert mine.length.sum() == len(own) == mine.doc_tokens.iloc[0]
        for r in mine.itertuples():
            assert zlib.crc32(own[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    assert packing.packed(empty, path).count() == 0


# ---- 8 sharding -----------------------------------------------------------------

def test_sharding(spark, docs, empty):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.assign(many).toPandas()
    assert ((got.shard == got.grown_shard) | (got.grown_shard == 16)).all() and 0.03 < (got.grown_shard == 16).mean() < 0.09
    assert got.shard.value_counts().between(230, 400).all()
    for frame in (got, sharding.assign(docs).toPandas()):
        for _, s in frame.groupby("shard"):
            assert sorted(s.slot) == list(range(len(s)))
    out = sharding.assign(docs.where("doc_id = 8 OR text IS NULL")).toPandas()
    assert set(out["size"]) == {1, len(texts()[8].encode()) + 1} and zlib.crc32(texts()[8].encode()) in set(out.text_crc32)
    assert sharding.assign(empty).count() == 0


# ---- 10 contamination -----------------------------------------------------------

@pytest.mark.parametrize("block_words", [200_000, 40])
def test_contamination(spark, block_words):
    items = [(1, " ".join(prose(2, 55, 100_000))), (2, "one two"), (3, None), (4, ""), (10, " ".join(prose(50, 12, 30))),
             (11, " ".join(prose(51, 25, 4))), (11, " ".join(prose(51, 25, 4)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, t) for i, t in enumerate(texts())] + [(900, "x " + items[4][1].upper() + " y"), (901, " ".join(prose(53, 400, 4)))]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id long, text string, spare string, note string")
    windows = defaultdict(set)
    for i, t in items:
        w = plain(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k:k + m])].add(str(i))
    got = {r.doc_id: r for r in contamination.matches(df, bench, block_words=block_words).collect()}
    for i, t in docs:
        w, hit, found = plain(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k:k + m])]
        r = got[i]
        assert (r.n_words, {j for s in r.spans for j in range(s.start, s.end)}, r["items"]) == (len(w), hit, sorted(found))
    cleaned = {r.doc_id: r.text for r in contamination.clean(df, bench).collect()}
    assert cleaned[0] == docs[0][1] and cleaned[2] is None and cleaned[900] == "x  y" if 900 in cleaned else True
    assert plain(cleaned[21]) == [x for k, x in enumerate(plain(docs[21][1])) if k not in {j for s in got[21].spans for j in range(s.start, s.end)}]


# ---- the pipeline ---------------------------------------------------------------

def test_pipeline_stages_follow_on(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    want = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf), name)
        assert docs.columns == want and 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.pack(spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == before
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0
