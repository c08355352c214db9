"""Cases in which an operator once did less than its whole job."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from spoor.llm import licenses, similar, toxicity


def fresh(name, n):
    return [f"{name}n{j}" for j in range(n)]


def shingled(words):
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def contained():
    """Families in which one text holds another and is longer, most of both lying in long
    lists; chains of the long passages are the most central members."""
    size = 150
    long, mid = [fresh(f"l{i}", 84) for i in range(size + 4)], [fresh(f"m{i}", 17) for i in range(size + 4)]
    out = []
    for i in range(size):
        x = long[i] + mid[i] + fresh(f"s{i}", 3)
        out += [x, x + fresh(f"e{i}", 20)]
        out += [long[i] + fresh(f"f{i}k{k}", 60) for k in range(6)]
        for k in (2, 3, 4):
            out.append([w for j in range(i, i + k) for w in long[j] + mid[j]])
    return out


def test_contained_texts_of_other_length_are_linked(spark):
    rows = contained()
    sets = [shingled(w) for w in rows]
    holders = {}
    for k, s in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(k)
    shared = Counter((a, b) for at in holders.values() for i, a in enumerate(at) for b in at[i + 1:])
    links = [(a, b) for (a, b), o in shared.items() if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o)]
    least = list(range(len(rows)))
    for a, b in sorted(links):
        least[b] = min(least[b], least[a])
    assert len(links) == 150  # the families' two, so that no text has two links
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.classes(docs, long=2, rounds=2, skipped=80 * 154).collect()}
    assert [k for k in got if got[k] != least[k]] == []


def examples(tree):
    """Texts that a parsed regex matches: every branch, optional parts left out and put in."""
    out = []
    for kind, arg in tree:
        kind = str(kind)
        if kind == "LITERAL":
            out.append([chr(arg)])
        elif kind == "NOT_LITERAL":
            out.append(["z"])
        elif kind == "IN":
            out.append([chr(arg[0][1])])
        elif kind == "BRANCH":
            out.append([t for b in arg[1] for t in examples(b)])
        elif kind == "SUBPATTERN":
            out.append(examples(arg[3]))
        else:
            least, most, inner = arg
            out.append([t * n for t in examples(inner) for n in {least, min(most, least + 1)}])
    return ["".join(x) for x in itertools.product(*out)]


def test_every_license_rule_passes_the_gate():
    for word, regex, _, label in licenses.rules():
        for t in examples(re._parser.parse(regex)):
            if t.split(" ")[0] == word:
                assert re.search(licenses.GATE, t.upper().replace(" ", "\n - ")), (label, t)


def test_license_rules_find_their_examples(spark):
    rows = []
    for word, regex, _, label in licenses.rules():
        rows += [(label, t.title().replace(" ", "\n")) for t in [t for t in examples(re._parser.parse(regex)) if t.split(" ")[0] == word][:2]]
    rows += [("gpl-3.0", "This code is released under the GPL v3."), ("bsd", "Distributed under BSD"), ("cc-by-sa-4.0", "Available under CC BY-SA 4.0"),
             ("openssl", "This product includes software developed by the OpenSSL\nProject"), ("wtfpl", "you just DO what the\nfuck you want to"),
             ("cecill", "CeCILL-C license"), ("cecill", "ceci c licence"), ("openrail", "OpenRAIL License"), ("openrail", "OpenRAIL-M license")]
    got = licenses.scan(spark.createDataFrame(rows, "label string, text string")).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.label not in [m.label for m in r.scan.matches]] == []


def turned(n=1600):
    """Toxic texts hold one of 20 pairs of words, ordinary ones the same words turned
    around; no pair is in 30 toxic texts of the training folds."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(n):
        words, k = [f"w{x}" for x in rng.integers(0, 200, 12)], rng.integers(0, 20)
        words[5:7] = [f"a{k}", f"b{k}"] if i % 4 == 0 else [f"b{k}", f"a{k}"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def test_rare_toxic_pairs_count(spark, monkeypatch):
    rows, labels = turned()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    kept = sorted(r.doc_id for r in toxicity.clean(docs, marks).collect())
    assert kept == [i for i in got if not got[i].predicted]
    # What is sent out and what is joined give the same.
    monkeypatch.setattr(toxicity, "SENT", 20)
    again = {r.doc_id: r.score for r in toxicity.score(docs, marks).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-9)
    assert sorted(r.doc_id for r in toxicity.clean(docs, marks).collect()) == kept


def test_similar_lowers_ascii_letters(spark, tmp_path):
    """The query's sets are of lower-cased words, A-Z only; the operator's are as they stand."""
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words)), (2, " ".join(words).upper()), (3, "One two ONE two one two one TWO"), (4, "É a b c d"), (5, "é A B C D"), (6, "Hi"), (7, "hI"), (8, None), (9, " \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar.query(spark, str(tmp_path)).collect()}
    assert got == {1: (26, 1), 2: (26, 1), 3: (2, 3), 4: (1, 4), 5: (1, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (0, 9)}
    assert {r.doc_id: r.component_id for r in similar.classes(docs).collect()} == {i: i for i in range(1, 10)}
    assert {r.doc_id for r in similar.keep_one(docs, lower=True).collect()} == {1, 3, 4, 5, 6, 8, 9}


def test_the_pipeline_joins_what_the_operator_links(spark, tmp_path):
    """The stage keeps one document of each component of the query, case aside."""
    import corpus_pipeline

    words = [f"Word{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words).lower()), (3, " ".join(words[:58]).upper() + " more"), (4, "Hi"), (5, "hI"), (6, "É a b c d"), (7, "é A B C D"),
            (8, " ".join(words[::-1])), (None, " ".join(words).swapcase()), (9, None), (10, " \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    linked = similar.query(spark, str(tmp_path)).collect()
    want = {r.component_id for r in linked}
    assert want == {1, 4, 6, 7, 8, 9, 10}
    kept = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(want) and {(r.doc_id, r.text) for r in kept} <= set(rows)
