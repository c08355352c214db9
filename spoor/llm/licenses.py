"""License scan: ordered signature rules, in built-in expressions only.

A rule is a regex over normalised words (lower case, one space between words), anchored
at its first word. That word is the rule's keyword: a text is looked at only if it holds
a gate term, and at each keyword only the rules of that keyword are tried. A match is an
interval of words with a priority. An interval inside another of the same or a higher
priority is suppressed; of equal intervals the higher priority stays, then the earlier
rule. Labels are those of what remains, and of the base phrases always.

All work is inside a row, linear in its words but for one sort of its matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import common

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # A-Z are made lower case
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: names by which texts call it, as word regexes.
NAMES = {
    "mit": ["mit", "expat", "mit x11"], "mit-0": ["mit no attribution", "mit 0"],
    "apache-1.1": ["apache (?:software )?1 1"], "apache-2.0": ["apache (?:software )?(?:v|version )?2(?: 0)?", "asl 2 0"],
    "apache": ["apache", "apache software"],
    "gpl-2.0": ["gnu gpl v?2(?: 0)?", "gpl v?2(?: 0)?", "gplv2"], "gpl-3.0": ["gnu gpl v?3(?: 0)?", "gpl v?3(?: 0)?", "gplv3"],
    "gpl": ["gnu general public", "gnu gpl", "gpl"], "lgpl-2.1": ["lgpl v?2 1", "gnu lgpl v?2 1", "lgplv2 1"],
    "lgpl-3.0": ["lgpl v?3(?: 0)?", "gnu lgpl v?3", "lgplv3"],
    "lgpl": ["gnu lesser general public", "gnu library general public", "lesser general public", "lgpl"],
    "agpl-3.0": ["gnu affero general public", "affero general public", "agpl v?3(?: 0)?", "agplv3", "agpl"],
    "gfdl": ["gnu free documentation", "gfdl"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "bsd-4-clause": ["bsd 4 clause", "4 clause bsd", "original bsd"], "0bsd": ["0bsd", "zero clause bsd", "bsd zero clause"],
    "bsd": ["bsd", "bsd style"], "isc": ["isc"], "mpl-1.1": ["mozilla public 1 1", "mpl v?1 1"],
    "mpl-2.0": ["mozilla public 2 0", "mpl v?2(?: 0)?", "mplv2"], "mpl": ["mozilla public", "mpl"],
    "epl-1.0": ["eclipse public 1 0", "epl v?1 0"], "epl-2.0": ["eclipse public 2 0", "epl v?2 0"],
    "epl": ["eclipse public", "epl"], "edl": ["eclipse distribution"], "cddl": ["common development and distribution", "cddl"],
    "cpl": ["common public", "cpl"], "eupl": ["european union public", "eupl"], "artistic-2.0": ["artistic 2 0", "perl artistic"],
    "artistic": ["artistic"], "bsl-1.0": ["boost software", "boost"], "zlib": ["zlib", "zlib libpng"], "libpng": ["libpng", "png reference library"],
    "unlicense": ["unlicense"], "wtfpl": ["wtfpl", "do what the fuck you want to public"], "cc0-1.0": ["cc0(?: 1 0)?", "creative commons zero"],
    "cc-by-4.0": ["creative commons attribution 4 0(?: international)?", "cc by 4 0"],
    "cc-by-3.0": ["creative commons attribution 3 0(?: unported)?", "cc by 3 0"],
    "cc-by-sa-4.0": ["creative commons attribution share ?alike 4 0(?: international)?", "cc by sa 4 0"],
    "cc-by-sa-3.0": ["creative commons attribution share ?alike 3 0(?: unported)?", "cc by sa 3 0"],
    "cc-by-nc-4.0": ["creative commons attribution non ?commercial 4 0(?: international)?", "cc by nc 4 0"],
    "cc-by-nc-sa-4.0": ["creative commons attribution non ?commercial share ?alike 4 0", "cc by nc sa 4 0"],
    "cc-by-nd-4.0": ["creative commons attribution no ?derivatives 4 0", "cc by nd 4 0"],
    "cc": ["creative commons attribution", "creative commons"], "psf-2.0": ["python software foundation", "psf"],
    "python-2.0": ["python 2 0"], "php": ["php"], "ruby": ["ruby"], "perl": ["perl"], "tcl": ["tcl tk", "tcl"],
    "openssl": ["openssl", "ssleay"], "ofl-1.1": ["sil open font", "open font", "ofl 1 1"], "odbl": ["open database", "odbl"],
    "odc-by": ["open data commons attribution", "odc by"], "pddl": ["public domain dedication and", "pddl"],
    "ms-pl": ["microsoft public", "ms pl"], "ms-rl": ["microsoft reciprocal", "ms rl"], "afl-3.0": ["academic free", "afl 3 0"],
    "osl-3.0": ["open software", "osl 3 0"], "ecl-2.0": ["educational community", "ecl 2 0"], "ncsa": ["university of illinois ncsa open source", "ncsa"],
    "upl-1.0": ["universal permissive", "upl 1 0"], "postgresql": ["postgresql"], "vim": ["vim"], "w3c": ["w3c software", "w3c"],
    "x11": ["x11", "x consortium"], "ijg": ["independent jpeg group", "ijg"], "icu": ["icu", "unicode icu"], "unicode": ["unicode"],
    "curl": ["curl"], "ftl": ["freetype project", "freetype"], "hpnd": ["historical permission notice and disclaimer", "hpnd"],
    "blueoak-1.0.0": ["blue oak model", "blueoak 1 0 0"], "mulan-psl-2.0": ["mulan psl", "mulan permissive software"],
    "busl-1.1": ["business source", "busl 1 1"], "sspl-1.0": ["server side public", "sspl"], "elastic-2.0": ["elastic"],
    "polyform-nc": ["polyform noncommercial"], "cecill": ["cecill", "ceci(?:ll)? c"], "qpl": ["q public", "qpl"],
    "apsl-2.0": ["apple public source", "apsl"], "ipl-1.0": ["ibm public", "ipl 1 0"], "spl": ["sun public", "spl"],
    "npl": ["netscape public", "npl"], "openrail": ["openrail(?: m)?", "creativeml open rail(?: m)?", "responsible ai"], "llama": ["llama 2 community", "llama 3 community", "llama community"],
}

#: Sentences of license texts: (label, regex).
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "http www apache org licenses license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "gnu general public license (?:as published by the free software foundation )?(?:either )?version 2(?: of the license)?"),
    ("gpl-3.0", "gnu general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("agpl-3.0", "gnu affero general public license as published by the free software foundation"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc", "this work is licensed under a creative commons"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("public-domain", "(?:this file|this work|this code|this software) is in the public domain"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved(?: unauthorized (?:copying|use|distribution))"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("artistic", "this package is free software you can redistribute it and or modify it under the same terms as perl"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("llama", "llama 2 is licensed under the llama 2 community license"),
]

#: Every rule's match holds one of these runs of normalised words, so a text without them
#: is not looked at. In a text any gap may lie between two words.
TERMS = ["licen[sc]", "spdx", "permission", "redistribut", "copyright", "public", "proprietary", "warranty", "unauthorized", "advertising", "contributors",
         "what the fuck", "free software", "openssl project", "(?:released|distributed|available) under"]
GATE = "(?i)" + "|".join(t.replace(" ", f"{GAP}+") for t in TERMS)

CONTEXT = 40  # words that a rule can see, more than any rule's longest match


def _first_words(regex: str) -> tuple[list[str], str]:
    """The plain words a rule can start with."""
    if regex.startswith("(?:"):
        inner = regex[3:regex.index(")")]
        return [x.split(" ")[0] for x in inner.split("|")], regex
    ending = re.match(r"(\w+)\(\?:(\w+)\)\?", regex)
    if ending:
        return [ending[1], ending[1] + ending[2]], regex
    return [regex.split(" ")[0].split("(")[0].rstrip("?")], regex


def rules() -> list[tuple[str, str, int, str]]:
    """(keyword, regex, priority, label) in order: identifier tags (3), license sentences
    and grants (2), plain names (1)."""
    out: list[tuple[str, str, int, str]] = []
    for label in NAMES:
        tag = label.replace("-", " ").replace(".", " ")
        out.append(("spdx", f"spdx license identifier {tag}(?: only| or later)?", 3, label))
    for label, regex in TEXTS:
        out += [(w, r, 2, label) for w, r in [(w, regex) for w in _first_words(regex)[0]]]
    for label, names in NAMES.items():
        any_name = "|".join(names)
        for word in ("licensed", "released", "distributed", "available"):
            out.append((word, f"{word} under (?:the )?(?:terms of )?(?:the )?(?:{any_name})(?: licen[sc]e)?(?: v| version)?", 2, label))
    for label, names in NAMES.items():
        for name in names:
            out += [(word, f"{name} licen[sc]e", 1, label) for word in _first_words(name)[0]]
    out += [(p.split(" ")[0], p, 1, label) for p, label in BASE.items()]
    return out


def _table() -> Column:
    return F.array(*[F.struct(F.lit(w).alias("w"), F.lit(f"^(?:{r}) ").alias("r"), F.lit(p).alias("p"), F.lit(i).alias("i"), F.lit(x).alias("x"))
                     for i, (w, r, p, x) in enumerate(rules())])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every column of ``docs`` plus ``scan``: a struct of n_words, n_base, first_word,
    last_word, base_labels, labels, score, and ``found``, the remaining intervals
    (start, end, priority, label). Score is the best remaining priority over three.

    Null or empty text: no words, no labels, score 0. Repeated rows are each scanned.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n_words = F.when(t.rlike(WORD), F.length(F.regexp_replace(t, f"{GAP}*{WORD}+{GAP}*", "x"))).otherwise(0).cast("bigint")
    firsts = sorted({r[0] for r in rules()})
    plain = F.trim(F.regexp_replace(F.translate(t, common.UPPER, common.LOWER), f"{GAP}+", " "))
    df = docs.withColumns({"_n": n_words, "_w": F.when(t.rlike(GATE), F.split(plain, " ")).otherwise(F.array().cast("array<string>"))})

    at = F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("s"), w.alias("w"))),
                  lambda x: F.array_contains(F.array(*map(F.lit, firsts)), x["w"]))
    seen = F.transform(at, lambda x: F.struct(
        x["s"].alias("s"), x["w"].alias("w"),
        F.concat(F.array_join(F.slice(F.col("_w"), x["s"] + 1, CONTEXT), " "), F.lit(" ")).alias("c")))
    df = df.withColumn("_at", seen)

    def matches(x):
        hit = F.filter(_table(), lambda r: (r["w"] == x["w"]) & F.regexp_like(x["c"], r["r"]))
        return F.transform(hit, lambda r: F.struct(
            x["s"].alias("s"),
            (-(x["s"] + F.size(F.split(F.rtrim(F.regexp_substr(x["c"], r["r"])), " ")) - 1)).alias("neg_end"),
            (-r["p"]).alias("neg_p"), r["i"].alias("i"), r["x"].alias("x")))

    df = df.withColumn("_hit", F.when(F.size("_at") > 0, F.array_sort(F.flatten(F.transform("_at", matches)))))
    is_base = lambda x: F.exists(F.array(*[F.lit(p + " ") for p in BASE]), lambda p: x["c"].startswith(p))
    base = F.transform(F.filter("_at", is_base), lambda x: F.struct(
        x["s"].alias("s"), F.element_at(F.create_map(*[F.lit(v) for p in BASE.items() for v in (p[0].split(" ")[0], p[1])]), x["w"]).alias("x")))
    df = df.withColumn("_base", base)

    # Matches come by start, then longest, then priority: one is suppressed if an earlier
    # one of at least its priority reaches as far. far: furthest end by least priority.
    none = F.lit(-1)
    start = F.struct(F.array(none, none, none).alias("far"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))

    def fold(acc, x):
        p, end = -x["neg_p"], -x["neg_end"]
        kept = F.element_at(acc["far"], p) < end
        far = F.transform(acc["far"], lambda v, k: F.when(k < p, F.greatest(v, end)).otherwise(v))
        return F.struct(far.alias("far"),
                        F.when(kept, F.array_union(acc["labels"], F.array(x["x"]))).otherwise(acc["labels"]).alias("labels"),
                        F.when(kept, F.greatest(acc["best"], p)).otherwise(acc["best"]).alias("best"))

    df = df.withColumn("_left", F.when(F.col("_hit").isNotNull(), F.aggregate("_hit", start, fold)))
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda x: x["x"])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce(F.col("_left.labels"), F.array().cast("array<string>"))))
    best = F.greatest(F.coalesce(F.col("_left.best"), F.lit(0)), F.when(F.size("_base") > 0, 1).otherwise(0))
    place = lambda i: F.when(F.size("_base") > 0, F.element_at(F.col("_base"), i)["s"].cast("bigint"))
    out = F.struct(
        F.col("_n").alias("n_words"), F.size("_base").cast("bigint").alias("n_base"), place(1).alias("first_word"), place(-1).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        (best / F.lit(3.0)).cast("double").alias("score"),
        F.transform(F.coalesce(F.col("_hit"), F.filter(F.array(F.struct(*[F.lit(0).alias(c) for c in ("s", "neg_end", "neg_p", "i")], F.lit("").alias("x"))), lambda x: F.lit(False))),
                    lambda x: F.struct(x["s"].alias("start"), (-x["neg_end"]).alias("end"), (-x["neg_p"]).alias("priority"), x["x"].alias("label"))).alias("matches"))
    return df.withColumn("scan", out).select(*docs.columns, "scan")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f"scan.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])
