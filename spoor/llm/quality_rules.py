"""Quality rules with risk-controlled thresholds, in built-in expressions only.

A rule rejects a text whose measure reaches a cutoff. Cutoffs come from labelled rows,
which serve as holdout since the measures are fixed beforehand: for a stratum (language),
a cutoff is admissible if the exact binomial test rejects that its false rejection rate
among good texts exceeds ``alpha`` / number of rules, at level ``delta`` / (strata x
rules). Along one rule the cutoffs are nested and tested from the most lenient on, so
the correction is needed over strata and rules only. Then, with probability 1 - delta,
every stratum loses at most ``alpha`` of its good texts. Of the admissible cutoffs that
one is taken whose rejected bad rows exceed ``worth`` times its rejected good rows most;
without gain the rule stays off there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.llm import common

WORD, GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
RULES = ("symbols", "dup_lines", "repeats", "word_length")
ALPHA, DELTA, WORTH, TOP = 0.04, 0.1, 5, 100
BASE_FEW, BASE_REPEAT = 10, 20
WINDOW = 5


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and n_lines (lines with a word).

    Repeats: equal windows have equal hashes, so a text whose window hashes all differ
    has none; else its windows themselves are sorted and compared. Null text: all zero.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("_w", F.when(t.rlike(WORD), F.split(F.regexp_replace(t, f"^{GAP}+|{GAP}+$", ""), f"{GAP}+"))
                         .otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    n = F.size("_w")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - WINDOW + 1))
    df = df.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, WINDOW))))
    window = F.transform(starts, lambda i: F.struct(F.array_join(F.slice("_w", i, WINDOW), " ").alias("k"), i.alias("i")))
    df = df.withColumn("_k", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(window)))
    twice = F.filter(
        F.transform("_k", lambda x, j: F.struct(x["i"].alias("i"), (
            F.coalesce(F.get("_k", j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get("_k", j + 1)["k"] == x["k"], F.lit(False))).alias("hit"))),
        lambda x: x["hit"])
    df = df.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return df.select(
        *[c for c in docs.columns if c != text],
        n.cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(t, f"{GAP}+", "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"))


def measures() -> Column:
    """Value of each rule, 0 to 100: higher is worse."""
    share = lambda part, of: F.least(F.lit(TOP), F.floor(F.lit(100) * F.col(part) / F.greatest(F.col(of), F.lit(1)))).cast("int")
    length = F.least(F.lit(TOP), F.floor(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)))).cast("int")
    return F.array(share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), length)


def lgamma1(n: Column) -> Column:
    """log(n!) by Stirling's series; exact to about 1e-13 from 21 on, by factorial below."""
    x = (n + 1).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed down from k until terms cannot matter. At k >= n p the
    test is lost anyway; there 1 is returned."""
    n, k = n.cast("bigint"), k.cast("bigint")
    top = F.exp(lgamma1(n) - lgamma1(k) - lgamma1(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.least(k, (60 + 12 * F.sqrt(n * p)).cast("bigint"))
    down = lambda a, j: F.struct(  # noqa: E731  from term k - j + 1 to k - j
        (a["t"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("t"),
        (a["s"] + a["t"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("s"))
    total = F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1).cast("bigint"), steps)).otherwise(F.array().cast("array<bigint>")),
                        F.struct(top.alias("t"), top.alias("s")), down)["s"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def thresholds(labelled: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA, worth: int = WORTH) -> DataFrame:
    """One row per stratum: ``cutoffs``, the least rejected value per rule (null: off).

    ``labelled`` has ``stratum``, ``good`` (0/1) and ``values`` (one per rule). Counts are
    over all its rows; what is ordered afterwards has at most 101 values per rule.
    """
    bins = (labelled.select(stratum, "good", F.posexplode("values").alias("rule", "value"))
            .groupBy(stratum, "rule", "value").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    of = W.partitionBy(stratum, "rule")
    down = of.orderBy(F.desc("value"))
    cut = bins.select(stratum, "rule", "value", F.sum("good").over(down).alias("k"), F.sum("bad").over(down).alias("hits"),
                      F.sum("good").over(of).alias("n"))
    strata = labelled.agg(F.count_distinct(stratum).alias("strata")).scalar()
    cut = cut.withColumn("strata", strata).where("value > 0")
    admissible = binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= F.lit(delta) / (F.col("strata") * len(RULES))
    gain = F.col("hits") - worth * F.col("k")
    best = (cut.where(admissible & (gain > 0)).groupBy(stratum, "rule")
            .agg(F.max(F.struct(gain.alias("gain"), "value"))["value"].alias("value")))
    return best.groupBy(stratum).agg(F.map_from_entries(F.collect_list(F.struct("rule", "value"))).alias("m")).select(
        stratum, F.array(*[F.try_element_at("m", F.lit(i)) for i in range(len(RULES))]).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Rows of ``docs`` without text, with their measures, ``base_failed``, ``failed_rules``
    (names, comma-joined) and ``kept``.

    The narrow measures are written once and used twice. A null stratum is one of its
    own; a stratum without labelled rows has no cutoffs. Of several labels for one id
    the largest quality holds; labels without id or quality do not count. Null or empty
    text fails the base rule. Repeated rows are each judged.
    """
    df = common.stage(measured(docs.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit("")))).withColumn("values", measures()), "measures")
    one = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("good")))
    labelled = df.select("doc_id", "_s", "values").join(one, "doc_id").select("_s", "good", "values")
    cuts = common.stage(thresholds(labelled, "_s"), "cutoffs")
    df = df.join(cuts, "_s", "left")
    failed = F.filter(F.transform("values", lambda v, i: F.when(v >= F.get("cutoffs", i), F.get(F.array(*map(F.lit, RULES)), i))), lambda x: x.isNotNull())
    base = (F.col("n_words") < BASE_FEW) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))
    return df.withColumn("failed_rules", F.array_join(failed, ",")).withColumn("base_failed", base).withColumn(
        "kept", ~base & (F.col("failed_rules") == "")).drop("_s", "values", "cutoffs")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = judge(docs, common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
