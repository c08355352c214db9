"""Mining allow entries from observed calls, and merging allow lists.

An allow list is a DataFrame (pos, entry): ``pos`` gives the order of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.functions import calls, text as X
from spoor.workspace import Filters, Workspace, is_mcp

NO_FILTER = Filters()
SHELLS = ["Bash", "Shell"]


def permissions(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Observed (tool, verb, sub) paths with counts, category and allow entry.

    Shell calls count at verb depth and, where there is one, at verb + sub depth;
    other tools count as themselves.
    """
    shell = F.col("tool").isin(SHELLS)
    verb, sub = F.col("verb"), F.col("sub")
    null = F.lit(None).cast("string")
    paths = F.when(
        shell,
        F.array_compact(F.array(
            F.when(verb.isNotNull(), F.struct(verb.alias("verb"), null.alias("sub"))),
            F.when(sub.isNotNull(), F.struct(verb.alias("verb"), sub.alias("sub"))),
        )),
    ).otherwise(F.array(F.struct(null.alias("verb"), null.alias("sub"))))
    category = (
        F.when(shell & F.col("verb").isin(V.CORE_VERBS), "core")
        .when(shell & F.col("verb").isin(V.BUILD_VERBS), "build")
        .when(shell, "other")
        .when(F.col("tool").isin(V.FILE_TOOLS), "file")
        .when(is_mcp(F.col("tool")), "mcp")
        .otherwise("other")
    )
    prefix = F.concat_ws(" ", "verb", "sub")
    entry = F.when(shell, F.concat("tool", F.lit("("), prefix, F.lit(":*)"))).otherwise(F.col("tool"))
    depth = F.lit(1) + F.col("verb").isNotNull().cast("int") + F.col("sub").isNotNull().cast("int")
    observed = ws.trace_rows(f, calls.is_tool_call(), F.col("tool_name").isNotNull()).select(
        calls.pascal_tool(F.col("tool_name")).alias("tool"), X.nonempty(F.col("session_id")).alias("session_id"), "command")
    observed = observed.withColumn("command", F.when(shell, F.col("command")))
    return (
        calls.with_verb(observed).select("tool", "session_id", F.inline(paths))
        .groupBy("tool", "verb", "sub")
        .agg(F.count(F.lit(1)).alias("count"), F.countDistinct("session_id").alias("sessions"))
        .select(category.alias("category"), "tool", "verb", "sub", depth.alias("depth"), "count", "sessions",
                entry.alias("allow_entry"))
        .orderBy("category", F.desc("count"), "depth", "allow_entry")
    )


def parse_entries(entries: DataFrame, *keep: str) -> DataFrame:
    """Columns raw, tool, tokens, wildcard, reasonable of the entries that parse.

    Only shell entries have a wildcard (``:*`` or `` *``) and tokens to reason
    about; arguments of other tools are opaque.
    """
    shell, inner, body = F.col("tool").isin(SHELLS), F.col("_inner"), F.col("_body")
    at, length = F.col("_at"), F.length("raw")
    return (
        entries.select(*keep, X.trim_all(F.col("entry")).alias("raw")).where(F.col("raw") != "")
        .withColumn("_at", F.instr("raw", "("))
        .where((at == 0) | F.col("raw").endswith(")"))
        .withColumn("tool", F.when(at == 0, F.col("raw")).otherwise(F.substring("raw", F.lit(1), at - 1)))
        .withColumn("_inner", X.trim_all(F.when(at > 0, F.substring("raw", at + 1, length - at - 1)).otherwise("")))
        .withColumn("wildcard", shell & (inner.endswith(":*") | inner.endswith(" *")))
        .withColumn("_body", X.trim_all(
            F.when(F.col("wildcard"), F.substring("_inner", F.lit(1), F.length("_inner") - 2)).otherwise(inner)))
        .withColumn("tokens", F.when(body == "", F.array().cast("array<string>"))
                    .when(shell, F.split(body, X.WS + "+")).otherwise(F.array(body)))
        .select(*keep, "raw", "tool", "tokens", "wildcard", (shell | (inner == "")).alias("reasonable"))
    )


def _prefixes(longest: Column) -> Column:
    """Token prefixes of length 0 to ``longest``."""
    return F.when(longest >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(longest, F.lit(0))), lambda n: F.slice("tokens", 1, n)))


def merge(existing: DataFrame, candidate: DataFrame) -> DataFrame:
    """Union of two allow lists without entries another one strictly covers.

    Returns (entry, kept, added, subsumed_by): ``subsumed_by`` is the first
    covering entry in list order. Wildcards meet entries through their token
    prefixes, an equi-join; equal-token wildcards are pre-aggregated, so no entry
    is compared with every other.
    """
    order = F.struct("source", "pos")
    entries = (
        parse_entries(existing.withColumn("source", F.lit(0)), "source", "pos")
        .unionByName(parse_entries(candidate.withColumn("source", F.lit(1)), "source", "pos"))
        .groupBy("raw").agg(
            F.min(order).alias("at"), F.first("tool").alias("tool"), F.first("tokens").alias("tokens"),
            F.first("wildcard").alias("wildcard"), F.first("reasonable").alias("reasonable"))
    )
    wildcards = (
        entries.where("wildcard").groupBy("tool", "tokens")
        .agg(F.min(F.struct("at", "raw")).alias("cover"))
    )
    # A wildcard is covered by shorter wildcards only: the two spellings of one
    # wildcard both stay.
    longest = F.size("tokens") - F.col("wildcard").cast("int")
    covered = (
        entries.where("reasonable").select("raw", "tool", F.explode(_prefixes(longest)).alias("tokens"))
        .join(wildcards, ["tool", "tokens"])
        .groupBy("raw").agg(F.min("cover").alias("cover"))
    )
    return (
        entries.join(covered, "raw", "left")
        .select(
            F.col("raw").alias("entry"), F.col("cover").isNull().alias("kept"),
            (F.col("cover").isNull() & (F.col("at.source") == 1)).alias("added"),
            F.col("cover.raw").alias("subsumed_by"))
        .orderBy("entry")
    )


SCOPES = ["project-local", "project-shared", "user-global"]


def settings_union(entries: DataFrame) -> DataFrame:
    """Distinct allow entries over all settings files with the scope that
    contributes each first. entries: label, path, entry, error."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col("label"))
    return (
        entries.where(F.col("entry").isNotNull() & F.col("error").isNull())
        .groupBy("entry").agg(F.min_by("label", F.struct(rank.alias("r"), "path")).alias("label"),
                              F.min(F.struct(rank.alias("r"), "path"))["path"].alias("path"))
        .orderBy("entry")
    )


def settings_sources(entries: DataFrame) -> DataFrame:
    """Per settings file: entries no higher scope had, or its error."""
    first = settings_union(entries).groupBy("label", "path").agg(F.count(F.lit(1)).alias("new"))
    return (
        entries.groupBy("label", "path").agg(F.max("error").alias("error"))
        .join(first, ["label", "path"], "left")
        .select("label", "path", F.coalesce("new", F.lit(0)).alias("count"), "error")
    )


def latest_repo_local(git: DataFrame) -> DataFrame:
    """Most recent local checkout per project."""
    return (
        git.where(F.col("repo_local").isNotNull() & F.col("project").isNotNull()).groupBy("project")
        .agg(F.max_by("repo_local", F.struct("timestamp_text", "repo_local")).alias("repo_local"))
    )


def candidates(perms: DataFrame, depth: str = "verb", overrides: DataFrame | None = None) -> DataFrame:
    """Allow entries to propose: shell paths at one depth ('verb' or 'sub') and
    every other tool. ``overrides`` (allow_entry, include) switch single rows; a
    sub entry falls out when its verb entry is in."""
    if depth not in ("verb", "sub"):
        raise ValueError("depth must be 'verb' or 'sub'")
    shell = F.col("tool").isin(SHELLS)
    default = ~shell | (F.col("depth") == (2 if depth == "verb" else 3))
    rows = perms.withColumn("included", default)
    if overrides is not None:
        rows = rows.join(overrides, "allow_entry", "left").withColumn("included", F.coalesce("include", "included"))
    rows = rows.where("included")
    verbs = rows.where(shell & (F.col("depth") == 2)).select("tool", "verb")
    subs = rows.where(shell & (F.col("depth") == 3)).join(verbs, ["tool", "verb"], "left_anti")
    return (
        rows.where(~shell | (F.col("depth") < 3)).select("allow_entry")
        .unionByName(subs.select("allow_entry")).orderBy("allow_entry")
    )


def broadening(existing: DataFrame) -> DataFrame:
    """Verbs with two or more narrow shell entries and no wildcard of their own."""
    rows = (
        parse_entries(existing).where(F.col("tool").isin(SHELLS + ["shell"]) & (F.size("tokens") > 0))
        .withColumn("verb", F.get("tokens", F.lit(0)))
        .withColumn("whole", F.col("wildcard") & (F.size("tokens") == 1))
    )
    return (
        rows.groupBy("tool", "verb")
        .agg(F.count_if(~F.col("whole")).alias("count"), F.bool_or("whole").alias("has_wildcard"))
        .where((F.col("count") >= 2) & ~F.col("has_wildcard"))
        .select("tool", "verb", "count", F.concat("tool", F.lit("("), "verb", F.lit(":*)")).alias("entry"))
        .orderBy(F.desc("count"), "verb", "tool")
    )


def mark_existing(perms: DataFrame, existing: DataFrame) -> DataFrame:
    """``perms`` with ``existing``: the entry is in the list, or one covers the
    other in either direction."""
    have = parse_entries(existing).where("reasonable")
    mine = perms.select(F.col("allow_entry").alias("entry")).distinct()
    parsed = parse_entries(mine, "entry").where("reasonable")
    exact = mine.join(existing.select("entry").distinct(), "entry", "left_semi")
    trimmed = parsed.join(have.select("raw").distinct(), "raw", "left_semi").select("entry")
    above = (
        parsed.select("entry", "tool", F.explode(_prefixes(F.size("tokens"))).alias("tokens"))
        .join(have.where("wildcard").select("tool", "tokens").distinct(), ["tool", "tokens"], "left_semi").select("entry")
    )
    below = (
        parsed.where("wildcard")
        .join(have.select("tool", F.explode(_prefixes(F.size("tokens"))).alias("tokens")).distinct(),
              ["tool", "tokens"], "left_semi").select("entry")
    )
    marks = (
        exact.unionByName(trimmed).unionByName(above).unionByName(below).distinct()
        .select(F.col("entry").alias("allow_entry"), F.lit(True).alias("hit"))
    )
    return perms.join(marks, "allow_entry", "left").withColumn("existing", F.coalesce("hit", F.lit(False))).drop("hit")


def expand_rules(rules: DataFrame, tool: str = "Shell") -> DataFrame:
    """Allow entries of prefix rules. rules: rule_id, pattern
    (array<array<string>>: alternatives per position), decision."""
    start = F.array(F.array().cast("array<string>"))
    combos = F.aggregate(
        "pattern", start,
        lambda acc, options: F.flatten(F.transform(acc, lambda c: F.transform(options, lambda o: F.array_append(c, o)))))
    return (
        rules.where(F.col("decision") == "allow").select("rule_id", F.posexplode(combos))
        .select("rule_id", F.col("pos"),
                F.concat(F.lit(f"{tool}("), F.array_join("col", " "), F.lit(":*)")).alias("entry"))
    )


SPECIAL = r'[(){}\[\]"\\,]'


def format_rules(entries: DataFrame) -> DataFrame:
    """Prefix-rule text of shell wildcards, one row per line: verbs, then verbs
    with their subcommands as alternatives, then entries that cannot be split.
    Ordered by (section, sort_key)."""
    rx = r"^(?:Bash|Shell)\((.+):\*\)\z"
    q = X.json_text
    rows = (
        entries.where(F.col("entry").rlike(rx))
        .select("pos", F.split(X.trim_all(F.regexp_extract("entry", rx, 1)), X.WS + "+").alias("tokens"))
        .withColumn("opaque", F.exists("tokens", lambda t: t.rlike(SPECIAL)))
        .withColumn("verb", F.get("tokens", F.lit(0)))
        .withColumn("sub", F.array_join(F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), " "))
    )

    def line(body: Column) -> Column:
        return F.concat(F.lit("prefix_rule(pattern=["), body, F.lit('], decision="allow")'))

    single = F.size("tokens") == 1
    verbs = rows.where(~F.col("opaque") & single).select("verb").distinct().select(
        F.lit(0).alias("section"), F.col("verb").alias("sort_key"), line(q(F.col("verb"))).alias("line"))
    alternatives = F.array_join(F.transform("subs", q), ", ")
    subs = (
        rows.where(~F.col("opaque") & ~single).groupBy("verb").agg(F.array_sort(F.collect_set("sub")).alias("subs"))
        .select(F.lit(1).alias("section"), F.col("verb").alias("sort_key"), line(F.concat(
            q(F.col("verb")), F.lit(", "),
            F.when(F.size("subs") == 1, alternatives)
            .otherwise(F.concat(F.lit("["), alternatives, F.lit("]"))))).alias("line"))
    )
    opaque = rows.where("opaque").select(
        F.lit(2).alias("section"), F.lpad(F.col("pos").cast("string"), 20, "0").alias("sort_key"),
        line(F.array_join(F.transform("tokens", q), ", ")).alias("line"))
    return verbs.unionByName(subs).unionByName(opaque).orderBy("section", "sort_key")
