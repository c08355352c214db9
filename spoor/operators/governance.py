"""Disclosure tiers, field policies, redaction, anonymisation, scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor import fixed_values as V
from spoor.functions import secrets
from spoor.functions.text import sha_prefix


def _strip(df: DataFrame, hidden: set[str]) -> DataFrame:
    """Hidden columns turn to typed NULLs, so the scan below does not read them."""
    return df.select(*[
        (F.lit(None).cast(f.dataType) if f.name in hidden else F.col(f.name)).alias(f.name)
        for f in df.schema.fields
    ])


def _above(level: str, tiers: dict[str, list[str]]) -> set[str]:
    if level not in V.DISCLOSURE_LEVELS:
        raise ValueError(f"unknown disclosure level {level!r}")
    order = V.DISCLOSURE_LEVELS.index(level)
    return {c for tier, cols in tiers.items() if V.DISCLOSURE_LEVELS.index(tier) > order for c in cols}


def disclose(traces: DataFrame, level: str) -> DataFrame:
    """Null every trace column above the disclosure level."""
    return _strip(traces, _above(level, V.TRACE_TIERS))


def disclose_git(git: DataFrame, level: str) -> DataFrame:
    return _strip(git, _above(level, V.GIT_TIERS))


def default_policy(level: str) -> dict[str, bool]:
    hidden = _above(level, V.TRACE_TIERS)
    return {c: c not in hidden for c in V.POLICY_FIELDS}


def apply_policy(traces: DataFrame, policy: dict[str, bool]) -> DataFrame:
    """Null the columns a policy switches off. Identity columns always ship."""
    unknown = set(policy) - set(V.POLICY_FIELDS)
    if unknown:
        raise ValueError(f"not policy fields: {sorted(unknown)}")
    return _strip(traces, {c for c, keep in policy.items() if not keep})


def redact_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Redact secrets in the text columns of a table (all string columns by
    default), arrays of text included."""
    names = set(columns) if columns is not None else {
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
        or (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType))
    }

    def clean(f: T.StructField) -> Column:
        if f.name not in names:
            return F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.transform(f.name, secrets.redact).alias(f.name)
        return secrets.redact(F.col(f.name)).alias(f.name)

    return df.select(*[clean(f) for f in df.schema.fields])


def anonymous(c: Column) -> Column:
    return F.concat(F.lit("anon:"), sha_prefix(12, c))


def anonymise(traces: DataFrame) -> DataFrame:
    """Replace developer and machine by stable hashes."""
    return traces.withColumns({c: anonymous(F.col(c)) for c in ("developer", "machine")})


def git_event_id(repo: Column, event_type: Column, key: Column) -> Column:
    return sha_prefix(16, repo, event_type, key)


def batch_id(source: Column, start: Column, end: Column, entries: Column) -> Column:
    return sha_prefix(16, source, *[c.cast("string") for c in (start, end, entries)])


def partition_hash(c: Column) -> Column:
    """Directory-safe hash of a developer or repository name."""
    return sha_prefix(12, c)


def drop_ephemeral(df: DataFrame, column: str = "project") -> DataFrame:
    """Leave out projects that are temporary directories."""
    c = F.coalesce(F.col(column), F.lit(""))
    return df.where(~c.rlike("|".join(V.EPHEMERAL_PROJECTS)))


def org_and_repo(remote: Column) -> Column:
    """struct(org, repo) of a remote URL, NULLs when it has no such shape."""
    hit = remote.rlike(V.REMOTE_URL)
    return F.struct(
        F.when(hit, F.regexp_extract(remote, V.REMOTE_URL, 1)).alias("org"),
        F.when(hit, F.regexp_extract(remote, V.REMOTE_URL, 2)).alias("repo"))


def in_scope(df: DataFrame, scope: DataFrame, org: str = "org", project: str = "project") -> DataFrame:
    """Keep rows the scope rules let through: at least one include, no exclude.
    Without includes nothing passes.

    scope: kind ('include' or 'exclude'), org, project; NULL stands for any.
    """
    out = df
    for kind in ("include", "exclude"):
        rules = scope.where(F.col("kind") == kind)
        # One equi-join per shape of rule, against distinct rules.
        for keys in (["org", "project"], ["org"], ["project"]):
            side = rules
            for k in ("org", "project"):
                side = side.where(F.col(k).isNotNull() if k in keys else F.col(k).isNull())
            side = side.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_hit", F.lit(True))
            on = [F.col({"org": org, "project": project}[k]) == F.col(f"_{k}") for k in keys]
            out = out.join(side, on, "left").withColumn(
                f"_{kind}", F.coalesce("_hit", F.lit(False)) | (F.col(f"_{kind}") if f"_{kind}" in out.columns else F.lit(False))
            ).drop("_hit", *[f"_{k}" for k in keys])
    return out.where(F.col("_include") & ~F.col("_exclude")).drop("_include", "_exclude")


def bind_tenant(batches: DataFrame, credentials: DataFrame) -> DataFrame:
    """Flag batches whose developer is the one their credential belongs to.

    batches carry ``credential``; credentials: credential, owner.
    """
    return (
        batches.join(credentials.select("credential", "owner"), "credential", "left")
        .withColumn("accepted", F.coalesce(F.col("developer") == F.col("owner"), F.lit(False)))
        .drop("owner")
    )
