"""Secret detection and redaction over whole texts, as built-in expressions."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.functions import text as X


# Inside every pattern \s stands in a character class.
PATTERNS = [(name, rx.replace(r"\s", X.SPACE)) for name, rx in V.SECRET_PATTERNS]

# What a match of each pattern begins with, any case for the last but one.
STARTS = {
    "aws_access_key": ["AKIA"],
    "aws_secret_key": ["aws_secret", "secret_key", "SECRET_KEY"],
    "database_url": ["postgres:", "mysql:", "mongodb:", "redis:"],
    "github_token": ["ghp_", "ghs_"],
    "anthropic_key": ["sk-ant-"],
    "openai_key": ["sk-"],
    "slack_token": ["xox"],
    "private_key": ["-----BEGIN "],
    "jwt_token": ["eyJ"],
    "generic_api_key": ["".join(t) for t in itertools.product("aA", "pP", "iI")],
    "bearer_token": ["Bearer"],
}


def _guard() -> str:
    """Lookahead over the characters a match can begin with. It changes no result;
    it spares most positions of a text the eleven alternatives."""
    starts = [s for some in STARTS.values() for s in some] + [x + "-" + a for x in "xX" for a in "aA"]
    sets = ["".join(sorted({re.escape(s[i]) for s in starts})) for i in range(3)]
    return "(?=" + "".join(f"[{c}]" for c in sets) + ")"


# One alternation in precedence order: the engine takes the leftmost start, then
# the first alternative, so spans never overlap.
ANY_SECRET = _guard() + "(?:" + "|".join(f"(?:{rx})" for _, rx in PATTERNS) + ")"


def _may_have(c: Column, names: list[str]) -> Column:
    """Plain substring tests that every match has to pass, far cheaper than the
    patterns."""
    tests = [c.contains(s) for n in names for s in STARTS[n]]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def has_secret(c: Column) -> Column:
    return _may_have(c, list(STARTS)) & c.rlike(ANY_SECRET)


def label(match: Column) -> Column:
    """Type of a matched span: the first pattern that starts it."""
    out = None
    for name, rx in PATTERNS:
        cond = match.rlike(f"^(?:{rx})")
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def redact(c: Column) -> Column:
    """Replace every secret with ``[REDACTED:<type>]``. Clean text, the common
    case, costs one scan."""
    pieces = F.split(c, ANY_SECRET, -1)
    marks = F.transform(
        F.regexp_extract_all(c, F.lit(ANY_SECRET), F.lit(0)),
        lambda m: F.concat(F.lit("[REDACTED:"), label(m), F.lit("]")),
    )
    joined = F.array_join(
        F.zip_with(pieces, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""
    )
    return F.when(has_secret(c), joined).otherwise(c)


def spans(c: Column, rx: str) -> Column:
    """array<struct(start, end)> of the matches of one pattern (0-based, end
    exclusive), from the lengths of the pieces around them."""
    before = F.transform(F.split(c, rx, -1), F.length)
    inside = F.transform(F.regexp_extract_all(c, F.lit(rx), F.lit(0)), F.length)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    steps = F.slice(F.arrays_zip(before.alias("b"), inside.alias("m")), 1, F.size(inside))
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["b"] + s["m"]).alias("at"),
            F.array_append(
                acc["out"],
                F.struct((acc["at"] + s["b"]).alias("start"), (acc["at"] + s["b"] + s["m"]).alias("end")),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(c.rlike(rx), walked).otherwise(empty)


def find(c: Column) -> Column:
    """array<struct(type, start, end)> over all patterns."""

    def typed(name: str, rx: str) -> Column:
        hits = F.transform(spans(c, rx), lambda s: F.struct(
            F.lit(name).alias("type"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(_may_have(c, [name]), hits).otherwise(
            F.array().cast("array<struct<type:string,start:int,end:int>>"))

    return F.flatten(F.array(*[typed(name, rx) for name, rx in PATTERNS]))


def markers(c: Column) -> Column:
    """Types named by the redaction markers in a text, one per occurrence."""
    return F.regexp_extract_all(c, F.lit(V.REDACTION_MARKER), F.lit(1))
