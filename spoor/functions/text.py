"""Text and regular-expression helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as ECMAScript sees it; Java's \s is ASCII only.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{SPACE}]"
NOT_WS = f"[^{SPACE}]"


WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_all(c: Column) -> Column:
    """Strip every kind of whitespace (plain ``trim`` strips spaces only). Looks at
    the ends of the text, not at all of it."""
    return F.btrim(c, F.lit(WS_CHARS))


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    """Case-insensitive prefix test as one anchored alternation."""
    return c.rlike("(?i)^(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in prefixes) + ")")


def sha_prefix(n: int, *parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    joined = cols[0] if len(cols) == 1 else F.concat_ws(":", *cols)
    return F.substring(F.sha2(joined, 256), 1, n)


def nonempty(c: Column) -> Column:
    """Empty text becomes NULL."""
    return F.when(c != "", c)


def captured(c: Column | str, pattern: str, type_: str) -> Column:
    """First group of a pattern as a number; NULL when there is no match. The empty
    text of a miss is not handed to the cast, where it costs an exception."""
    hit = F.regexp_extract(c, pattern, 1)
    return F.when(hit != "", hit).try_cast(type_)


def json_text(c: Column) -> Column:
    """A string as a JSON string literal."""
    # to_json of a one-field struct is {"s":"..."}; keep the value.
    whole = F.to_json(F.struct(c.alias("s")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)
