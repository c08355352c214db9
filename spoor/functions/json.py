"""Lenient JSON access: a mistyped field is NULL, the row stays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(line: Column) -> Column:
    """Parsed line, NULL when it is not JSON."""
    return F.try_parse_json(line)


def get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """Type name of a scalar. Not for objects or arrays: it spells out their whole
    schema."""
    return F.schema_of_variant(v)


def is_object_text(line: Column) -> Column:
    """Text of a JSON object, by its first character."""
    return F.ltrim(line).startswith("{")


def present(v: Column, path: str) -> Column:
    """The key is there and not JSON null."""
    sub = get(v, path)
    return sub.isNotNull() & ~F.coalesce(F.is_variant_null(sub), F.lit(True))


def text(v: Column, path: str = "$") -> Column:
    """A string value; numbers and the rest are NULL, not their spelling."""
    return F.when(kind(get(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def loose_text(v: Column, path: str) -> Column:
    """Any scalar as text; array elements joined by commas; NULL when empty."""
    as_text = F.coalesce(
        F.array_join(F.try_variant_get(v, path, "array<string>"), ","), F.try_variant_get(v, path, "string"))
    return F.when(as_text != "", as_text)


def integer(v: Column, path: str) -> Column:
    """A number, truncated towards zero."""
    number = F.try_variant_get(v, path, "decimal(38,9)").try_cast("bigint")
    return F.when(~kind(get(v, path)).isin("STRING", "BOOLEAN"), number)


def boolean(v: Column, path: str) -> Column:
    return F.when(kind(get(v, path)) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def elements(v: Column, path: str = "$") -> Column:
    """array<variant>, NULL when the value is not an array."""
    return F.try_variant_get(v, path, "array<variant>")


def strings(v: Column, path: str) -> Column:
    """Array items as text, NULL when the value is not an array."""
    return F.try_variant_get(v, path, "array<string>")
