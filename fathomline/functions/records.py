"""Nested records: shortening by schema, and parsing of replies and tables in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions.text import strip

MOST_CHARS, MOST_ITEMS = 2000, 30


def shortened(c: Column, kind: T.DataType, chars: int = MOST_CHARS, items: int = MOST_ITEMS) -> Column:
    """Texts cut to ``chars`` and arrays to ``items``, at any depth; nulls stay null."""
    if isinstance(kind, T.StringType):
        return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("…"))).otherwise(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(c, 1, items), lambda x: shortened(x, kind.elementType, chars, items))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: shortened(v, kind.valueType, chars, items))
    if isinstance(kind, T.StructType):
        fields = [shortened(c[f.name], f.dataType, chars, items).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def is_longer(c: Column, kind: T.DataType, chars: int = MOST_CHARS, items: int = MOST_ITEMS) -> Column:
    """Whether ``shortened`` takes anything away."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.length(c) > chars, F.lit(False))
    if isinstance(kind, T.ArrayType):
        inner = F.exists(F.slice(c, 1, items), lambda x: is_longer(x, kind.elementType, chars, items))
        return F.coalesce(F.size(c) > items, F.lit(False)) | F.coalesce(inner, F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.exists(F.map_values(c), lambda v: is_longer(v, kind.valueType, chars, items)), F.lit(False))
    if isinstance(kind, T.StructType):
        out = F.lit(False)
        for f in kind.fields:
            out = out | is_longer(c[f.name], f.dataType, chars, items)
        return out
    return F.lit(False)


def shortened_frame(df: DataFrame, chars: int = MOST_CHARS, items: int = MOST_ITEMS, flag: str = "truncated") -> DataFrame:
    """All columns shortened, and whether any of the row was."""
    cut = [shortened(F.col(f"`{f.name}`"), f.dataType, chars, items).alias(f.name) for f in df.schema.fields if f.name != flag]
    longer = F.lit(False)
    for f in df.schema.fields:
        longer = longer | is_longer(F.col(f"`{f.name}`"), f.dataType, chars, items)
    return df.select(*cut, longer.alias(flag))


VERDICTS = "array<struct<score: double, reason: string>>"


def verdicts(c: Column, expected: int) -> Column:
    """A reply's list of verdicts if it has as many as expected, scores within 0 and 1 and reasons of 30 characters; else null."""
    bare = F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    parsed = F.from_json(bare, VERDICTS)
    tidy = F.transform(
        parsed,
        lambda v: F.struct(
            F.least(F.greatest(F.coalesce(v["score"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("score"),
            F.substring(v["reason"], 1, 30).alias("reason"),
        ),
    )
    return F.when(F.size(parsed) == expected, tidy)


def table_rows(c: Column) -> Column:
    """The two-column rows of a Markdown table in a text, as an array of ``key, value``; rules and heads of dashes are left out."""
    pattern = F.lit(r"(?m)^\|[ \t]*([^|\n]*?)[ \t]*\|[ \t]*([^|\n]*?)[ \t]*\|[ \t]*$")
    zipped = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("key"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("value"))
    return F.filter(zipped, lambda r: ~r["key"].rlike("^[-: ]*$"))


def section(c: Column, title: str) -> Column:
    """The text under a second-level heading, up to the next one; empty if there is none."""
    quoted = "".join("\\" + x if x in r"\.[]{}()*+-?^$|/" else x for x in title)
    return strip(F.regexp_extract(c, rf"(?ms)^##[ \t]+{quoted}[ \t]*$\n(.*?)(?=^##[ \t]|\z)", 1))


def zipped(left: Column, right: Column) -> Column:
    """Array of struct(left, right) by places. Arrays of different lengths are refused; null gives null."""
    checked = F.assert_true(F.coalesce(F.size(left) == F.size(right), F.lit(True)), "lists of different lengths can't be put together")
    return F.when(checked.isNull(), F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right"))))
