"""JSON of varying shape, as VARIANT. A JSON null and an absent key both count as absent."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperproof.functions.numbers import let

# What parse_json sets behind a text; no text can hold it, as it is another in each process.
_END = uuid.uuid4().hex


def parse_json(text: Column) -> Column:
    """The text as a variant; null unless it is one whole JSON value. The parser itself would pass over what follows a value, so a mark that
    must come out as the next element is set behind it: a text that closes the list itself, or holds several values, lacks it there."""
    one = lambda listed: F.when(text_at(listed, "$[1]") == _END, F.try_variant_get(listed, "$[0]", "variant"))
    return let(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))), one)


def get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def absent(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT<"), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def elements(v: Column) -> Column:
    """array<variant>; null unless v is an array."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_objects(v: Column) -> Column:
    return F.coalesce(F.forall(elements(v), is_object), F.lit(False))


def texts(v: Column) -> Column:
    """An array of texts as it is; null for anything else. Casts alone would turn numbers to text."""
    return F.when(F.coalesce(F.forall(elements(v), is_text), F.lit(False)), F.try_variant_get(v, "$", "array<string>"))


def by_kind(v: Column, absent: Column, text: Callable[[Column], Column], other: Callable[[Column, Column], Column]) -> Column:
    """What is made of a value that is absent, of one that is a text, or of any other and its texts, if it is an array of such. Its kind is asked for once."""
    return let(kind(v), lambda k: F.when(k == "STRING", let(text_at(v, "$"), text)).when(F.coalesce(k == "VOID", F.lit(True)), absent).otherwise(let(F.when(k.startswith("ARRAY<"), texts(v)), lambda t: other(v, t))))


def keys(v: Column) -> Column:
    """The keys of an object; null for anything else."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def is_present(v: Column) -> Column:
    """Neither absent nor an empty text, array or object; 0 and false are there."""
    return ~absent(v) & ~F.coalesce(F.to_json(v).isin('""', "[]", "{}"), F.lit(False))


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, computed once a row. They are generated, so the optimizer can't copy their expressions into each filter and
    projection that uses them, as it would a plain column's."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
