"""Text functions as Column expressions. All are native, so that they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperproof.functions.numbers import let

# The characters at which Unicode text is split into words, as a Java class without brackets.
WS_CHARS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_CHARS}]+"
# What a text that normalize_text would change has in it; so has other text beyond ASCII.
_MAY_CHANGE = r"[^ -~]|^ |  | \z"
# Currency symbols in the order in which they are looked for within a line, and codes.
SYMBOLS = (("€", "EUR"), ("$", "USD"), ("£", "GBP"))
CODES = "EUR|USD|GBP|CHF"


def normalize_text(x: Column) -> Column:
    """White space of any kind becomes one space, none at the ends."""
    return let(x, lambda t: F.when(t.rlike(_MAY_CHANGE), F.trim(F.regexp_replace(t, WS, " "))).otherwise(t))


def stripped(x: Column) -> Column:
    """Without white space at its ends; what is inside stays."""
    return F.regexp_replace(x, rf"^{WS}|{WS}\z", "")


def is_missing(x: Column) -> Column:
    """Blank, or a dash that stands for nothing."""
    return x.rlike(rf"^[{WS_CHARS}]*+-?[{WS_CHARS}]*+\z")


def is_blank(x: Column) -> Column:
    """Nothing but white space."""
    return x.rlike(rf"^[{WS_CHARS}]*+\z")


def joined_raw(values: Column) -> Column:
    """All raw pieces of a value; null if there are none."""
    return F.when(F.size(values) > 0, F.array_join(values, " | "))


def fold(x: Column) -> Column:
    """Case-folded text. concat keeps the optimizer from taking lower(upper(x)) for lower(x), which would miss ß and ς."""
    return F.lower(F.concat(F.upper(x), F.lit("")))


def same_text(a: Column, b: Column) -> Column:
    return fold(normalize_text(a)) == fold(normalize_text(b))


def has_any(x: Column, words: Iterable[str]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    return F.lower(x).rlike("|".join(words))


def currency_symbol(line: Column) -> Column:
    """The code of the first symbol, by the order of SYMBOLS, that a line contains."""
    out = None
    for symbol, code in SYMBOLS:
        out = F.when(line.contains(symbol), code) if out is None else out.when(line.contains(symbol), code)
    return out


def currency_code(line: Column) -> Column:
    """The first code in an upper-cased line, as a word; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(line), rf"\b({CODES})\b", 1), F.lit(""))


def is_currency(x: Column) -> Column:
    return x.rlike(r"^\p{L}{3}\z")


def amount_format(raw: Column) -> Column:
    """Which separators an amount's text has, and whether anything but digits, signs and spaces stands beside them."""
    comma, dot = raw.contains(","), raw.contains(".")
    kind = F.when(comma & dot, "mixed_separators").when(comma, "comma").when(dot, "dot").otherwise("digits_only")
    return F.concat(kind, F.when(raw.rlike(f"[^0-9{WS_CHARS}.,+\\-]"), "_with_affix").otherwise("_plain"))


def quantity_format(raw: Column) -> Column:
    """The first of these that a quantity's text is, white space removed: a number, a decimal, x before or after a number."""
    kind = lambda t: F.when(t.rlike(r"^[0-9]+\z"), "integer").when(t.rlike(r"^[0-9]+[.,][0-9]+\z"), "decimal").when(t.rlike("x[0-9]"), "x_before_number").when(t.rlike("[0-9]([.,][0-9]+)?x"), "x_after_number").otherwise("other")
    return let(F.lower(F.regexp_replace(raw, WS, "")), kind)


def document_id(explicit: Column | None, split: Column, image_id: Column) -> Column:
    """An explicit id if it isn't empty; else one made from split (unknown if absent) and image id; null without either."""
    made = F.when(image_id.isNotNull(), F.concat(F.lit("cord-"), F.coalesce(split, F.lit("unknown")), F.lit("-"), image_id))
    return made if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), made)
