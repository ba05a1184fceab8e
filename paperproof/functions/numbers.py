"""Numbers in text. Each parser gives struct<value decimal(18,6), value_text string, error string>: value or error is null.

Nothing is rounded: text with more than 12 digits before or 6 after the point is an error, out_of_range.
Digits are ASCII ones. value_text is the number as a plain decimal with the digits that the text has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(18,6)"
PARSED = f"struct<value:{DECIMAL},value_text:string,error:string>"
_PLAIN = r"^[-+]?0*[0-9]{1,12}(?:\.[0-9]{0,6}0*)?\z"
# Plain numbers that are their own text: no plus, no zeros before, no point behind.
_OWN_TEXT = r"^-?(?:0|[1-9][0-9]{0,11})(?:\.[0-9]{1,6})?\z"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, with x computed once; within lambdas the optimizer doesn't see that a long expression is used again and again. It is the last
    step of an aggregate over nothing that starts with x: an array of one, transformed, would copy what body makes, and derive its type, each time."""
    return F.aggregate(F.array(), x, lambda own, _: own, body)


def _parsed(token: Column, plain: Column, absent: str, invalid: str, positive: bool = False) -> Column:
    """token is empty where there is no number; plain is it with a point and without grouping. Each step is taken once: the usual number is
    its own text, and errors are told apart only where there is none."""
    text = F.when(plain.rlike(_OWN_TEXT), plain).when(plain.rlike(_PLAIN), F.regexp_replace(plain, r"^\+?(-?)0*(?=[0-9])|\.\z", "$1"))
    none = F.when(F.coalesce(token, F.lit("")) == "", absent).when(~plain.rlike(r"^[-+]?[0-9]+(?:\.[0-9]*)?\z"), invalid).otherwise("out_of_range")
    failed = lambda error: F.struct(F.lit(None).cast(DECIMAL).alias("value"), F.lit(None).cast("string").alias("value_text"), error.alias("error"))
    good = lambda value, t: F.struct(value.alias("value"), t.alias("value_text"), F.lit(None).cast("string").alias("error"))
    read = (lambda t: let(t.try_cast(DECIMAL), lambda v: F.when(v <= 0, failed(F.lit("non_positive_quantity"))).otherwise(good(v, t)))) if positive else (lambda t: good(t.try_cast(DECIMAL), t))
    return let(text, lambda t: F.when(t.isNotNull(), read(t)).otherwise(failed(none)))


def parse_grouped_amount(raw: Column) -> Column:
    """The first number, all dots and commas of which are grouping: 12,500.00 is 1250000."""
    token = F.regexp_extract(raw, r"[-+]?[0-9][0-9.,]*", 0)
    return let(token, lambda t: let(F.translate(t, ".,", ""), lambda plain: _parsed(t, plain, "no_numeric_amount", "invalid_amount")))


def parse_quantity(raw: Column) -> Column:
    """The first number with a decimal comma or point; zero and less are errors."""
    token = F.regexp_extract(raw, r"[-+]?[0-9]+(?:[.,][0-9]+)?", 0)
    return let(token, lambda t: let(F.replace(t, F.lit(","), F.lit(".")), lambda plain: _parsed(t, plain, "no_numeric_quantity", "invalid_quantity", positive=True)))


def parse_amount(raw: Column) -> Column:
    """The first number by European rules: with both separators the last is the decimal one; a lone comma is decimal; a dot groups
    if just three digits follow the last one, and is decimal otherwise."""
    return let(F.regexp_extract(raw, r"[-+]?[0-9][0-9.,]*", 0), _european)


def _european(token: Column) -> Column:
    no_dots, no_commas, pointed = F.replace(token, F.lit("."), F.lit("")), F.replace(token, F.lit(","), F.lit("")), lambda x: F.replace(x, F.lit(","), F.lit("."))
    both = F.when(token.rlike(r",[^.]*\z"), pointed(no_dots)).otherwise(no_commas)
    plain = F.when(token.contains(","), F.when(token.contains("."), both).otherwise(pointed(token))).when(token.rlike(r"\.[^.]{3}\z"), no_dots).otherwise(token)
    return let(plain, lambda p: _parsed(token, p, "no_numeric_amount", "invalid_amount"))


def trailing_amount(line: Column) -> Column:
    """The amount at the end of a line, European rules; null if there is none or it can't be read."""
    token = F.regexp_extract(line, r"(-?[0-9][0-9.,]*)\s*\z", 1)
    got = parse_amount(token)
    return F.when((token != "") & got["error"].isNull(), got)


def beyond(a: Column, b: Column, tolerance: str) -> Column:
    """Whether two amounts differ by more than the tolerance; just the tolerance is allowed."""
    return F.abs(a - b) > F.lit(tolerance).cast(DECIMAL)


def rate(count: Column, of: Column) -> Column:
    """A share to four digits, half to even; 0 of nothing."""
    return F.when(of > 0, F.bround(count / of, 4)).otherwise(F.lit(0.0))
