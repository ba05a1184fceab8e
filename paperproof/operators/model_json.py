"""A language model's answer, as JSON, becomes a canonical receipt, or an error that says which rule it breaks first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperproof.functions import variant as J
from paperproof.functions.numbers import let, parse_amount, parse_quantity
from paperproof.functions.text import WS, is_blank, is_currency, normalize_text
from paperproof.plans.schema import DOCUMENT_FIELDS, EXTRACTED, ITEM_FIELDS, LINE_ITEM, NOT_PRESENT, SCHEMA_VERSION, UNCERTAIN, UNREADABLE, dec_field, text_field

ALLOWED = (EXTRACTED, NOT_PRESENT, UNCERTAIN, UNREADABLE)  # fixed values: what a model may say of a field


def _objects(names) -> str:
    return f"struct<{','.join(f'{n}:variant' for n in names)}>"


def _said(v: Column) -> Column:
    """struct<object, status, raw> of one field: whether it is an object, its status if that is a known one, and its text if that isn't blank."""
    text = lambda x: F.when(J.is_text(x), J.text_at(x, "$"))
    known = lambda x: F.when(x.isin(*ALLOWED), x)
    full = lambda x: F.when(~is_blank(x), x)
    return let(F.try_variant_get(v, "$", _objects(("status", "value"))), lambda f: F.struct(f.isNotNull().alias("object"), let(text(f["status"]), known).alias("status"), let(text(f["value"]), full).alias("raw")))


def _none(x: Column) -> Column:
    return x["status"].isin(NOT_PRESENT, UNREADABLE)


def _number(x: Column, parse) -> Column:
    status, raw = x["status"], x["raw"]
    read = lambda p: F.when(p["error"].isNotNull(), dec_field(UNCERTAIN, raw=raw)).otherwise(dec_field(status, p["value"], p["value_text"], raw))
    return F.when(_none(x), dec_field(status)).when(raw.isNull(), dec_field(UNCERTAIN)).otherwise(let(parse(raw), read))


def _amount(x: Column) -> Column:
    return _number(x, parse_amount)


def _text(x: Column) -> Column:
    return F.when(_none(x), text_field(x["status"])).when(x["raw"].isNull(), text_field(UNCERTAIN)).otherwise(text_field(x["status"], normalize_text(x["raw"]), x["raw"]))


def _currency(x: Column) -> Column:
    raw = x["raw"]
    code = F.upper(F.regexp_replace(raw, f"^{WS}|{WS}\\z", ""))
    read = lambda c: F.when(is_currency(c), text_field(EXTRACTED, c, raw)).otherwise(text_field(UNCERTAIN, raw=raw))
    return F.when(_none(x) | raw.isNull() | (x["status"] != EXTRACTED), _text(x)).otherwise(let(code, read))


def _item(x: Column) -> Column:
    """A line item of its fields' findings, in the order of ITEM_FIELDS."""
    amounts = F.transform(F.slice(x, 3, 2), _amount)  # one expression for both
    return let(amounts, lambda a: F.struct(_text(x[0]).alias("description"), _number(x[1], parse_quantity).alias("quantity"), a[0].alias("unit_price"), a[1].alias("line_total")))


def _field_error(x: Column, path: Column) -> Column:
    return F.when(~F.coalesce(x["object"], F.lit(False)), F.concat(path, F.lit(" not an object"))).when(x["status"].isNull(), F.concat(path, F.lit(".status unknown")))


def adapt_model_json(df: DataFrame, *, raw: str = "raw") -> DataFrame:
    """df with the columns of a receipt but its id, and error. raw is JSON text; null or malformed text is an error. Row-local. Each value is taken
    from the answer once, and what is said of it is read by one expression for each kind of field."""
    own = df.columns
    inside = lambda v, names: F.try_variant_get(v, "$", _objects(names))
    df = J.bound(df, _root=J.parse_json(F.col(raw)))
    df = J.bound(df, _in=inside(F.col("_root"), ("line_items", *DOCUMENT_FIELDS)))
    df = J.bound(df, _items=J.elements(F.col("_in.line_items")), _doc=F.transform(F.array(*[F.col(f"_in.{n}") for n in DOCUMENT_FIELDS]), _said))
    of_item = lambda x: let(inside(x, ITEM_FIELDS), lambda o: F.when(o.isNotNull(), F.transform(F.array(*[o[n] for n in ITEM_FIELDS]), _said)))
    df = J.bound(df, _listed=F.transform("_items", of_item))
    at = lambda i, n="": F.concat(F.lit("line_items["), i.cast("string"), F.lit(f"]{n}"))
    of_item = lambda x, i: F.coalesce(F.when(x.isNull(), F.concat(at(i), F.lit(" not an object"))), *[_field_error(F.get(x, F.lit(k)), at(i, f".{n}")) for k, n in enumerate(ITEM_FIELDS)])
    sound = lambda x: x.isNotNull() & F.forall(x, lambda f: f["object"] & f["status"].isNotNull())
    first = F.get(F.filter(F.transform("_listed", of_item), lambda e: e.isNotNull()), F.lit(0))
    error = F.coalesce(
        F.when(F.col("_root").isNull(), "invalid_json"), F.when(F.col("_in").isNull(), "root not an object"), F.when(F.col("_items").isNull(), "line_items not a list"),
        F.when(~F.forall("_listed", sound), first), *[_field_error(F.get("_doc", F.lit(k)), F.lit(n)) for k, n in enumerate(DOCUMENT_FIELDS)],
    )
    df = J.bound(df, error=error, _amounts=F.transform(F.slice("_doc", 1, 3), _amount))
    good = lambda x: F.when(F.col("error").isNull(), x)
    amounts = [good(F.get("_amounts", F.lit(k))).alias(n) for k, n in enumerate(DOCUMENT_FIELDS[:3])]
    return df.select(*own, "error", good(F.lit(SCHEMA_VERSION)).alias("schema_version"), good(F.transform("_listed", _item)).cast(f"array<{LINE_ITEM}>").alias("line_items"), *amounts, good(_currency(F.get("_doc", F.lit(3)))).alias("currency"))
