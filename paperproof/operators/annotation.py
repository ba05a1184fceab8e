"""Annotation JSON of varying shape becomes canonical receipts, or an error that says which rule it breaks first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperproof.functions import variant as J
from paperproof.functions.text import document_id
from paperproof.operators.landing import ABSENT, COLUMNS, ITEM_KEYS, OBJECT, OBJECTS, OTHER, as_landed
from paperproof.plans.schema import EXTRACTED, LINE_ITEM, NOT_ANNOTATED, NOT_PRESENT, RECEIPT_COLUMNS, SCHEMA_VERSION, dec_field, text_field

# A cell is a value as landing makes it.


def text_status(c: Column) -> Column:
    return F.when(c["value"].isNotNull(), EXTRACTED).otherwise(NOT_PRESENT)


def number_status(c: Column) -> Column:
    """A number is there if all readable texts agree on it; none, or several, is not_annotated."""
    return F.when(F.coalesce(c["kind"] == ABSENT, F.lit(True)) | (c["said"] == 0), NOT_PRESENT).when(c["value"].isNotNull(), EXTRACTED).otherwise(NOT_ANNOTATED)


def _text(c: Column) -> Column:
    return text_field(text_status(c), c["value"], c["raw"])


def _number(c: Column) -> Column:
    return dec_field(number_status(c), c["value"], c["value_text"], c["raw"])


def line_item(cells: Column) -> Column:
    return F.struct(*[(_text if name == "description" else _number)(cells[key]).alias(name) for name, key in ITEM_KEYS])


#: Canonical amounts: field, section, its key in the format, the cell's key.
AMOUNTS = (("subtotal", "sub", "sub_total", "subtotal_price"), ("tax", "sub", "sub_total", "tax_price"), ("total", "tot", "total", "total_price"))


def amount_status(section: str, key: str) -> Column:
    """The status of an amount of a section, which may be a list."""
    return F.when(F.col(f"{section}_is") == OBJECTS, NOT_ANNOTATED).otherwise(number_status(F.col(f"{section}.{key}")))


def own_id(explicit_id: str | None = None) -> Column:
    return document_id(F.col(explicit_id) if explicit_id else None, F.col("split"), F.col("image_id"))


def adapter_error(explicit_id: str | None = None) -> Column:
    """Which rule a landed annotation breaks first; null if it breaks none."""
    path = lambda i, key: F.lit("text field not text") if key == "nm" else F.concat(F.lit("menu["), i.cast("string"), F.lit(f"].{key} not text"))
    kinds = F.arrays_zip(*[F.col(f"items.{key}.kind").alias(key) for _, key in ITEM_KEYS])
    items = F.flatten(F.transform(kinds, lambda x, i: F.array(*[F.when(x[key] == OTHER, path(i, key)) for _, key in ITEM_KEYS])))
    some_item = F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))
    odd = F.lit(False)
    for _, key in ITEM_KEYS:
        odd = odd | F.coalesce(F.array_contains(F.col(f"items.{key}.kind"), OTHER), F.lit(False))
    return F.coalesce(
        F.when(F.col("root").isNull(), "invalid_json"), F.when(F.col("root") != OBJECT, "root not an object"), F.when(F.col("gt") != OBJECT, "gt_parse not an object"),
        F.when(F.col("meta") == OTHER, "meta not an object"), F.when(own_id(explicit_id).isNull(), "no document id"), F.when(F.col("n_items").isNull(), "menu not objects"),
        F.when(odd, some_item), F.when(F.col("sub_is") == OTHER, "sub_total not an object"), F.when(F.col("tot_is") == OTHER, "total not an object"),
        *[F.when(F.col(f"{c}.{key}.kind") == OTHER, f"{where}.{key} not text") for _, c, where, key in AMOUNTS],
    )


def adapted(df: DataFrame, *, explicit_id: str | None = None) -> DataFrame:
    """Of landed rows: the columns of a receipt and error. Just one of error and the receipt is null."""
    df = J.bound(df, error=adapter_error(explicit_id))
    good = lambda x: F.when(F.col("error").isNull(), x)
    amounts = [good(F.when(F.col(f"{c}_is") == OBJECTS, dec_field(NOT_ANNOTATED, raw=F.col(f"{c}_json"))).otherwise(_number(F.col(f"{c}.{key}")))).alias(name) for name, c, _, key in AMOUNTS]
    return df.select("*", good(F.lit(SCHEMA_VERSION)).alias("schema_version"), good(own_id(explicit_id)).alias("document_id"), good(F.transform("items", line_item)).cast(f"array<{LINE_ITEM}>").alias("line_items"), *amounts, good(text_field(NOT_ANNOTATED)).alias("currency"))


def adapt_annotations(df: DataFrame, *, text: str = "ground_truth", explicit_id: str | None = None) -> DataFrame:
    """df, of texts or landed, with the columns of a receipt and error. Null or malformed text is invalid_json. Row-local."""
    own = [c for c in df.columns if c not in COLUMNS]
    rows = as_landed(df.withColumn("_text", F.col(text)), "_text") if text in df.columns else df
    return adapted(rows, explicit_id=explicit_id).select(*own, *RECEIPT_COLUMNS, "error")
