"""The canonical receipt: one row per document, each field a struct that says how its value came to be.

A missing value is null and its status says why; it is never a zero or an empty text.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperproof.functions.numbers import DECIMAL
from paperproof.functions.text import is_currency

SCHEMA_VERSION = POLICY_VERSION = "0.1.0"
# Statuses, severities, reasons and field names of the format.
EXTRACTED, NOT_PRESENT, UNCERTAIN, UNREADABLE, NOT_ANNOTATED = STATUSES = ("extracted", "not_present", "uncertain", "unreadable", "not_annotated")
INFO, WARNING, ERROR = SEVERITIES = ("info", "warning", "error")
REASONS = ("missing_critical_field", "validation_error", "low_confidence", "unreadable_content")
ITEM_FIELDS = ("description", "quantity", "unit_price", "line_total")
DOCUMENT_FIELDS = ("subtotal", "tax", "total", "currency")

BOX = "struct<left:int,top:int,right:int,bottom:int>"
EVIDENCE = f"struct<page:int,text:string,bounding_box:{BOX}>"
FIELD_TEXT = f"struct<value:string,raw_text:string,status:string,confidence:double,evidence:array<{EVIDENCE}>>"
FIELD_DEC = f"struct<value:{DECIMAL},value_text:string,raw_text:string,status:string,confidence:double,evidence:array<{EVIDENCE}>>"
LINE_ITEM = f"struct<description:{FIELD_TEXT},quantity:{FIELD_DEC},unit_price:{FIELD_DEC},line_total:{FIELD_DEC}>"
RECEIPT = f"schema_version string, document_id string, line_items array<{LINE_ITEM}>, subtotal {FIELD_DEC}, tax {FIELD_DEC}, total {FIELD_DEC}, currency {FIELD_TEXT}"
RECEIPT_COLUMNS = ("schema_version", "document_id", "line_items", *DOCUMENT_FIELDS)


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def text_field(status, value: Column | None = None, raw: Column | None = None, confidence: Column | None = None) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    parts = {"value": _null("string") if value is None else value, "raw_text": _null("string") if raw is None else raw, "status": status, "confidence": _null("double") if confidence is None else confidence, "evidence": _null(f"array<{EVIDENCE}>")}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def dec_field(status, value: Column | None = None, text: Column | None = None, raw: Column | None = None, confidence: Column | None = None) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    if value is not None and text is None:
        text = value.cast("string")
    parts = {"value": _null(DECIMAL) if value is None else value.cast(DECIMAL), "value_text": _null("string") if text is None else text, "raw_text": _null("string") if raw is None else raw, "status": status, "confidence": _null("double") if confidence is None else confidence, "evidence": _null(f"array<{EVIDENCE}>")}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def is_extracted(field: Column) -> Column:
    return F.coalesce(field["status"] == EXTRACTED, F.lit(False))


def _field_rules(f: Column) -> dict[str, Column]:
    """Each constraint on a field by what breaks it, and whether the field does; null is no."""
    absent = f["status"].isin(NOT_PRESENT, UNREADABLE, NOT_ANNOTATED)
    box = lambda e: e["bounding_box"]
    good_box = lambda e: box(e).isNull() | ((box(e)["left"] >= 0) & (box(e)["top"] >= 0) & (box(e)["right"] > box(e)["left"]) & (box(e)["bottom"] > box(e)["top"]))
    good = lambda e: F.coalesce((F.coalesce(e["page"], F.lit(1)) >= 1) & (F.length(e["text"]) >= 1) & good_box(e), F.lit(False))
    return {
        "unknown status": ~F.coalesce(f["status"].isin(*STATUSES), F.lit(False)),
        "extracted without a value": is_extracted(f) & f["value"].isNull(),
        "a value where the status says there is none": absent & f["value"].isNotNull(),
        "confidence outside 0 to 1": ~f["confidence"].between(0.0, 1.0),
        "bad evidence": F.exists(f["evidence"], lambda e: ~good(e)),
    }


def _field_faults(path: Column, f: Column) -> Column:
    """What is wrong with one field, as texts; nulls where nothing is."""
    return F.array(*[F.when(broken, F.concat(path, F.lit(f": {what}"))) for what, broken in _field_rules(f).items()])


def field_holds(f: Column) -> Column:
    """Whether a field breaks none of its constraints."""
    return ~F.coalesce(reduce(or_, _field_rules(f).values()), F.lit(False))


def _receipt_rules() -> dict[str, Column]:
    """Each constraint on a receipt beyond those on its fields, as _field_rules has them."""
    code = F.col("currency.value")
    return {
        "document_id: empty": F.coalesce(F.length("document_id"), F.lit(0)) < 1,
        "schema_version: unknown": F.col("schema_version") != SCHEMA_VERSION,
        "line_items: absent": F.col("line_items").isNull(),
        "currency: not a code": is_extracted(F.col("currency")) & ~(is_currency(code) & (code == F.upper(code))),
    }


def faults() -> Column:
    """array<string> over the columns of a receipt: each constraint of the format that the row breaks; empty for a valid one."""
    doc = [_field_faults(F.lit(n), F.col(n)) for n in DOCUMENT_FIELDS]
    items = F.flatten(F.transform(F.coalesce("line_items", F.array().cast(f"array<{LINE_ITEM}>")), lambda x, i: F.flatten(F.array(*[_field_faults(F.format_string(f"line_items[%d].{n}", i), x[n]) for n in ITEM_FIELDS]))))
    own = F.array(*[F.when(broken, what) for what, broken in _receipt_rules().items()])
    return F.filter(F.concat(own, *doc, items), lambda x: x.isNotNull())


def holds() -> Column:
    """Whether a receipt, over its columns, breaks no constraint: faults is empty, without its texts."""
    items = F.coalesce(F.forall("line_items", lambda x: reduce(and_, [field_holds(x[n]) for n in ITEM_FIELDS])), F.lit(True))
    return reduce(and_, [~F.coalesce(broken, F.lit(False)) for broken in _receipt_rules().values()] + [field_holds(F.col(n)) for n in DOCUMENT_FIELDS]) & items


def as_json() -> Column:
    """A receipt as JSON text; decimals are their texts, with the digits they were read with; without evidence its list is empty."""
    evidence = lambda f: F.coalesce(f["evidence"], F.array().cast(f"array<{EVIDENCE}>")).alias("evidence")
    field = lambda f, value: F.struct(f[value].alias("value"), *[f[n].alias(n) for n in ("raw_text", "status", "confidence")], evidence(f))
    item = lambda x: F.struct(*[field(x[n], "value" if n == "description" else "value_text").alias(n) for n in ITEM_FIELDS])
    return F.to_json(F.struct("schema_version", "document_id", F.transform("line_items", item).alias("line_items"), *[field(F.col(n), "value" if n == "currency" else "value_text").alias(n) for n in DOCUMENT_FIELDS]), {"ignoreNullFields": "false"})
