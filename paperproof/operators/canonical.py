"""Canonical receipts as JSON text, the form that as_json writes: read back whole, or refused. Row-local."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperproof.functions import variant as J
from paperproof.functions.numbers import DECIMAL, let
from paperproof.plans.schema import DOCUMENT_FIELDS, EVIDENCE, ITEM_FIELDS, LINE_ITEM, RECEIPT_COLUMNS, SCHEMA_VERSION, dec_field, holds, text_field

_FIELD_KEYS, _EVIDENCE_KEYS, _SIDES = ("value", "raw_text", "status", "confidence", "evidence"), ("page", "text", "bounding_box"), ("left", "top", "right", "bottom")
# Types of values without anything odd, with their keys in the order of the alphabet: known keys alone, a status, values that are texts, and a list without values as evidence.
_PLAIN_FIELD = r"OBJECT<(?:confidence: (?:VOID|BIGINT|DOUBLE|DECIMAL\([0-9,]+\)), )?evidence: ARRAY<VOID>, (?:raw_text: (?:VOID|STRING), )?status: STRING(?:, value: (?:VOID|STRING))?>"
_PLAIN_ITEM = f"OBJECT<{', '.join(f'{n}: {_PLAIN_FIELD}' for n in sorted(ITEM_FIELDS))}>"
_PLAIN_RECEIPT = rf"^OBJECT<currency: {_PLAIN_FIELD}, document_id: STRING, line_items: ARRAY<(?:VOID|{_PLAIN_ITEM})>, (?:schema_version: STRING, )?{', '.join(f'{n}: {_PLAIN_FIELD}' for n in ('subtotal', 'tax', 'total'))}>\z"
_READ_FIELD = "struct<value:string,raw_text:string,status:string,confidence:double,evidence:array<variant>>"
_READ_RECEIPT = f"struct<schema_version:string,line_items:array<struct<{','.join(f'{n}:{_READ_FIELD}' for n in ITEM_FIELDS)}>>,{','.join(f'{n}:{_READ_FIELD}' for n in DOCUMENT_FIELDS)}>"


def _only_keys(k: Column, allowed, required=()) -> Column:
    known, needed = F.array(*map(F.lit, allowed)), F.array(*map(F.lit, required)) if required else F.array().cast("array<string>")
    return (F.size(F.array_except(k, known)) == 0) & (F.size(F.array_except(needed, k)) == 0)


def _only(v: Column, allowed, required=()) -> Column:
    """An object of allowed keys alone, with the required ones."""
    return F.coalesce(J.is_object(v) & let(J.keys(v), lambda k: _only_keys(k, allowed, required)), F.lit(False))


def _text_or_none(v: Column) -> Column:
    return J.absent(v) | J.is_text(v)


def _evidence_fits(v: Column) -> Column:
    whole = lambda x: F.try_variant_get(x, "$", "int").isNotNull()
    box = lambda b: J.absent(b) | (_only(b, _SIDES, _SIDES) & F.forall(F.array(*[whole(J.get(b, n)) for n in _SIDES]), lambda ok: ok))
    one = lambda e: _only(e, _EVIDENCE_KEYS, ("text",)) & J.is_text(J.get(e, "text")) & (J.get(e, "page").isNull() | whole(J.get(e, "page"))) & let(J.get(e, "bounding_box"), box)
    return v.isNull() | F.coalesce(F.forall(J.elements(v), one), F.lit(False))


def _field(v: Column, number: bool) -> Column:
    """The field of one value, null where its shape isn't one's: unknown keys, no status, or values of another kind."""
    said = lambda x: J.text_at(x, "$.value")
    value_fits = lambda x: J.absent(J.get(x, "value")) | (said(x).try_cast(DECIMAL).isNotNull() if number else J.is_text(J.get(x, "value")))
    confidence = lambda x: F.try_variant_get(x, "$.confidence", "double")
    fits = lambda x: _only(x, _FIELD_KEYS, ("status",)) & J.is_text(J.get(x, "status")) & value_fits(x) & _text_or_none(J.get(x, "raw_text")) & (J.absent(J.get(x, "confidence")) | confidence(x).isNotNull()) & _evidence_fits(J.get(x, "evidence"))
    evidence = lambda x: F.try_variant_get(x, "$.evidence", f"array<{EVIDENCE}>")
    made = lambda x: dec_field(J.text_at(x, "$.status"), said(x).try_cast(DECIMAL), said(x), J.text_at(x, "$.raw_text"), confidence(x)) if number else text_field(J.text_at(x, "$.status"), said(x), J.text_at(x, "$.raw_text"), confidence(x))
    return let(v, lambda x: F.when(fits(x), made(x).withField("evidence", evidence(x))))


def _plain_field(f: Column, number: bool) -> Column:
    """The field of one that a plain receipt's cast has read; null if a number's text is none."""
    evidence = F.array().cast(f"array<{EVIDENCE}>")
    if not number:
        return text_field(f["status"], f["value"], f["raw_text"], f["confidence"]).withField("evidence", evidence)
    field = lambda d: dec_field(f["status"], d, f["value"], f["raw_text"], f["confidence"]).withField("evidence", evidence)
    return let(f["value"].try_cast(DECIMAL), lambda d: F.when(f["value"].isNull() | d.isNotNull(), field(d)))


def _plain(root: Column) -> Column:
    """A receipt read by one cast, if its type says that nothing about it is odd. A list's type is that of all its elements together, so each
    must have what they all must have; null else, and for receipts that are to be asked key by key."""
    full = lambda f: f["status"].isNotNull() & (F.coalesce(F.size(f["evidence"]), F.lit(-1)) == 0)
    every = lambda x, names: reduce(and_, [full(x[n]) for n in names])
    sound = lambda r: every(r, DOCUMENT_FIELDS) & F.coalesce(F.forall(r["line_items"], lambda x: every(x, ITEM_FIELDS)), F.lit(False))
    return F.when(J.kind(root).rlike(_PLAIN_RECEIPT), let(F.try_variant_get(root, "$", _READ_RECEIPT), lambda r: F.when(sound(r), r)))


def _sound_item(fields: Column) -> Column:
    return let(fields, lambda f: F.when(reduce(and_, [f[n].isNotNull() for n in ITEM_FIELDS]), f))


def _item(m: Column) -> Column:
    """The item of one value, as a map by its keys; null where its shape isn't one's."""
    return F.when(F.size(m) == len(ITEM_FIELDS), _sound_item(F.struct(*[_field(F.element_at(m, n), n != "description").alias(n) for n in ITEM_FIELDS])))


def _plain_item(x: Column) -> Column:
    return _sound_item(F.struct(*[_plain_field(x[n], n != "description").alias(n) for n in ITEM_FIELDS]))


def read_receipts(df: DataFrame, *, raw: str = "raw") -> DataFrame:
    """df with the columns of a receipt and schema_valid. raw is JSON text. A receipt that lacks a key that has no default, has a key that
    isn't known, a value of another kind, or breaks a constraint (schema.faults) isn't valid, and its columns are null. A version or line
    items that are left out are the current version and none; a null text isn't valid."""
    own = df.columns
    df = J.bound(df.select(F.struct(*own).alias("_own"), F.col(raw).alias("_raw")), _root=J.parse_json(F.col("_raw")))
    df = J.bound(df, _plain=_plain(F.col("_root")))
    plain, by_key = F.col("_plain"), F.col("_map")
    df = J.bound(df, _map=F.when(plain.isNull(), F.try_variant_get("_root", "$", "map<string,variant>")))
    at = lambda n: F.element_at(by_key, n)
    listed = F.when(at("line_items").isNull(), F.array().cast(f"array<{LINE_ITEM}>")).otherwise(F.transform(F.try_variant_get(at("line_items"), "$", "array<map<string,variant>>"), _item).cast(f"array<{LINE_ITEM}>"))
    items = F.when(plain.isNotNull(), F.transform("_plain.line_items", _plain_item).cast(f"array<{LINE_ITEM}>")).otherwise(listed)
    version = F.when(plain.isNotNull(), F.coalesce("_plain.schema_version", F.lit(SCHEMA_VERSION))).when(at("schema_version").isNull(), F.lit(SCHEMA_VERSION)).when(J.is_text(at("schema_version")), J.text_at(F.col("_root"), "$.schema_version"))
    fields = {n: F.when(plain.isNotNull(), _plain_field(F.col(f"_plain.{n}"), n != "currency")).otherwise(_field(at(n), n != "currency")) for n in DOCUMENT_FIELDS}
    shape = plain.isNotNull() | (F.coalesce(_only_keys(F.map_keys(by_key), RECEIPT_COLUMNS, ("document_id", *DOCUMENT_FIELDS)), F.lit(False)) & J.is_text(at("document_id")))
    read = J.bound(df.select("_own", "_root", "_plain", "_map"), _shape=shape, schema_version=version, document_id=J.text_at(F.col("_root"), "$.document_id"), line_items=items, **fields)
    whole = F.col("_shape") & F.col("schema_version").isNotNull() & F.coalesce(F.forall("line_items", lambda x: x.isNotNull()), F.lit(False))
    for n in DOCUMENT_FIELDS:
        whole = whole & F.col(n).isNotNull()
    read = J.bound(read, schema_valid=F.coalesce(whole & holds(), F.lit(False)))
    return read.select("_own.*", *[F.when(F.col("schema_valid"), F.col(n)).alias(n) for n in RECEIPT_COLUMNS], "schema_valid")


def schema_valid_rate(read: DataFrame) -> DataFrame:
    """One row: documents, valid, rate (null without documents) of what read_receipts returns."""
    return read.agg(F.count("*").alias("documents"), F.count_if("schema_valid").alias("valid"), F.avg(F.col("schema_valid").cast("double")).alias("rate"))
