"""Validation of receipts by fixed rules, and the decision that follows. Row-local: no shuffle, batch or stream alike."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperproof.functions import variant as J
from paperproof.functions.numbers import beyond, let
from paperproof.plans.schema import DOCUMENT_FIELDS, ERROR, INFO, ITEM_FIELDS, POLICY_VERSION, UNCERTAIN, UNREADABLE, WARNING, is_extracted

ISSUE = "struct<code:string,severity:string,field_paths:array<string>,message:string>"
# The review reason of each issue code; others are validation_error.
REASON_OF = (("MISSING_CRITICAL_FIELD", "missing_critical_field"), ("UNREADABLE_CRITICAL_FIELD", "unreadable_content"), ("LOW_CONFIDENCE", "low_confidence"))
ARITHMETIC = ("LINE_TOTAL_MISMATCH", "DOCUMENT_TOTAL_MISMATCH")


def issue(code: str, severity: str, paths: Column, *message) -> Column:
    text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), paths.alias("field_paths"), text.alias("message"))


def _plain(x: Column) -> Column:
    """A decimal without zeros at the end of its fraction."""
    return F.regexp_replace(x.cast("string"), r"(\.[0-9]*[1-9])0+\z|\.0+\z", "$1")


def _path(i: Column, name: str) -> Column:
    return F.concat(F.lit("line_items["), i.cast("string"), F.lit(f"].{name}"))


def is_doubtful(f: Column, threshold: float) -> Column:
    """Marked uncertain, or there with less confidence than the threshold."""
    return F.coalesce((f["status"] == UNCERTAIN) | (is_extracted(f) & (f["confidence"] < threshold)), F.lit(False))


def line_total_is_off(x: Column, tolerance: str) -> Column:
    q, u, t = x["quantity"], x["unit_price"], x["line_total"]
    return F.coalesce(is_extracted(q) & is_extracted(u) & is_extracted(t) & beyond(q["value"] * u["value"], t["value"], tolerance), F.lit(False))


def _sums() -> tuple[Column, Column, Column]:
    """The sum of the line totals, null unless all are known; that of subtotal and tax; whether both are there."""
    items, subtotal, tax = (F.col(n) for n in ("line_items", "subtotal", "tax"))
    known = (F.size(items) > 0) & F.forall(items, lambda x: is_extracted(x["line_total"]))
    summed = F.when(known, F.aggregate(items, F.lit(0).cast("decimal(28,6)"), lambda acc, x: (acc + F.coalesce(x["line_total"]["value"], F.lit(0).cast("decimal(18,6)"))).cast("decimal(28,6)")))
    return summed, subtotal["value"] + tax["value"], is_extracted(subtotal) & is_extracted(tax)


def _totals_off(tolerance: str) -> list[Column]:
    """Whether items miss the subtotal, subtotal and tax the total, and items the total where those two don't say."""
    summed, expected, both = _sums()
    subtotal, total = F.col("subtotal"), F.col("total")
    return [F.coalesce(c, F.lit(False)) for c in (
        summed.isNotNull() & is_extracted(subtotal) & beyond(summed, subtotal["value"], tolerance),
        both & is_extracted(total) & beyond(expected, total["value"], tolerance),
        ~both & summed.isNotNull() & is_extracted(total) & beyond(summed, total["value"], tolerance),
    )]


def _foreign(allowed: Collection[str]) -> Column:
    return F.coalesce(is_extracted(F.col("currency")) & ~F.col("currency.value").isin(*sorted(allowed)), F.lit(False))


def _critical(path: Column, f: Column) -> Column:
    unreadable = issue("UNREADABLE_CRITICAL_FIELD", ERROR, F.array(path), path, " can't be read, so the receipt can't be accepted unseen")
    missing = issue("MISSING_CRITICAL_FIELD", ERROR, F.array(path), path, " is needed to accept the receipt unseen; its status is ", F.coalesce(f["status"], F.lit("unknown")))
    return F.when(~is_extracted(f), F.when(f["status"] == UNREADABLE, unreadable).otherwise(missing))


def _doubtful(path: Column, f: Column, threshold: float) -> Column:
    low = issue("LOW_CONFIDENCE", WARNING, F.array(path), path, " has confidence ", F.format_number(f["confidence"], 2), f", less than {threshold:.2f}")
    return F.when(is_doubtful(f, threshold), F.when(f["status"] == UNCERTAIN, issue("LOW_CONFIDENCE", WARNING, F.array(path), path, " is marked uncertain")).otherwise(low))


def _line_total(x: Column, i: Column, tolerance: str) -> Column:
    q, u, t = x["quantity"], x["unit_price"], x["line_total"]
    paths = F.array(*[_path(i, n) for n in ITEM_FIELDS[1:]])
    return F.when(line_total_is_off(x, tolerance), issue("LINE_TOTAL_MISMATCH", ERROR, paths, q["value_text"], " times ", u["value_text"], " is ", _plain(q["value"] * u["value"]), ", not ", t["value_text"]))


def _totals(tolerance: str) -> list[Column]:
    subtotal, total = F.col("subtotal"), F.col("total")
    summed, expected, _ = _sums()
    paths = F.transform("line_items", lambda x, i: _path(i, "line_total"))
    items_off = issue("DOCUMENT_TOTAL_MISMATCH", ERROR, F.concat(F.array(F.lit("subtotal")), paths), "the line totals add up to ", _plain(summed), ", not to the subtotal ", subtotal["value_text"])
    sum_off = issue("DOCUMENT_TOTAL_MISMATCH", ERROR, F.array(*map(F.lit, ("subtotal", "tax", "total"))), "subtotal and tax add up to ", _plain(expected), ", not to the total ", total["value_text"])
    total_off = issue("DOCUMENT_TOTAL_MISMATCH", ERROR, F.concat(F.array(F.lit("total")), paths), "the line totals add up to ", _plain(summed), ", not to the total ", total["value_text"], ", and subtotal and tax don't explain it")
    a, b, c = _totals_off(tolerance)
    return [F.when(a, items_off), F.when(b, sum_off).when(c, total_off)]


#: What a bit of issue_mask says.
MISSING, DOUBTFUL, LINE_TOTAL, DOCUMENT_TOTAL, CURRENCY, UNREADABLE_FIELD = 1, 2, 4, 8, 16, 32
# The bits of each review reason, in the reasons' order.
_REASON_BITS = (("low_confidence", DOUBTFUL), ("missing_critical_field", MISSING), ("unreadable_content", UNREADABLE_FIELD), ("validation_error", LINE_TOTAL | DOCUMENT_TOTAL | CURRENCY))


def issue_mask(*, money_tolerance: str = "0.01", allowed_currencies: Collection[str] | None = None, low_confidence_threshold: float = 0.5) -> Column:
    """Which kinds of issues the columns of a receipt have, as bits, without rendering any: 0 is a receipt that ``issues`` finds none in."""
    items = F.col("line_items")
    some = lambda test: F.coalesce(F.exists(items, test), F.lit(False))
    either = lambda *tests: F.greatest(*tests) if len(tests) > 1 else tests[0]
    unreadable = lambda f: F.coalesce(f["status"] == UNREADABLE, F.lit(False))
    missing = lambda f: ~is_extracted(f) & ~unreadable(f)
    critical = lambda test: either(*[test(F.col(n)) for n in ("total", "currency")], some(lambda x: either(*[test(x[n]) for n in ("description", "line_total")])))
    kinds = {
        MISSING: critical(missing), UNREADABLE_FIELD: critical(unreadable),
        DOUBTFUL: either(*[is_doubtful(F.col(n), low_confidence_threshold) for n in DOCUMENT_FIELDS], some(lambda x: either(*[is_doubtful(x[n], low_confidence_threshold) for n in ITEM_FIELDS]))),
        LINE_TOTAL: some(lambda x: line_total_is_off(x, money_tolerance)), DOCUMENT_TOTAL: either(*_totals_off(money_tolerance)),
        CURRENCY: F.lit(False) if allowed_currencies is None else _foreign(allowed_currencies),
    }
    out = F.lit(0)
    for bit, found in kinds.items():
        out = out + F.when(found, bit).otherwise(0)
    return out


def issues(*, money_tolerance: str = "0.01", allowed_currencies: Collection[str] | None = None, low_confidence_threshold: float = 0.5) -> Column:
    """array<ISSUE> over the columns of a receipt, in this order: critical fields, doubtful fields, line totals, document totals, currency.

    Within a rule, document fields come before items, items in order. Without allowed_currencies any will do; an empty set
    allows none. A difference of just money_tolerance is none.
    """
    items = F.col("line_items")
    critical = F.array(*[_critical(F.lit(n), F.col(n)) for n in ("total", "currency")])
    item_critical = F.flatten(F.transform(items, lambda x, i: F.array(*[_critical(_path(i, n), x[n]) for n in ("description", "line_total")])))
    low = F.array(*[_doubtful(F.lit(n), F.col(n), low_confidence_threshold) for n in DOCUMENT_FIELDS])
    item_low = F.flatten(F.transform(items, lambda x, i: F.array(*[_doubtful(_path(i, n), x[n], low_confidence_threshold) for n in ITEM_FIELDS])))
    lines = F.transform(items, lambda x, i: _line_total(x, i, money_tolerance))
    rest = _totals(money_tolerance)
    if allowed_currencies is not None:
        known = sorted(allowed_currencies)
        code = F.col("currency.value")
        rest.append(F.when(_foreign(known), issue("UNSUPPORTED_CURRENCY", ERROR, F.array(F.lit("currency")), "currency ", code, f" isn't one of {', '.join(known) or 'none'}")))
    return F.filter(F.concat(critical, item_critical, low, item_low, lines, F.array(*rest)), lambda x: x.isNotNull())


def decision(found: Column) -> Column:
    """struct<requires_review, reasons, policy_version>: any warning or error asks for review; reasons are distinct and sorted."""
    reason = lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in REASON_OF for v in pair]), x["code"]), F.lit("validation_error"))
    reasons = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x["severity"] != INFO), reason)))
    return let(reasons, lambda x: F.struct((F.size(x) > 0).alias("requires_review"), x.alias("reasons"), F.lit(POLICY_VERSION).alias("policy_version")))


def _whole(receipts: DataFrame) -> DataFrame:
    """A row without line_items counts as one with none."""
    return receipts.withColumn("line_items", F.coalesce("line_items", F.array().cast(receipts.schema["line_items"].dataType)))


def decide(receipts: DataFrame, **settings) -> DataFrame:
    """receipts with the decision that validate gives them, without their issues."""
    df = J.bound(_whole(receipts), _mask=issue_mask(**settings))
    reasons = F.filter(F.array(*[F.when(F.col("_mask").bitwiseAND(bits) > 0, F.lit(reason)) for reason, bits in _REASON_BITS]), lambda x: x.isNotNull())
    made = F.struct((F.col("_mask") > 0).alias("requires_review"), reasons.alias("reasons"), F.lit(POLICY_VERSION).alias("policy_version"))
    return df.withColumn("decision", made).drop("_mask")


def validate(receipts: DataFrame, **settings) -> DataFrame:
    """receipts with validation_issues and decision. A row without line_items counts as one with none."""
    return J.bound(_whole(receipts), validation_issues=issues(**settings)).withColumn("decision", decision(F.col("validation_issues")))


def issue_rows(validated: DataFrame) -> DataFrame:
    """One row per issue: document_id, issue_ord (from 0), code, severity, field_paths, message."""
    return validated.select("document_id", F.posexplode("validation_issues").alias("issue_ord", "i")).select("document_id", "issue_ord", "i.*")
