"""What a corpus of annotations looks like: counts by shape, presence, format, status and error, in one pass and one shuffle.

Each document becomes its counter entries (section, key, subkey, n), which are summed with a partial step on each task, so what is
shuffled is a row for each distinct entry and task. The sums are a profile's state: states of parts of a corpus, or of deliveries one after
the other, add up to that of the whole, and rates and percentiles are read from a state alone.
"""

from __future__ import annotations

import json
from collections.abc import Collection
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperproof.functions import variant as J
from paperproof.functions.numbers import rate
from paperproof.operators.annotation import AMOUNTS, adapter_error, amount_status, number_status, text_status
from paperproof.operators.landing import AMOUNT_KEYS, ITEM_KEYS, OBJECT, as_landed
from paperproof.plans.schema import NOT_ANNOTATED

# Names of the fields whose presence is counted, by section and key of the format.
PRESENCE = (("subtotal", "sub", "subtotal_price"), ("tax", "sub", "tax_price"), ("discount", "sub", "discount_price"), ("service_charge", "sub", "service_price"), ("other_service_charge", "sub", "othersvc_price"), ("subtotal_other", "sub", "etc"), ("total", "tot", "total_price"))
# The profile's own codes of what comes before the adapter's errors.
CODES = {"root not an object": "json_root_not_object", "gt_parse not an object": "missing_or_invalid_gt_parse"}
SECTIONS = ("documents", "line_items", "menu_shape", "document_field_presence", "line_item_field_presence", "adapter_error_details", "document_field_statuses", "line_item_field_statuses", "amount_formats", "quantity_formats", "normalization_errors")


def _entry(section: str, key, subkey=None, n=1) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(F.lit(section).alias("section"), as_col(key).alias("key"), as_col(subkey).alias("subkey"), (n if isinstance(n, Column) else F.lit(n)).cast("bigint").alias("n"))


def _some(section: str, key: str, n: Column) -> Column:
    """An entry of n, if there are any."""
    return F.when(n > 0, _entry(section, key, n=n))


def _count(x: Column, where) -> Column:
    """In how many elements something holds."""
    return F.size(F.filter(x, where))


def _entries(sections: Collection[str]) -> list[Column]:
    """What a landed document adds, as entries of those sections; nulls add nothing."""
    valid, parsed, good = F.col("root") == OBJECT, (F.col("root") == OBJECT) & (F.col("gt") == OBJECT), F.col("error").isNull()
    items = lambda path: F.when(parsed, F.col(f"items.{path}"))  # noqa: E731  an array, read alone from the landed file
    n_items = F.coalesce("n_items", F.lit(0))
    out: dict[str, list[Column]] = {
        "documents": [_entry("documents", "total"), F.when(valid, _entry("documents", "valid_json")), _entry("documents", F.when(good, "adapter_successes").otherwise("adapter_errors")), F.when(valid, _entry("documents", "by_split", F.col("split")))],
        "line_items": [F.when(parsed, _entry("line_items", "total", n=n_items)), F.when(parsed, _entry("line_items", "by_split", F.col("split"), n_items))],
        _VALID: [F.when(valid, _entry("documents", "valid_json"))], _TOTAL: [F.when(parsed, _entry("line_items", "total", n=n_items))],
        "menu_shape": [F.when(parsed, _entry("menu_shape", F.col("menu")))],
        "document_field_presence": [F.when(parsed & (n_items > 0), _entry("document_field_presence", "line_items")), *[F.when(parsed & F.col(f"{c}.{key}.present"), _entry("document_field_presence", name)) for name, c, key in PRESENCE]],
        "line_item_field_presence": [_some("line_item_field_presence", name, _count(items(f"{key}.present"), lambda x: x)) for name, key in ITEM_KEYS],
        HISTOGRAM: [F.when(parsed, _entry(HISTOGRAM, n_items.cast("string")))],
        "adapter_error_details": [F.when(~good, _entry("adapter_error_details", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), F.col("error")), F.col("error"))))],
        "document_field_statuses": [F.when(good, _entry("document_field_statuses", name, status)) for name, status in [*[(name, amount_status(c, key)) for name, c, _, key in AMOUNTS], ("currency", F.lit(NOT_ANNOTATED))]],
    }
    named = lambda section, listed: F.transform(listed, lambda x: _entry(section, x))
    several = lambda section, key, listed: F.transform(listed, lambda x: _entry(section, key, x))
    statuses = []
    for name, key in ITEM_KEYS:
        parts = ("value",) if name == "description" else ("kind", "said", "value")
        each = F.transform(F.arrays_zip(*[F.col(f"items.{key}.{p}").alias(p) for p in parts]), text_status if name == "description" else number_status)
        statuses.append(F.when(good, several("line_item_field_statuses", name, each)))
    listed: dict[str, list[Column]] = {"line_item_field_statuses": statuses}
    amounts = [(c, k) for c, k in [*[("sub", k) for k in AMOUNT_KEYS], ("tot", "total_price")]]
    for what, cells, keys in (("amount", amounts, ("unitprice", "price")), ("quantity", [], ("cnt",))):
        of = lambda part, cells=cells, keys=keys: F.concat(F.array(*[F.when(parsed, F.col(f"{c}.{k}.{part}")) for c, k in cells]), *[F.coalesce(items(f"{k}.{part}"), F.array()) for k in keys])
        listed[f"{what}_formats"] = [named(f"{what}_formats", F.filter(of("format"), lambda x: x.isNotNull()))]
        out["normalization_errors"] = out.get("normalization_errors", []) + [
            _some("normalization_errors", f"{what}_not_string", F.aggregate(F.zip_with(of("present"), of("format"), lambda p, f: (F.coalesce(p, F.lit(False)) & f.isNull()).cast("int")), F.lit(0), lambda a, x: a + x)),
            _some("normalization_errors", f"{what}_unparseable", _count(of("unreadable"), lambda x: x)),
        ]
    own = F.array(*[e for s in sections for e in out.get(s, [])]) if any(s in out for s in sections) else None
    many = [F.coalesce(e, F.array().cast("array<struct<section:string,key:string,subkey:string,n:bigint>>")) for s in sections for e in listed.get(s, [])]
    return [x for x in (own, *many) if x is not None]


#: The histogram of line items per document, a section of the state; its keys are numbers of items.
HISTOGRAM = "items_per_document"
_KEYS = ("section", "key", "subkey")
# The counters that rates are of, alone.
_VALID, _TOTAL = "_valid_json", "_total_items"


def profile_state(annotations: DataFrame, text: str = "ground_truth", order: str | None = None, sections: Collection[str] = (*SECTIONS, HISTOGRAM)) -> DataFrame:
    """section, key, subkey, n of annotations, of texts or landed, batch or stream. With order, first is its least value among the
    documents that an entry was counted in. Of landed files, only the columns that the sections ask for are read."""
    if unknown := set(sections) - {*SECTIONS, HISTOGRAM, _VALID, _TOTAL}:
        raise ValueError(f"no such sections: {sorted(unknown)}")
    df = as_landed(annotations, text)
    if order:
        df = df.withColumn("_order", F.col(order))
    judged = {"documents", "adapter_error_details", "document_field_statuses", "line_item_field_statuses"} & {*sections}
    df = J.bound(df, error=adapter_error()) if judged else df.withColumn("error", F.lit(None).cast("string"))
    entries = F.filter(F.concat(*_entries(sections)), lambda e: e.isNotNull())
    first = [F.min("_order").alias("first")] if order else []
    each = df.select(F.explode(entries).alias("e"), *(["_order"] if order else []))
    return each.select("e.*", *(["_order"] if order else [])).groupBy(*_KEYS).agg(F.sum("n").alias("n"), *first)


def merged_states(*states: DataFrame) -> DataFrame:
    """The state of all that the states were counted on; all have ``first`` or none, and no document is in two."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy(*_KEYS).agg(F.sum("n").alias("n"), *([F.min("first").alias("first")] if "first" in every.columns else []))


def state_rows(state: DataFrame) -> DataFrame:
    """A state's counters with rate, set for presence: of valid documents, or of all line items."""
    # a few hundred rows: the denominators come from among them
    total = lambda s, k: F.max(F.when((F.col("section") == s) & (F.col("key") == k) & F.col("subkey").isNull(), F.col("n"))).over(W.partitionBy())
    counted = state.where(F.col("section") != HISTOGRAM).withColumn("_docs", total("documents", "valid_json")).withColumn("_items", total("line_items", "total"))
    share = F.when(F.col("section") == "document_field_presence", rate(F.col("n"), F.col("_docs"))).when(F.col("section") == "line_item_field_presence", rate(F.col("n"), F.col("_items")))
    return counted.select(*_KEYS, "n", share.alias("rate"), *(["first"] if "first" in state.columns else []))


def state_items(state: DataFrame) -> DataFrame:
    """One row: min, max, mean (3 digits), median, p95 (nearest rank) of line items, from a state's histogram; nulls if it is empty."""
    h = state.where(F.col("section") == HISTOGRAM).select(F.col("key").cast("bigint").alias("v"), "n")
    h = h.withColumn("upto", F.sum("n").over(W.orderBy("v"))).withColumn("all", F.sum("n").over(W.partitionBy()))  # a row for each number of items that occurs
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    median = (at(F.floor((F.col("all") + 1) / 2)) + at(F.floor(F.col("all") / 2) + 1)) / 2
    return h.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.bround(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 3).alias("mean"), median.alias("median"), at(F.floor((F.col("all") * 95 + 99) / 100)).alias("p95"))


def profile_rows(annotations: DataFrame, text: str = "ground_truth", order: str | None = None, sections: Collection[str] = SECTIONS) -> DataFrame:
    """section, key, subkey, n, rate (and first) of annotations, of texts or landed: their state's counters of those sections."""
    of = {"document_field_presence": ("documents", _VALID), "line_item_field_presence": ("line_items", _TOTAL)}
    wanted = [*sections, *(of[s][1] for s in sections if s in of and of[s][0] not in sections)]
    return state_rows(profile_state(annotations, text, order, wanted)).where(F.col("section").isin(*sections))


def items_per_document(annotations: DataFrame, text: str = "ground_truth") -> DataFrame:
    """One row: min, max, mean, median, p95 of line items over documents with a gt_parse object; nulls if there are none."""
    return state_items(profile_state(annotations, text, sections=(HISTOGRAM,)))


def error_examples(annotations: DataFrame, order: str, text: str = "ground_truth", most: int = 50) -> DataFrame:
    """The first ``most`` documents, by ``order``, that the adapter rejects past gt_parse: document_id, error, context: JSON of the
    values that may be why, as they are; a key without any is left out."""
    df = as_landed(annotations, text).withColumn("error", adapter_error()).where(F.col("error").isNotNull() & (F.col("root") == OBJECT) & (F.col("gt") == OBJECT))
    own = F.concat(F.lit("cord-"), F.col("split"), F.lit("-"), F.coalesce("image_id", F.lit("unknown")))
    return df.select(order, own.alias("document_id"), "error", F.col("odd").alias("context")).orderBy(order).limit(most)


def state_report(state: DataFrame) -> dict:
    """A state as nested dicts. Errors stand by number, ties in the order in which they are first met if the state has it, by name without."""
    state = state.sparkSession.createDataFrame(state.collect(), state.schema)  # a few hundred rows, read twice below
    ordered = "first" in state.columns
    out: dict = {}
    first: dict = {}
    for r in state_rows(state).collect():
        first[r.section, r.key] = r["first"] if ordered else r.key
        at = out.setdefault(r.section, {})
        if r.subkey is None:
            at[r.key] = r.n if r.rate is None else {"count": r.n, "rate": r.rate}
        else:
            at.setdefault(r.key, {})[r.subkey] = r.n
    for name in ("normalization_errors", "adapter_error_details"):
        out[name] = dict(sorted(out.get(name, {}).items(), key=lambda kv, name=name: (-kv[1], first[name, kv[0]], kv[0])))
    out.setdefault("line_items", {})["per_document"] = state_items(state).first().asDict()
    return out


def profile_report(annotations: DataFrame, order: str | None = None, text: str = "ground_truth") -> dict:
    """The whole profile as nested dicts, by ``order`` with the first 50 documents that the adapter rejects; only counts and these reach the driver."""
    annotations = as_landed(annotations.select(text, *([order] if order else [])) if text in annotations.columns else annotations, text)
    out = state_report(profile_state(annotations, text, order))
    if order:
        rows = error_examples(annotations, order, text).drop(order).collect()
        out["adapter_error_examples"] = [r.asDict() | {"context": json.loads(r.context)} for r in rows]
    return out


def write_report(report: dict, path: str) -> None:
    """A report as a JSON file with sorted keys; its folder is made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
