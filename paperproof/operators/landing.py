"""Annotations parsed once: each text becomes typed columns (kinds, texts, numbers), which adapter and profile read, and prune.

``landed`` works in flight, batch or stream; ``land`` writes its rows as Parquet, ``read_landed`` reads them. A cell is one value of
the format as a struct: of what kind it is, whether anything is there, its raw text, and what it says.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperproof.functions import variant as J
from paperproof.functions.numbers import DECIMAL, let, parse_grouped_amount, parse_quantity
from paperproof.functions.text import amount_format, is_missing, joined_raw, normalize_text, quantity_format

# The keys of the annotation format by canonical field.
ITEM_KEYS = (("description", "nm"), ("quantity", "cnt"), ("unit_price", "unitprice"), ("line_total", "price"))
AMOUNT_KEYS = ("subtotal_price", "tax_price", "discount_price", "service_price", "othersvc_price")
SUB_KEYS, TOTAL_KEYS = (*AMOUNT_KEYS, "etc"), ("total_price",)
#: What a cell and a section can be.
ABSENT, TEXT, TEXTS, OTHER, OBJECT, OBJECTS = "absent", "text", "texts", "other", "object", "objects"


def _objects(names) -> str:
    return f"struct<{','.join(f'{n}:variant' for n in names)}>"


def _cell(v: Column, absent: dict, text, listed) -> Column:
    """struct<kind, present, raw, ...> of one value, with what ``text`` adds for one text, ``listed`` for an array of texts (null if it isn't one)."""
    made = lambda kind, present, raw, more: F.struct(kind.alias("kind"), present.alias("present"), raw.alias("raw"), *[c.alias(n) for n, c in more.items()])
    return J.by_kind(
        v, made(F.lit(ABSENT), F.lit(False), F.lit(None).cast("string"), absent), lambda t: text(t, lambda more: made(F.lit(TEXT), t != "", t, more)),
        lambda x, ts: listed(ts, lambda more: made(F.when(ts.isNotNull(), TEXTS).otherwise(OTHER), J.is_present(x), joined_raw(ts), more)),
    )


def text_cell(v: Column) -> Column:
    """And value: the texts that say something, as one."""
    said = lambda ts: F.filter(F.transform(ts, normalize_text), lambda x: ~x.isin("", "-"))
    text = lambda t, cell: let(normalize_text(t), lambda x: cell({"value": F.when(~x.isin("", "-"), x)}))
    return _cell(v, {"value": F.lit(None).cast("string")}, text, lambda ts, cell: let(said(ts), lambda x: cell({"value": F.when(F.size(x) > 0, F.array_join(x, " "))})))


def _number_cell(v: Column, parse, form, skip_percent: bool) -> Column:
    """And said (texts that aren't missing), value and value_text (the number that all readable texts agree on, percentages apart), format and
    unreadable (of a single text, whatever it is)."""
    none = lambda kind: F.lit(None).cast(kind)
    passed = lambda x: x.contains("%") if skip_percent else F.lit(False)

    def text(t: Column, cell) -> Column:
        value = lambda p, n: F.when(~passed(t), p[n])  # noqa: E731  a missing text has no number
        there = t != ""
        return let(parse(t), lambda p: cell({"said": F.when(is_missing(t), 0).otherwise(1), "value": value(p, "value"), "value_text": value(p, "value_text"), "format": F.when(there, form(t)), "unreadable": F.when(there, p["error"].isNotNull())}))

    def listed(ts: Column, cell) -> Column:
        one = lambda x: F.struct(is_missing(x).alias("missing"), passed(x).alias("passed"), parse(x).alias("p"))
        read = lambda t: F.filter(t, lambda x: ~x["missing"] & ~x["passed"] & x["p"]["error"].isNull())
        agreed = lambda r: F.when(F.size(F.array_distinct(F.transform(r, lambda x: x["p"]["value"]))) == 1, F.get(r, F.lit(0))["p"])
        whole = lambda t: let(let(read(t), agreed), lambda n: cell({"said": F.size(F.filter(t, lambda x: ~x["missing"])), "value": n["value"], "value_text": n["value_text"], "format": none("string"), "unreadable": none("boolean")}))
        return let(F.transform(ts, one), whole)

    absent = {"said": F.size(F.lit(None).cast("array<string>")), "value": none(DECIMAL), "value_text": none("string"), "format": none("string"), "unreadable": none("boolean")}
    return _cell(v, absent, text, listed)


def amount_cell(v: Column) -> Column:
    return _number_cell(v, parse_grouped_amount, amount_format, skip_percent=True)


def quantity_cell(v: Column) -> Column:
    return _number_cell(v, parse_quantity, quantity_format, skip_percent=False)


def _there_cell(v: Column) -> Column:
    return F.struct(J.is_present(v).alias("present"))


def _item_cells(x: Column) -> Column:
    amounts = F.transform(F.array(x["unitprice"], x["price"]), amount_cell)  # each rule is one expression, however many values it reads
    return let(amounts, lambda a: F.struct(text_cell(x["nm"]).alias("nm"), quantity_cell(x["cnt"]).alias("cnt"), a[0].alias("unitprice"), a[1].alias("price")))


def _odd_value(v: Column, i: Column, key: str) -> Column:
    return F.when(~J.absent(v) & ~J.is_text(v), F.struct(i.alias("index"), F.lit(key).alias("field"), v.alias("value")))


def _odd(items: Column) -> Column:
    """JSON of what may be wrong with the values of a document, as they are; a key without any is left out. Where cells say that nothing is, values aren't asked."""
    strange = F.exists("items", lambda c: reduce(or_, [~c[key]["kind"].isin(ABSENT, TEXT) for _, key in ITEM_KEYS]))
    listed = F.filter(F.flatten(F.transform(items, lambda x, i: F.array(*[_odd_value(x[key], i, key) for _, key in ITEM_KEYS]))), lambda e: e.isNotNull())
    unusual = lambda v, c: v.isNotNull() & ((c["kind"] != TEXT) | ((c["said"] == 0) & (normalize_text(c["raw"]) == "-")))

    def shown(c: str, keys) -> Column:
        some = F.filter(F.array(*[F.when(unusual(F.col(f"{c}_in.{k}"), F.col(f"{c[1:]}.{k}")), F.struct(F.lit(k).alias("k"), F.col(f"{c}_in.{k}").alias("v"))) for k in keys]), lambda e: e.isNotNull())
        return F.when(F.col(f"{c}_in").isNotNull(), let(some, lambda x: F.when(F.size(x) > 0, F.try_parse_json(F.to_json(F.map_from_entries(x)))))).when(~J.absent(F.col(c)), F.col(c))

    return F.to_json(F.struct(F.when(strange, listed).alias("non_string_item_fields"), shown("_sub", AMOUNT_KEYS).alias("sub_total"), shown("_tot", TOTAL_KEYS).alias("total")))


def landed(df: DataFrame, text: str = "ground_truth") -> DataFrame:
    """df without the text and with its typed columns:

    root (null unless JSON), gt, meta, sub_is, tot_is: what the sections are; split, image_id; menu (its shape) and n_items, items (cells by key; null
    unless the menu is none, an object or a list of objects), sub and tot (cells by key); sub_json, tot_json: listed sections as they
    are; odd: JSON of values that may be wrong. Null or malformed text has a null root. Row-local.
    """
    own = [c for c in df.columns if c != text]
    inside = lambda v, names: F.try_variant_get(v, "$", _objects(names))
    keys = [k for _, k in ITEM_KEYS]
    df = J.bound(df, _root=J.parse_json(F.col(text)))
    df = J.bound(df, _r=inside(F.col("_root"), ("gt_parse", "meta")))
    df = df.select(*own, "_root", "_r", F.col("_r.gt_parse").alias("_gt"), F.col("_r.meta").alias("_meta"))
    df = J.bound(df, _g=inside(F.col("_gt"), ("menu", "sub_total", "total")), _m=inside(F.col("_meta"), ("split", "image_id")))
    df = df.select("*", F.col("_g.menu").alias("_menu"), F.col("_g.sub_total").alias("_sub"), F.col("_g.total").alias("_tot"))
    df = J.bound(df, _one=inside(F.col("_menu"), keys), _many=F.try_variant_get("_menu", "$", f"array<{_objects(keys)}>"), _sub_in=inside(F.col("_sub"), SUB_KEYS), _tot_in=inside(F.col("_tot"), TOTAL_KEYS))
    none = F.array().cast(f"array<{_objects(keys)}>")
    whole = F.coalesce(F.forall("_many", lambda x: x.isNotNull()), F.lit(False))
    listed = F.when(J.absent(F.col("_menu")), none).when(F.col("_one").isNotNull(), F.array("_one")).when(whole, F.col("_many"))
    shape = F.when(J.absent(F.col("_menu")), "missing").when(F.col("_one").isNotNull(), "object").when(whole, "list").when(J.elements(F.col("_menu")).isNotNull(), "invalid_list").otherwise("invalid")
    section = lambda c: F.when(J.absent(F.col(c)), ABSENT).when(F.col(f"{c}_in").isNotNull(), OBJECT).when(J.is_objects(F.col(c)), OBJECTS).otherwise(OTHER)
    split = F.when(F.is_variant_null("_m.split"), "None").otherwise(F.coalesce(J.text_at(F.col("_m.split"), "$"), F.lit("unknown")))
    df = J.bound(df, _listed=listed, menu=F.when(F.col("_g").isNotNull(), shape), sub_is=section("_sub"), tot_is=section("_tot"))
    as_is = lambda c: F.when(F.col(f"{c}_is") == OBJECTS, F.to_json(F.col(f"_{c}")))
    amounts = F.transform(F.array(*[F.col(f"_sub_in.{k}") for k in AMOUNT_KEYS], *[F.col(f"_tot_in.{k}") for k in TOTAL_KEYS]), amount_cell)
    cells = J.bound(df, items=F.transform("_listed", _item_cells), _amounts=amounts)
    amount = lambda keys, first: [F.get("_amounts", F.lit(first + i)).alias(k) for i, k in enumerate(keys)]
    sub = F.when(F.col("_sub_in").isNotNull(), F.struct(*amount(AMOUNT_KEYS, 0), _there_cell(F.col("_sub_in.etc")).alias("etc")))
    cells = cells.withColumn("sub", sub).withColumn("tot", F.when(F.col("_tot_in").isNotNull(), F.struct(*amount(TOTAL_KEYS, len(AMOUNT_KEYS)))))
    return cells.select(
        *own, F.when(F.col("_root").isNotNull(), F.when(F.col("_r").isNotNull(), OBJECT).otherwise(OTHER)).alias("root"), F.when(F.col("_g").isNotNull(), OBJECT).otherwise(OTHER).alias("gt"),
        F.when(J.absent(F.col("_meta")), ABSENT).when(F.col("_m").isNotNull(), OBJECT).otherwise(OTHER).alias("meta"), F.when(F.col("_m").isNotNull(), split).otherwise("unknown").alias("split"), J.text_at(F.col("_m.image_id"), "$").alias("image_id"),
        "menu", F.when(F.col("_listed").isNotNull(), F.size("_listed")).alias("n_items"), "items", "sub_is", "sub", "tot_is", "tot", as_is("sub").alias("sub_json"), as_is("tot").alias("tot_json"), F.when(F.col("_g").isNotNull(), _odd(F.col("_listed"))).alias("odd"),
    )


COLUMNS = ("root", "gt", "meta", "split", "image_id", "menu", "n_items", "items", "sub_is", "sub", "tot_is", "tot", "sub_json", "tot_json", "odd")


def is_landed(df: DataFrame) -> bool:
    return set(COLUMNS) <= set(df.columns)


def as_landed(df: DataFrame, text: str = "ground_truth") -> DataFrame:
    """df itself if it has the typed columns already."""
    return df if is_landed(df) else landed(df, text)


def land(annotations: DataFrame, path: str, *, text: str = "ground_truth", mode: str = "append") -> None:
    """Write annotations' typed columns, and their own but the text, as Parquet; a new delivery is appended."""
    landed(annotations, text).write.mode(mode).parquet(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path)
    if not is_landed(found):
        raise ValueError(f"{path} holds no landed annotations")
    return found
