"""Receipts made from order tables: the truth, and predictions that are off in fixed, known ways.

Lines meet their document in one shuffle on the order key, and orders join it on the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperproof.plans.schema import EXTRACTED, NOT_PRESENT, SCHEMA_VERSION, UNCERTAIN, UNREADABLE, dec_field, text_field

MONEY = "decimal(18,2)"
_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, customer, lines (array<struct<descr, q, u, lt>> in a fixed order), subtotal, tax of each order that has lines."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    part = read("part").select("p_partkey", F.col("p_name").alias("descr"), F.col("p_retailprice").cast(MONEY).alias("u"))
    lines = read("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINE_ORDER, "descr", F.col("l_quantity").cast(MONEY).alias("q"), "u"))).alias("lines"))
    own = F.transform("lines", lambda x: F.struct(x["descr"].alias("descr"), x["q"].alias("q"), x["u"].alias("u"), (x["q"] * x["u"]).cast(MONEY).alias("lt")))
    docs = lines.select(F.col("l_orderkey").alias("k"), own.alias("lines"))
    docs = docs.join(read("orders").select("o_orderkey", F.col("o_custkey").alias("customer")), F.col("k") == F.col("o_orderkey")).drop("o_orderkey")
    docs = docs.withColumn("subtotal", F.aggregate("lines", F.lit(0).cast(MONEY), lambda acc, x: (acc + x["lt"]).cast(MONEY)))
    return docs.withColumn("tax", F.when(F.col("k") % 4 != 0, F.round(F.col("subtotal") * F.lit("0.19").cast("decimal(3,2)"), 2).cast(MONEY)))


def _money(value: Column, status="extracted", **more) -> Column:
    return dec_field(status, value, value.cast(MONEY).cast("string"), **more)


def _receipt(docs: DataFrame, items: Column, subtotal: Column, tax: Column, total: Column, currency: Column) -> DataFrame:
    more = [c for c in docs.columns if c in ("g", "source")]
    return docs.select(*more, F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("k").cast("string").alias("document_id"), items.alias("line_items"), subtotal.alias("subtotal"), tax.alias("tax"), total.alias("total"), currency.alias("currency"))


def truth(docs: DataFrame) -> DataFrame:
    item = lambda x: F.struct(text_field(EXTRACTED, x["descr"]).alias("description"), _money(x["q"]).alias("quantity"), _money(x["u"]).alias("unit_price"), _money(x["lt"]).alias("line_total"))
    tax = F.when(F.col("tax").isNull(), dec_field(NOT_PRESENT)).otherwise(_money(F.col("tax")))
    total = F.col("subtotal") + F.coalesce("tax", F.lit(0).cast(MONEY))
    return _receipt(docs, F.transform("lines", item), _money(F.col("subtotal")), tax, _money(total), text_field(EXTRACTED, F.lit("EUR")))


def predictions(docs: DataFrame) -> DataFrame:
    """By h = (31 k + 7 i) mod 23 of line i: 0 a line total 1.00 too large, 1 no quantity, 2 no line total, 3 a doubtful description,
    4 the line is missing, 5 the description in capitals. By k mod 17: 0 no total, 1 unreadable, 2 it is 5 too large, 3 doubtful; 4 and 5 the subtotal is 0.01 or 0.02
    too large. By k mod 19: 7 no tax, 8 EUR in small letters. By customer mod 5: 0 USD, 1 no currency, else EUR. With k mod 13 = 0 the total
    has confidence 0.3."""
    k17, k19, none = F.col("k") % 17, F.col("k") % 19, F.lit(None).cast(MONEY)

    def item(x: Column) -> Column:
        h = x["h"]
        return F.struct(
            text_field(F.when(h == 3, UNCERTAIN).otherwise(EXTRACTED), F.when(h == 5, F.upper(x["descr"])).otherwise(x["descr"])).alias("description"),
            F.when(h == 1, dec_field(NOT_PRESENT)).otherwise(_money(x["q"])).alias("quantity"),
            _money(x["u"]).alias("unit_price"),
            F.when(h == 2, dec_field(NOT_PRESENT)).otherwise(_money((x["lt"] + F.when(h == 0, F.lit(1)).otherwise(F.lit(0))).cast(MONEY))).alias("line_total"),
        )

    lines = F.transform("lines", lambda x, i: F.struct(x["descr"].alias("descr"), x["q"].alias("q"), x["u"].alias("u"), x["lt"].alias("lt"), ((31 * F.col("k") + 7 * i) % 23).alias("h")))
    items = F.transform(F.filter(lines, lambda x: x["h"] != 4), item)
    subtotal = (F.col("subtotal") + F.when(k17 == 4, F.lit("0.01").cast(MONEY)).when(k17 == 5, F.lit("0.02").cast(MONEY)).otherwise(F.lit("0").cast(MONEY))).cast(MONEY)
    tax = F.when(F.col("tax").isNull() | (k19 == 7), dec_field(NOT_PRESENT)).otherwise(_money(F.col("tax")))
    due = (F.col("subtotal") + F.coalesce("tax", F.lit(0).cast(MONEY)) + F.when(k17 == 2, F.lit(5)).otherwise(F.lit(0))).cast(MONEY)
    total = _money(F.when(~k17.isin(0, 1), due).otherwise(none), F.when(k17 == 0, NOT_PRESENT).when(k17 == 1, UNREADABLE).when(k17 == 3, UNCERTAIN).otherwise(EXTRACTED), confidence=F.when(F.col("k") % 13 == 0, 0.3))
    currency = F.when(F.col("customer") % 5 == 1, text_field(NOT_PRESENT)).otherwise(text_field(EXTRACTED, F.when(F.col("customer") % 5 == 0, "USD").when(k19 == 8, "eur").otherwise("EUR")))
    return _receipt(docs, items, _money(subtotal), tax, total, currency)


def pairs(docs: DataFrame) -> DataFrame:
    """document_id, p, g: prediction and truth of each document, made of one row, so that orders are read and gathered once."""
    both = truth(docs.withColumn("source", F.struct("*")))
    both = both.select(F.struct("line_items", "subtotal", "tax", "total", "currency").alias("g"), "source.*")
    return predictions(both).select("document_id", F.struct("line_items", "subtotal", "tax", "total", "currency").alias("p"), "g")
