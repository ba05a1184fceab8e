"""Annotation JSON, model answers, text lines and page words made from order documents, with every kind of flaw in known places."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperproof.sources.model_client import HttpResponse


def comma(x: Column) -> Column:
    return F.replace(x.cast("string"), F.lit("."), F.lit(","))


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def annotations(docs: DataFrame) -> DataFrame:
    """k, ground_truth. By k mod 29: 0 not JSON, 1 a number as gt_parse, 2 a number as the first price, 3 a listed sub_total, 4 the subtotal
    twice, 5 two subtotals, 6 a dash, 7 no image id, 8 a percentage as total, 9 a number as total. One line item is an object, more are a list."""
    k = F.col("k") % 29
    item = lambda x, i: F.concat(F.lit('{"nm":'), _quoted(F.concat(F.lit("  "), x["descr"])), F.lit(',"cnt":'), _quoted(F.concat(x["q"].cast("int").cast("string"), F.lit(" x"))), F.lit(',"unitprice":'), _quoted(F.concat(F.lit("Rp "), x["u"].cast("string"))), F.lit(',"price":'), F.when((k == 2) & (i == 0), F.lit("5")).otherwise(_quoted(comma(x["lt"]))), F.lit("}"))
    listed = F.array_join(F.transform("lines", item), ",")
    menu = F.when(F.size("lines") == 1, listed).otherwise(F.concat(F.lit("["), listed, F.lit("]")))
    value = _quoted(F.col("subtotal").cast("string"))
    said = F.when(k == 4, F.concat(F.lit("["), value, F.lit(","), value, F.lit("]"))).when(k == 5, F.concat(F.lit("["), value, F.lit(',"7"]'))).when(k == 6, '"-"').otherwise(value)
    tax = F.coalesce(F.concat(F.lit(',"tax_price":'), _quoted(F.col("tax").cast("string"))), F.lit(""))
    sub = F.when(k == 3, '[{"subtotal_price":"1"}]').otherwise(F.concat(F.lit('{"subtotal_price":'), said, tax, F.lit("}")))
    total = F.when(k == 8, '"10%"').when(k == 9, "7").otherwise(_quoted((F.col("subtotal") + F.coalesce("tax", F.lit(0).cast("decimal(18,2)"))).cast("decimal(18,2)").cast("string")))
    split = F.when(F.col("k") % 10 == 8, "valid").when(F.col("k") % 10 == 9, "test").otherwise("train")
    meta = F.concat(F.lit('{"split":'), _quoted(split), F.when(k == 7, "").otherwise(F.concat(F.lit(',"image_id":'), F.col("k").cast("string"))), F.lit("}"))
    whole = F.concat(F.lit('{"gt_parse":{"menu":'), menu, F.lit(',"sub_total":'), sub, F.lit(',"total":{"total_price":'), total, F.lit('}},"meta":'), meta, F.lit("}"))
    return docs.select("k", F.when(k == 0, "{invalid").when(k == 1, '{"gt_parse":5}').otherwise(whole).alias("ground_truth"))


def text_lines(docs: DataFrame) -> DataFrame:
    """document_id, line_idx, text, confidence: items, every other one with a quantity, then subtotal, tax, total; by k mod 7 = 0 a second
    total; with k mod 5 = 0 a code; by k mod 3 a line with a currency code (0), a symbol (1) or none."""
    item = lambda x, i: F.when(i % 2 == 0, F.concat(x["descr"], F.lit(" "), x["q"].cast("int").cast("string"), F.lit(" x "), comma(x["u"]), F.lit(" "), comma(x["lt"]))).otherwise(F.concat(x["descr"], F.lit("  "), comma(x["lt"])))
    due = (F.col("subtotal") + F.coalesce("tax", F.lit(0).cast("decimal(18,2)"))).cast("decimal(18,2)")
    tail = F.array(F.concat(F.lit("Zwischensumme "), comma(F.col("subtotal"))), F.concat(F.lit("MwSt 19% "), comma(F.col("tax"))), F.concat(F.lit("Gesamt "), comma(due)), F.when(F.col("k") % 7 == 0, "Gesamt 99,99"), F.when(F.col("k") % 5 == 0, "Karte  usd  angenommen"), F.when(F.col("k") % 3 == 0, "  in  EUR bezahlt ").when(F.col("k") % 3 == 1, "in   € bezahlt"), F.lit("   "))
    every = F.concat(F.transform("lines", item), F.filter(tail, lambda x: x.isNotNull()))
    return docs.select(F.col("k").cast("string").alias("document_id"), F.posexplode(every).alias("line_idx", "text"), F.lit(90.0).alias("confidence"))


def page_words(docs: DataFrame) -> DataFrame:
    """Words of a page: line i at tops 20 i + 0 to 6, name left and amount right, with a blank and an unreadable word beside them. With
    k mod 4 = 1 lines are just 6 apart, so that words run into the line before; names have two spaces between their words."""
    w = lambda top, left, text, conf: F.struct(top.cast("long").alias("top"), F.lit(left).cast("long").alias("left"), text.alias("text"), conf.cast("double").alias("conf"))
    apart = F.when(F.col("k") % 4 == 1, 6).otherwise(20)
    name = lambda x: F.concat(F.lit(" "), F.replace(x["descr"], F.lit(" "), F.lit("  ")), F.lit("\t"))
    line = lambda x, i: F.array(w(apart * i + F.col("k") % 7, 200, comma(x["lt"]), 80 + F.col("k") % 10), w(apart * i + i % 5, 10, name(x), F.lit(90)), w(apart * i, 5, F.lit("  "), F.lit(99)), w(apart * i, 400, F.lit("?"), F.lit(-1)))
    return docs.select(F.col("k").cast("string").alias("document_id"), F.posexplode(F.flatten(F.transform("lines", line))).alias("word_idx", "w")).select("document_id", "word_idx", "w.*")


def page_files(docs: DataFrame) -> DataFrame:
    """file, value: the pages of about 50 documents, k div 200 for each file, one after the other by k with a form feed between; a page is a word
    of page_words in each line. Pages with k mod 13 = 0 are no images, and files with number mod 7 = 3 break off behind their pages."""
    word = F.concat_ws(",", "top", "left", "conf", "text")
    pages = page_words(docs).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", word.alias("word")))).alias("w"))
    k = F.col("document_id").cast("bigint")
    page = F.struct(k.alias("k"), F.when(k % 13 == 0, "!").otherwise(F.array_join("w.word", "\n")).alias("text"))
    files = pages.groupBy(F.floor(k / 200).alias("file")).agg(F.array_sort(F.collect_list(page)).alias("p"))
    return files.select("file", F.concat(F.array_join("p.text", "\f"), F.when(F.col("file") % 7 == 3, "\f?\fnever").otherwise("")).alias("value"))


def stand_in_cut(content: bytes) -> Iterator[bytes]:
    """The pages of one of page_files."""
    for page in content.rstrip(b"\n").split(b"\f"):
        if page == b"?":
            raise OSError("cut off")
        yield page


def stand_in_ocr(page: bytes) -> dict[str, list]:
    """The words of a page of page_files, as an OCR returns them."""
    if page == b"!":
        raise ValueError("no image")
    return dict(zip(("top", "left", "conf", "text"), map(list, zip(*[x.split(",", 3) for x in page.decode().split("\n")], strict=True)), strict=True))


def model_answers(docs: DataFrame) -> DataFrame:
    """document_id, raw. By k mod 19: 0 an unknown status, 1 not JSON, 2 a lower-case currency, 3 a symbol as currency, 4 a total that is no
    number, 5 an unreadable total, 6 line_items not a list."""
    k = F.col("k") % 19
    field = lambda status, value: F.concat(F.lit('{"status":"'), F.lit(status) if isinstance(status, str) else status, F.lit('","value":'), F.coalesce(_quoted(value), F.lit("null")), F.lit("}"))
    item = lambda x: F.concat(F.lit('{"description":'), field("extracted", x["descr"]), F.lit(',"quantity":'), field("not_present", F.lit(None).cast("string")), F.lit(',"unit_price":'), field("uncertain", comma(x["u"])), F.lit(',"line_total":'), field("extracted", comma(x["lt"])), F.lit("}"))
    items = F.when(k == 6, "7").otherwise(F.concat(F.lit("["), F.array_join(F.transform("lines", item), ","), F.lit("]")))
    due = (F.col("subtotal") + F.coalesce("tax", F.lit(0).cast("decimal(18,2)"))).cast("decimal(18,2)")
    total = F.when(k == 0, field("guessed", comma(due))).when(k == 4, field("extracted", F.lit("n/a"))).when(k == 5, field("unreadable", F.lit(None).cast("string"))).otherwise(field("extracted", comma(due)))
    tax = F.when(F.col("tax").isNull(), field("not_present", F.lit(None).cast("string"))).otherwise(field("extracted", comma(F.col("tax"))))
    code = field("extracted", F.when(k == 2, " eur ").when(k == 3, "€").otherwise("EUR"))
    whole = F.concat(F.lit('{"line_items":'), items, F.lit(',"subtotal":'), field("extracted", comma(F.col("subtotal"))), F.lit(',"tax":'), tax, F.lit(',"total":'), total, F.lit(',"currency":'), code, F.lit("}"))
    return docs.select(F.col("k").cast("string").alias("document_id"), F.when(k == 1, "sorry").otherwise(whole).alias("raw"))


def stand_in_model(url: str, headers: dict[str, str], body: dict) -> HttpResponse:
    """A model's answer without a model: it finds the first total among the lines of the prompt, and the items that have a quantity, whose unit
    prices it isn't sure of. By the digits d of that total, mod 11: 0 a quota error, 1 a page instead of JSON, 2 no candidates, 3 a blank text, 4 no JSON, 5 a list, 6 an unknown status, else a receipt in two parts."""
    prompt = body["contents"][0]["parts"][0]["text"]
    said = re.search(r"^Gesamt ([0-9]+,[0-9]+)$", prompt, re.M)[1]
    kind = int(said.replace(",", "")) % 11
    if kind < 2:
        return HttpResponse(429, {"error": {"message": "quota used up"}}) if kind == 0 else HttpResponse(502, "bad gateway")
    field = lambda status, value=None: {"status": status, "value": value}
    schema = body["generationConfig"]["responseSchema"]
    asked = lambda of, found: {n: found[n] for n in of["required"]}  # noqa: E731  what the schema of the request asks for, and no more
    item = lambda d, q, u, t: asked(schema["properties"]["line_items"]["items"], {"description": field("extracted", d), "quantity": field("extracted", q), "unit_price": field("uncertain", u), "line_total": field("extracted", t), "note": 1})
    items = [item(*x) for x in re.findall(r"^(.+) ([0-9]+) x ([0-9,]+) ([0-9,]+)$", prompt, re.M)]
    receipt = asked(schema, {"line_items": items, "subtotal": field("not_present"), "tax": field("unreadable"), "total": field("guessed" if kind == 6 else "extracted", said), "currency": field("extracted", "eur"), "note": 1})
    text = {3: " ", 4: "I can't", 5: "[1]"}.get(kind, json.dumps(receipt))
    return HttpResponse(200, {"candidates": [] if kind == 2 else [{"content": {"parts": [{"text": text[:9]}, {"text": text[9:]}]}}]})
