"""Words of a scanned page become lines, and lines become a receipt by keywords and patterns.

Words of a document meet in one shuffle on document_id, sorted, and are folded to lines in Arrow batches. Lines meet in another; what
follows works on arrays within the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperproof.functions import variant as J
from paperproof.functions.numbers import let, parse_amount, parse_quantity, trailing_amount
from paperproof.functions.text import currency_code, currency_symbol, has_any, normalize_text, stripped
from paperproof.plans.schema import EXTRACTED, LINE_ITEM, NOT_PRESENT, SCHEMA_VERSION, dec_field, text_field

# Words that mark a total, a subtotal and a tax, and the patterns of item lines.
TOTAL = ("gesamtbetrag", "endbetrag", "gesamt", "total", "zu zahlen")
SUBTOTAL = ("zwischensumme", "subtotal", "netto")
TAX = ("mwst", "ust", "steuer", "tax", "vat")
WITH_QUANTITY = r"^(.+?)\s+([0-9]+(?:[.,][0-9]+)?)\s*[x×X]\s*([0-9][0-9.,]*)\s+(-?[0-9][0-9.,]*)\s*\z"
SIMPLE = r"^(.+?)\s+(-?[0-9][0-9.,]*)\s*\z"


LINE = "document_id string, line_idx int, text string, confidence double"


def _folded(tolerance: int):
    """Lines of words that come sorted by document, top and left. One line is held at a time, over batches too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, anchor, at = None, 0, -1
        held: list[tuple[int, str, float]] = []
        out: list[tuple] = []

        def close() -> None:
            if held:
                held.sort(key=lambda w: w[0])  # stable: ties as they came
                out.append((doc, at, " ".join(w[1] for w in held), sum(w[2] for w in held) / len(held)))
                held.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.float64()), strict=True)], names=["document_id", "line_idx", "text", "confidence"])

        for b in batches:
            for d, top, left, text, conf in zip(*(b[c].to_pylist() for c in ("document_id", "top", "left", "text", "conf")), strict=True):
                if d != doc or at < 0 or top - anchor > tolerance:
                    close()
                    at = at + 1 if d == doc else 0
                    doc, anchor = d, top
                held.append((left, text, conf))
            yield made()
        close()
        yield made()

    return run


def lines_from_words(words: DataFrame, *, line_tolerance_px: int = 10) -> DataFrame:
    """words(document_id, word_idx, top, left, text, conf) to document_id, line_idx, text, confidence.

    In order of top and left, a word joins the line whose first word is within the tolerance of it, otherwise begins one. Blank words
    and those of negative or null confidence don't count; a word without a top stands above all, one without a left before all. Words
    stand by left, ties as they came; confidence is their mean.

    Which line a word joins depends on where the lines before it began, so this is a fold: Spark sorts each document's words (and spills), and
    tasks go over them once, in time linear in the words of a page.
    """
    least = F.lit(-(1 << 62))
    place = lambda c: F.coalesce(F.col(c).cast("long"), least).alias(c)
    words = words.select(F.col("document_id").cast("string").alias("document_id"), place("top"), place("left"), "word_idx", stripped(F.col("text")).alias("text"), F.col("conf").cast("double").alias("conf"))
    order = words.where((F.col("text") != "") & (F.col("conf") >= 0)).repartition("document_id").sortWithinPartitions("document_id", "top", "left", "word_idx", "text", "conf")
    return order.drop("word_idx").mapInArrow(_folded(line_tolerance_px), LINE)


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that fits the whole text, by one match; null if it doesn't fit."""
    mark = "\u0001"
    cut = F.split(F.regexp_replace(text, pattern, mark.join(f"${k}" for k in range(1, n + 1))), mark)
    each = F.when(text.rlike(pattern), F.array(*[F.regexp_extract(text, pattern, k) for k in range(1, n + 1)]))  # of the rare text with the mark in it
    return let(F.when(text.contains(mark), each).otherwise(cut), lambda g: F.when(F.size(g) == n, g))


def _items(x: Column) -> Column:
    """A line as an item: with quantity, then without; null if neither pattern fits."""
    dec = lambda p, raw: dec_field(EXTRACTED, p["value"], p["value_text"], raw)
    item = lambda name, q, u, t: F.struct(text_field(EXTRACTED, F.trim(name), x["text"]).alias("description"), q.alias("quantity"), u.alias("unit_price"), t.alias("line_total"))
    read = lambda g: F.when(g.isNotNull(), F.struct(parse_quantity(g[1]).alias("q"), parse_amount(g[2]).alias("u"), parse_amount(g[3]).alias("t")))
    good = lambda p: p["q"]["error"].isNull() & p["u"]["error"].isNull() & p["t"]["error"].isNull()
    full = let(_groups(x["text"], WITH_QUANTITY, 4), lambda g: let(read(g), lambda p: F.when(g.isNotNull() & good(p), item(g[0], dec(p["q"], g[1]), dec(p["u"], g[2]), dec(p["t"], g[3])))))
    plain = let(_groups(x["text"], SIMPLE, 2), lambda g: let(parse_amount(g[1]), lambda a: F.when(g.isNotNull() & a["error"].isNull(), item(g[0], dec_field(NOT_PRESENT), dec_field(NOT_PRESENT), dec(a, x["text"])))))
    return F.coalesce(full, plain)


def extract_baseline(lines: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """lines(document_id, line_idx, text, confidence) to receipts. documents(document_id) adds those without a line.

    Subtotal, tax and total each take the first line with one of their words and an amount at its end that no earlier of the three
    has taken; such lines beyond the first, like all others, may be items. A currency symbol on any line comes before a code; its raw
    text is the line as it came.
    """
    lines = J.bound(lines, _text=normalize_text(F.col("text")))
    lines = J.bound(lines, _amount=trailing_amount(F.col("_text")))
    text, amount = F.col("_text"), F.col("_amount")
    hit = lambda words: has_any(text, words) & amount.isNotNull()
    line = F.struct(F.col("line_idx").alias("i"), text.alias("text"), F.col("text").alias("own"), amount.alias("amount"), hit(SUBTOTAL).alias("s"), hit(TAX).alias("t"), hit(TOTAL).alias("g"), currency_symbol(F.col("text")).alias("symbol"), currency_code(F.col("text")).alias("code"))
    docs = lines.select("document_id", line.alias("x")).groupBy("document_id").agg(F.collect_list("x").alias("x"))
    if documents is not None:
        docs = documents.select("document_id").distinct().join(docs, "document_id", "left")
    docs = docs.withColumn("x", F.array_sort(F.filter(F.coalesce("x", F.array().cast(docs.schema["x"].dataType)), lambda z: z["text"] != "")))
    taken = lambda z, lines: F.coalesce(z["i"].isin(*[y["i"] for y in lines]), F.lit(False))
    first = lambda flag, *lines: F.get(F.filter("x", (lambda z: z[flag] & ~taken(z, lines)) if lines else (lambda z: z[flag])), F.lit(0))
    found = lambda s, t: let(first("g", s, t), lambda g: F.struct(s.alias("subtotal"), t.alias("tax"), g.alias("total")))
    # one value for all three, as columns of their own would be made again for each line that asks whether it is one of them
    docs = docs.withColumn("_found", let(first("s"), lambda s: let(first("t", s), lambda t: found(s, t))))
    slot = lambda n: let(F.col(f"_found.{n}"), lambda y: F.when(y["i"].isNotNull(), dec_field(EXTRACTED, y["amount"]["value"], y["amount"]["value_text"], y["text"])).otherwise(dec_field(NOT_PRESENT)))
    used = lambda z: taken(z, [F.col(f"_found.{n}") for n in ("subtotal", "tax", "total")])
    items = F.filter(F.transform(F.filter("x", lambda z: ~used(z)), _items), lambda y: y.isNotNull())
    symbol = F.get(F.filter("x", lambda z: z["symbol"].isNotNull()), F.lit(0))
    code = F.get(F.filter("x", lambda z: z["code"].isNotNull()), F.lit(0))
    currency = F.when(symbol.isNotNull(), text_field(EXTRACTED, symbol["symbol"], symbol["own"])).when(code.isNotNull(), text_field(EXTRACTED, code["code"], code["own"])).otherwise(text_field(NOT_PRESENT))
    return docs.select(F.lit(SCHEMA_VERSION).alias("schema_version"), "document_id", items.cast(f"array<{LINE_ITEM}>").alias("line_items"), *[slot(n).alias(n) for n in ("subtotal", "tax", "total")], currency.alias("currency"))
