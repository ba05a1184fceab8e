"""Queries over the receipt operators, each with production parameters over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperproof.cli import manifest_report
from paperproof.functions import numbers as N
from paperproof.functions import text as X
from paperproof.functions import variant as J
from paperproof.operators import annotation as A
from paperproof.operators import canonical as C
from paperproof.operators import evaluate as E
from paperproof.operators import landing as LA
from paperproof.operators import model_json as M
from paperproof.operators import ocr_lines as L
from paperproof.operators import profile as P
from paperproof.operators import validate as V
from paperproof.plans import receipts as R
from paperproof.plans import schema as S
from paperproof.plans import texts as T
from paperproof.sources import images as I
from paperproof.sources import model_client as MC
from paperproof.sources.shared import made_once, new_path, path_made_once

ALLOWED = ("EUR",)
#: The tables that order documents are made of.
SOURCES = ("orders", "lineitem", "part")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text and numbers ---


@query
def normalize_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("normal"), X.is_missing(F.col("text")).alias("missing"))


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, raw: number texts of many kinds, one for each order."""
    k = F.col("o_orderkey").cast("string")
    kinds = [F.concat(k, F.lit(",000")), F.concat(F.lit("Rp "), k, F.lit(".50")), F.concat(F.lit("-"), k, F.lit(",5 EUR")), F.concat(F.lit("1."), k), F.concat(F.lit("x"), k), F.concat(k, F.lit(" x")), F.lit("EUR"), F.concat(F.lit("1.234."), k), F.concat(k, F.lit(".")), F.concat(F.lit("1,"), k, F.lit(".25")), F.concat(F.lit("1.2.3"), k), F.concat(F.lit("+00"), k), F.lit("-")]
    n = F.col("o_orderkey") % len(kinds)
    raw = F.when(n == 0, kinds[0])
    for i, kind in enumerate(kinds[1:], 1):
        raw = raw.when(n == i, kind)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), raw.alias("raw"))


def _numbers(parse):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = number_texts(spark, sf_dir).withColumn("got", parse(F.col("raw")))
        return got.select("k", "raw", F.col("got.value").cast("double").alias("value"), F.col("got.value_text").alias("value_text"), F.col("got.error").alias("error"))

    return run


QUERIES |= {"parse_amount_grouped": _numbers(N.parse_grouped_amount), "parse_amount_eu": _numbers(N.parse_amount), "parse_quantity": _numbers(N.parse_quantity)}


@query
def amount_format_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_texts(spark, sf_dir).groupBy(X.amount_format(F.col("raw")).alias("format")).agg(F.count("*").alias("n"))


@query
def quantity_format_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_texts(spark, sf_dir).groupBy(X.quantity_format(F.col("raw")).alias("format")).agg(F.count("*").alias("n"))


# --- validation ---


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.predictions(R.order_documents(spark, sf_dir))


def found_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.issue_rows(V.validate(predicted(spark, sf_dir), allowed_currencies=ALLOWED))


@query
def critical_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_issues(spark, sf_dir).where(F.col("code").isin("MISSING_CRITICAL_FIELD", "UNREADABLE_CRITICAL_FIELD")).select("document_id", "code", F.get("field_paths", F.lit(0)).alias("field_path"), "message")


@query
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_issues(spark, sf_dir).where("code = 'LOW_CONFIDENCE'").select("document_id", F.get("field_paths", F.lit(0)).alias("field_path"), "message")


@query
def line_total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_issues(spark, sf_dir).where("code = 'LINE_TOTAL_MISMATCH'").select("document_id", F.array_join("field_paths", ",").alias("field_paths"), "message")


@query
def doc_total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_issues(spark, sf_dir).where("code = 'DOCUMENT_TOTAL_MISMATCH'").select("document_id", F.get("field_paths", F.lit(0)).alias("first_path"), F.size("field_paths").cast("bigint").alias("n_paths"), "message")


@query
def currency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_issues(spark, sf_dir).where("code = 'UNSUPPORTED_CURRENCY'").select("document_id", "message")


@query
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.validate(predicted(spark, sf_dir), allowed_currencies=ALLOWED)
    return v.select("document_id", F.col("decision.requires_review").alias("requires_review"), F.array_join("decision.reasons", ",").alias("reasons"), F.size("validation_issues").cast("bigint").alias("n_issues"))


@query
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.decide(predicted(spark, sf_dir), allowed_currencies=ALLOWED)
    return v.select(F.explode("decision.reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("documents"))


# --- evaluation ---


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evaluate_pairs(R.pairs(R.order_documents(spark, sf_dir)), allowed_currencies=ALLOWED)


@query
def unmatched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all documents but every eleventh against the truth of all but every seventh."""
    docs = R.order_documents(spark, sf_dir)
    return E.unmatched(R.predictions(docs.where("k % 11 <> 0")), R.truth(docs.where("k % 7 <> 0")))


@query
def receipt_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).select("document_id", S.as_json().alias("json"))


@query
def item_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = R.pairs(R.order_documents(spark, sf_dir))
    return both.select("document_id", F.explode(E.pair_scores(F.col("p.line_items"), F.col("g.line_items"))).alias("m")).select("document_id", F.col("m.p").cast("bigint").alias("p"), F.col("m.g").cast("bigint").alias("g"), (-F.col("m.neg")).cast("bigint").alias("score"))


@query
def item_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluations(spark, sf_dir).select("document_id", F.explode("matches").alias("m")).select("document_id", F.col("m.p").cast("bigint").alias("p"), F.col("m.g").cast("bigint").alias("g"))


@query
def pr_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluations(spark, sf_dir).select("document_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "fully_correct")


@query
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.field_rates(evaluations(spark, sf_dir)).select("field_path", "evaluable", F.round("accuracy", 9).alias("accuracy"), F.round("exact_match_rate", 9).alias("exact_match_rate"))


@query
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.report(evaluations(spark, sf_dir))
    maps = [F.round(F.element_at(m, n), 9).alias(f"{n}_{short}") for m, short in (("field_accuracy", "accuracy"), ("field_exact_match_rate", "exact")) for n in E.DOCUMENT_FIELDS]
    return r.select("documents", *maps, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "arithmetic_consistency_rate", "coverage", "false_accept_rate")])


# --- adapters, profile, lines of text ---


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of all orders, landed: parsed once for the queries on them, and again when the tables' files change."""
    sources = [f"{sf_dir}/{t}.parquet" for t in SOURCES]
    return made_once(spark, "annotations", sources, lambda path: LA.land(T.annotations(R.order_documents(spark, sf_dir)), path))


def _flat(field: str) -> list:
    return [F.col(f"{field}.status").alias(f"{field}_status"), F.col(f"{field}.value").cast("double").alias(field)]


@query
def annotation_adapt(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.adapt_annotations(annotated(spark, sf_dir)).where("error IS NULL")
    summed = F.aggregate("line_items", F.lit(0.0), lambda acc, x: acc + x["line_total"]["value"].cast("double"))
    names = F.array_join(F.transform("line_items", lambda x: x["description"]["value"]), "|")
    quantities = F.aggregate("line_items", F.lit(0.0), lambda acc, x: acc + x["quantity"]["value"].cast("double"))
    return a.select("k", "document_id", F.size("line_items").cast("bigint").alias("n_items"), names.alias("names"), summed.alias("summed"), quantities.alias("quantities"), *_flat("subtotal"), *_flat("tax"), *_flat("total"), *[F.col(f"{n}.raw_text").alias(f"{n}_raw") for n in ("subtotal", "tax", "total")])


@query
def annotation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.adapt_annotations(annotated(spark, sf_dir)).where("error IS NOT NULL").select("k", "error")


@query
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile_rows(annotated(spark, sf_dir))


@query
def profile_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile_rows(annotated(spark, sf_dir), sections=("document_field_presence", "line_item_field_presence")).select("section", "key", "n", "rate")


@query
def profile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile_rows(annotated(spark, sf_dir), sections=("document_field_statuses", "line_item_field_statuses")).select("key", "subkey", "n")


@query
def profile_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.items_per_document(annotated(spark, sf_dir))
    return d.select(*[F.col(c).cast("bigint").alias(f"{c}_items") for c in ("min", "max", "p95")], F.col("mean").alias("mean_items"), F.col("median").alias("median_items"))


@query
def error_examples_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.error_examples(annotated(spark, sf_dir), "k").select("k", "document_id", "error", "context")


def delivered(spark: SparkSession, sf_dir: str) -> dict:
    """The manifest of annotation files in three deliveries, by k mod 3, of which the second comes first; rows stand by k."""
    write = lambda path: T.annotations(R.order_documents(spark, sf_dir)).orderBy("k").select("ground_truth", (F.col("k") % 3).alias("delivery")).write.partitionBy("delivery").parquet(path)
    at = path_made_once(spark, "deliveries", [f"{sf_dir}/{t}.parquet" for t in SOURCES], write)
    return {"dataset": "orders", "parquet_files": [{"url": f"{at}/delivery={d}", "size": 1000 + d} for d in (1, 0, 2)]}


def _leaves(x, path: str = "") -> Iterator[tuple[str, str, int | None]]:
    """path, JSON text and place among its like of each value of a report; contexts of examples are values."""
    if isinstance(x, dict) and not path.endswith("/context"):
        ranked = path in ("/normalization_errors", "/adapter_error_details")
        for place, (key, value) in enumerate(x.items()):
            yield from ((p, v, place if ranked else None) for p, v, _ in _leaves(value, f"{path}/{key}")) if ranked else _leaves(value, f"{path}/{key}")
    elif isinstance(x, list) and path == "/adapter_error_examples":
        for i, value in enumerate(x):
            yield from _leaves(value, f"{path}/{i}")
    else:
        yield path, json.dumps(x, ensure_ascii=False, separators=(",", ":")), None


@query
def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the command, of files that a manifest names: each value with its path, and errors with their place by number, then by who is met first."""
    return spark.createDataFrame(list(_leaves(manifest_report(spark, delivered(spark, sf_dir)))), "path string, value string, place long")


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.extract_baseline(T.text_lines(R.order_documents(spark, sf_dir)))


@query
def baseline_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline(spark, sf_dir).select("document_id", *[F.col(f"{n}.value").cast("double").alias(n) for n in ("subtotal", "tax", "total")], F.size("line_items").cast("bigint").alias("n_items"))


@query
def baseline_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.bound(baseline(spark, sf_dir).select("document_id", "line_items"), items=F.col("line_items"))  # else each column below would make the items again
    i = found.select("document_id", F.posexplode("items").alias("idx", "x"))
    return i.select("document_id", F.col("idx").cast("bigint").alias("idx"), F.col("x.description.value").alias("description"), *[F.col(f"x.{n}.value").cast("double").alias(n) for n in ("quantity", "unit_price", "line_total")])


@query
def currency_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline(spark, sf_dir).select("document_id", F.col("currency.value").alias("currency"), F.col("currency.raw_text").alias("raw_text"))


@query
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.lines_from_words(T.page_words(R.order_documents(spark, sf_dir)))
    return found.select("document_id", F.col("line_idx").cast("bigint").alias("line_idx"), "text", "confidence")


@query
def ocr_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ocr_lines, of pages whose words come as parallel arrays."""
    words = T.page_words(R.order_documents(spark, sf_dir)).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "top", "left", "text", "conf"))).alias("w"))
    pages = words.select("document_id", *[F.col(f"w.{c}").alias(c) for c in ("top", "left", "text", "conf")])
    found = L.lines_from_words(I.words_from_columns(pages))
    return found.select("document_id", F.col("line_idx").cast("bigint").alias("line_idx"), "text", "confidence")


@query
def image_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and errors of files of many pages each, by the image source with a stand-in OCR; what was read of a page is written once."""
    write = lambda path: T.page_files(R.order_documents(spark, sf_dir)).repartition("file").write.partitionBy("file").text(path)
    at = path_made_once(spark, "page-files", [f"{sf_dir}/{t}.parquet" for t in SOURCES], write)
    found = I.read_image_lines(spark, f"{at}/file=*", ocr=T.stand_in_ocr, cut=T.stand_in_cut)
    file = F.regexp_extract("document_id", r"/file=(\d+)/[^/]*$", 1).cast("bigint")
    return found.select(file.alias("file"), *[F.col(c).cast("bigint").alias(c) for c in ("page", "line_idx")], "text", "confidence", "error")


@query
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts by prompt, call and adapter, of a stand-in model that fails in every known way; its answers are kept in a store and read back."""
    lines = T.text_lines(R.order_documents(spark, sf_dir))
    m = MC.extract_with_model(lines, url="https://model.invalid/", api_key="none", http_post=T.stand_in_model, store=new_path(spark, "answers"))
    summed = lambda name: F.round(F.aggregate("line_items", F.lit(0.0), lambda acc, x: acc + x[name]["value"].cast("double")), 2)
    names = F.array_join(F.transform("line_items", lambda x: x["description"]["value"]), "|")
    doubtful = F.size(F.filter("line_items", lambda x: x["unit_price"]["status"] == S.UNCERTAIN)).cast("bigint")
    sums = [summed(n).alias(f"summed_{n}") for n in ("quantity", "unit_price", "line_total")]
    return m.select("document_id", "error", F.size("line_items").cast("bigint").alias("n_items"), names.alias("names"), *sums, doubtful.alias("doubtful"), *_flat("total"), F.col("currency.value").alias("currency"))


@query
def model_json_adapt(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.adapt_model_json(T.model_answers(R.order_documents(spark, sf_dir)))
    return m.select("document_id", "error", F.size("line_items").cast("bigint").alias("n_items"), *_flat("tax"), *_flat("total"), F.col("currency.status").alias("currency_status"), F.col("currency.value").alias("currency"), F.col("total.raw_text").alias("total_raw"), F.col("currency.raw_text").alias("currency_raw"))


@query
def receipt_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constraints of the format hold for whatever the operators make; predictions whose fields were changed afterwards break each of them
    but those of evidence: by k mod 5 = 0 a small currency, mod 7 = 3 a confidence of 1.5, mod 11 = 4 a subtotal that isn't present, mod 13 = 5
    an unknown status of the total, mod 9 = 2 a tax without a value, mod 17 = 6 an empty id, mod 19 = 1 another version, mod 3 = 1 no first quantity."""
    k = F.col("document_id").cast("bigint")
    changed = lambda n, part, where, to: F.col(n).withField(part, F.when(where, to).otherwise(F.col(f"{n}.{part}")))
    broken = predicted(spark, sf_dir).withColumns({
        "currency": changed("currency", "value", k % 5 == 0, F.lower("currency.value")), "total": changed("total", "confidence", k % 7 == 3, F.lit(1.5)), "subtotal": changed("subtotal", "status", k % 11 == 4, F.lit(S.NOT_PRESENT)),
        "tax": changed("tax", "value", k % 9 == 2, F.lit(None)), "line_items": F.transform("line_items", lambda x, i: x.withField("quantity", x["quantity"].withField("status", F.when((k % 3 == 1) & (i == 0), F.lit(S.NOT_PRESENT)).otherwise(x["quantity"]["status"])))),
    }).withColumn("total", changed("total", "status", k % 13 == 5, F.lit("guessed")))
    kept = broken.withColumn("k", k).withColumns({"document_id": F.when(F.col("k") % 17 == 6, "").otherwise(F.col("document_id")), "schema_version": F.when(F.col("k") % 19 == 1, "0.2.0").otherwise(F.col("schema_version"))})
    return kept.select("k", F.explode(S.faults()).alias("fault"))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, raw: predictions as canonical JSON, broken in known ways, some of which are allowed."""
    made = predicted(spark, sf_dir).select(F.col("document_id").alias("id"), S.as_json().alias("raw"))
    k = F.col("id").cast("bigint") % 23
    broken = F.when(k == 0, F.substring("raw", 2, 1 << 30)).when(k == 1, F.regexp_replace("raw", '"currency":', '"curency":')).when(k == 2, F.regexp_replace("raw", '^\\{', '{"more":1,')).when(k == 3, F.regexp_replace("raw", '"0.1.0"', '"9"'))
    broken = broken.when(k == 4, F.regexp_replace("raw", '"status":"extracted"', '"status":"guessed"')).when(k == 5, F.regexp_replace("raw", '"schema_version":"0.1.0",', "")).when(k == 6, "[]").when(k == 7, F.regexp_replace("raw", '"document_id":"[0-9]+"', '"document_id":5'))
    for at, was, now in ((8, '"confidence":null', '"confidence":1.5'), (9, '"raw_text":null', '"raw_text":3'), (10, '"status":"not_present",', ""), (11, '"evidence":[]', '"evidence":[{"text":"a","page":0}]'), (12, '"evidence":[]', '"evidence":[{"text":"a","page":1}]'), (13, '"quantity":', '"qty":'), (15, '"value":null', '"value":"1"')):
        broken = broken.when(k == at, F.replace("raw", F.lit(was), F.lit(now)))
    return made.select("id", broken.when(k == 14, F.regexp_replace("raw", '"value":"([0-9.]+)"', '"value":$1')).otherwise(F.col("raw")).alias("raw"))


@query
def schema_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = C.read_receipts(canonical(spark, sf_dir))
    return read.select("id", "schema_valid", "document_id", F.size("line_items").cast("bigint").alias("n_items"), F.col("total.value").cast("double").alias("total"))


@query
def schema_valid_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.schema_valid_rate(C.read_receipts(canonical(spark, sf_dir)))
    return r.select("documents", "valid", F.round("rate", 9).alias("rate"))
