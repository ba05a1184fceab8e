"""Predictions against ground truth: fields, line items by greedy matching, and the report over all documents.

One join on document_id; all else is within the row, then one global aggregate with a partial step on each task. Matching reads the
items' keys in Arrow batches; all other work is native.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperproof.functions.text import fold, normalize_text, same_text
from paperproof.operators.validate import DOCUMENT_TOTAL, LINE_TOTAL, issue_mask
from paperproof.plans.schema import DOCUMENT_FIELDS, ITEM_FIELDS, NOT_ANNOTATED, is_extracted

CORRECT, INCORRECT, NOT_EVALUABLE = "correct", "incorrect", "not_evaluable"
WEIGHTS = {"description": 2, "line_total": 2, "quantity": 1, "unit_price": 1}  # fixed values: what a right field says for a match
TEXT_FIELDS = ("description", "currency")


def outcome(p: Column, g: Column, text: bool) -> Column:
    here, there = is_extracted(p), is_extracted(g)
    same = same_text(p["value"], g["value"]) if text else p["value"] == g["value"]
    return F.when(g["status"] == NOT_ANNOTATED, NOT_EVALUABLE).when(~here & ~there, CORRECT).when(here != there, INCORRECT).when(same, CORRECT).otherwise(INCORRECT)


def compare_field(p: Column, g: Column, path: str, text: bool) -> Column:
    """struct<field_path, outcome, exact_match>. What the truth doesn't annotate can't be judged; absent on both sides is right."""
    here, there = is_extracted(p), is_extracted(g)
    exact = F.when(g["status"] == NOT_ANNOTATED, F.lit(None).cast("boolean")).when(~here & ~there, True).when(here != there, False).otherwise(p["value"] == g["value"])
    return F.struct(F.lit(path).alias("field_path"), outcome(p, g, text).alias("outcome"), exact.alias("exact_match"))


def score(p: Column, g: Column) -> Column:
    """How much two line items agree, 0 to 6."""
    out = F.lit(0)
    for name, weight in WEIGHTS.items():
        out = out + F.when(outcome(p[name], g[name], name in TEXT_FIELDS) == CORRECT, weight).otherwise(0)
    return out


def pair_scores(predicted: Column, truth: Column) -> Column:
    """array<struct<neg, p, g>> of all pairs of two item arrays that agree in something, best first, ties by position."""
    pairs = F.flatten(F.transform(predicted, lambda x, i: F.transform(truth, lambda y, j: F.struct((-score(x, y)).alias("neg"), i.alias("p"), j.alias("g")))))
    return F.array_sort(F.filter(pairs, lambda z: z["neg"] < 0))


def _keys(items: Column, name: str, truth: bool) -> Column:
    """An array of texts, one for each item: two items agree in a field where these are equal. Null agrees with nothing."""

    def key(x: Column) -> Column:
        f = x[name]
        value = fold(normalize_text(f["value"])) if name in TEXT_FIELDS else f["value"].cast("string")
        there = F.when(is_extracted(f), F.concat(F.lit("="), value)).otherwise("")
        return F.when(f["status"] != NOT_ANNOTATED, there) if truth else there

    return F.transform(items, key)


# The fields that can agree, by what that scores, best first.
_AGREEING = sorted(((sum(WEIGHTS[n] for n in some), tuple(i for i, n in enumerate(WEIGHTS) if n in some)) for k in range(1, 5) for some in combinations(WEIGHTS, k)), key=lambda x: -x[0])


def assigned(predicted: Sequence[list[str]], truth: Sequence[list[str | None]]) -> list[tuple[int, int, int]]:
    """(score, p, g) of a greedy matching of two item lists, each given as its fields' keys: the best score first, then the least p, then
    the least g. The truth's items stand in an index by the keys of each set of fields; what is left at a score agrees in no
    more, so each item asks the indexes of just that score, and no pairs are formed."""
    n_p, n_g = len(predicted[0]) if predicted else 0, len(truth[0]) if truth else 0
    if not n_p or not n_g:
        return []
    free_p, free_g = bytearray(b"\1") * n_p, bytearray(b"\1") * n_g
    out, left = [], min(n_p, n_g)
    for score in range(_AGREEING[0][0], 0, -1):
        indexes = []
        for fields in (f for s, f in _AGREEING if s == score):
            index: dict[tuple, list[int]] = {}
            for g in range(n_g - 1, -1, -1):
                if free_g[g]:
                    key = tuple(truth[f][g] for f in fields)
                    if None not in key:
                        index.setdefault(key, []).append(g)  # the least last
            indexes.append((fields, index))
        for p in range(n_p):
            if not free_p[p]:
                continue
            best, where = n_g, None
            for fields, index in indexes:
                found = index.get(tuple(predicted[f][p] for f in fields))
                while found and not free_g[found[-1]]:
                    found.pop()
                if found and found[-1] < best:
                    best, where = found[-1], found
            if where is not None:
                where.pop()
                free_p[p] = free_g[best] = 0
                out.append((score, p, best))
                left -= 1
                if not left:
                    return out
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("score", "p", "g")])))
def _assigned(pd: pa.Array, pq: pa.Array, pu: pa.Array, pt: pa.Array, gd: pa.Array, gq: pa.Array, gu: pa.Array, gt: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (pd, pq, pu, pt, gd, gq, gu, gt)), strict=True)
    named = lambda m: {"score": m[0], "p": m[1], "g": m[2]}
    kind = pa.list_(pa.struct([("score", pa.int32()), ("p", pa.int32()), ("g", pa.int32())]))
    return pa.array([None if r[0] is None or r[4] is None else [named(m) for m in assigned(r[:4], r[4:])] for r in rows], kind)


def item_matches(predicted: Column, truth: Column) -> Column:
    """array<struct<score, p, g>>: the greedy matching of two item arrays, in the order in which pairs are taken."""
    return _assigned(*[_keys(predicted, n, False) for n in WEIGHTS], *[_keys(truth, n, True) for n in WEIGHTS])


def evaluate_documents(predicted: DataFrame, truth: DataFrame, *, money_tolerance: str = "0.01", allowed_currencies=None, low_confidence_threshold: float = 0.5) -> DataFrame:
    """One row per document_id that both sides have: predicted_items, truth_items, matches, document_comparisons, item_comparisons,
    precision, recall, f1, requires_review, arithmetic_issue, fully_correct.

    precision is null without predicted items, recall without true ones, f1 if either is. Validation runs on the prediction.
    """
    names = ("line_items", *DOCUMENT_FIELDS)
    side = lambda df, alias: df.select("document_id", F.struct(*names).alias(alias))
    pairs = side(predicted, "p").join(side(truth, "g"), "document_id")
    return evaluate_pairs(pairs, money_tolerance=money_tolerance, allowed_currencies=allowed_currencies, low_confidence_threshold=low_confidence_threshold)


def evaluate_pairs(pairs: DataFrame, *, money_tolerance: str = "0.01", allowed_currencies=None, low_confidence_threshold: float = 0.5) -> DataFrame:
    """As evaluate_documents, of pairs(document_id, p, g) that have both receipts as structs already. Row-local."""
    checked = pairs.select("document_id", *[F.col(f"p.{n}") for n in ("line_items", *DOCUMENT_FIELDS)], "g")
    mask = issue_mask(money_tolerance=money_tolerance, allowed_currencies=allowed_currencies, low_confidence_threshold=low_confidence_threshold)
    # each column stands alone, so that a query which doesn't read the matches or the issues doesn't compute them
    found = checked.withColumn("issues", mask).withColumn("matches", item_matches(F.col("line_items"), F.col("g.line_items")))
    item = lambda m: F.array(*[compare_field(F.get("line_items", m["p"])[n], F.get("g.line_items", m["g"])[n], f"line_items.{n}", n in TEXT_FIELDS) for n in WEIGHTS])
    out = found.select(
        "document_id", F.size("line_items").alias("predicted_items"), F.size("g.line_items").alias("truth_items"), F.size("matches").alias("matched"), "matches",
        F.array(*[compare_field(F.col(n), F.col(f"g.{n}"), n, n in TEXT_FIELDS) for n in DOCUMENT_FIELDS]).alias("document_comparisons"),
        F.flatten(F.transform("matches", item)).alias("item_comparisons"),
        (F.col("issues") > 0).alias("requires_review"), (F.col("issues").bitwiseAND(LINE_TOTAL | DOCUMENT_TOTAL) > 0).alias("arithmetic_issue"),
    )
    m = F.col("matched")
    out = out.withColumn("precision", F.when(F.col("predicted_items") > 0, m / F.col("predicted_items"))).withColumn("recall", F.when(F.col("truth_items") > 0, m / F.col("truth_items")))
    total = F.col("precision") + F.col("recall")
    out = out.withColumn("f1", F.when(total == 0, 0.0).when(total > 0, 2 * F.col("precision") * F.col("recall") / total))
    wrong = lambda c: F.exists(c, lambda x: x["outcome"] == INCORRECT)
    right = ~wrong("document_comparisons") & ~wrong("item_comparisons") & (F.coalesce("precision", F.lit(1.0)) == 1) & (F.coalesce("recall", F.lit(1.0)) == 1)
    return out.withColumn("fully_correct", right)


def unmatched(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """document_id, side of the documents that only one side has."""
    only = lambda a, b, side: a.join(b, "document_id", "left_anti").select("document_id", F.lit(side).alias("side"))
    return only(predicted, truth, "predicted").unionByName(only(truth, predicted, "truth"))


def field_rates(evaluations: DataFrame) -> DataFrame:
    """field_path, evaluable, accuracy, exact_match_rate of the document fields; a field never annotated has no row."""
    c = evaluations.select(F.explode("document_comparisons").alias("c")).select("c.*").where(F.col("outcome") != NOT_EVALUABLE)
    return c.groupBy("field_path").agg(F.count("*").alias("evaluable"), F.avg((F.col("outcome") == CORRECT).cast("double")).alias("accuracy"), F.avg(F.col("exact_match").cast("double")).alias("exact_match_rate"))


def report(evaluations: DataFrame) -> DataFrame:
    """One row: documents, field_accuracy and field_exact_match_rate (maps), mean precision, recall and f1 over the documents that
    have them, arithmetic_consistency_rate, coverage, false_accept_rate (null if nothing is accepted). No documents: an error."""
    share = lambda x, where=None: F.avg(F.when(where, x.cast("double")) if where is not None else x.cast("double"))
    at = lambda k: F.get("document_comparisons", F.lit(k))
    rates = []
    for k, n in enumerate(DOCUMENT_FIELDS):
        judged = at(k)["outcome"] != NOT_EVALUABLE
        rates += [share(at(k)["outcome"] == CORRECT, judged).alias(f"a_{n}"), share(at(k)["exact_match"], judged).alias(f"e_{n}")]
    accepted = ~F.col("requires_review")
    one = evaluations.agg(
        F.count("*").alias("documents"), *rates, F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        share(~F.col("arithmetic_issue")).alias("arithmetic_consistency_rate"), share(accepted).alias("coverage"), share(~F.col("fully_correct"), accepted).alias("false_accept_rate"),
    )
    as_map = lambda p: F.map_filter(F.create_map(*[x for n in DOCUMENT_FIELDS for x in (F.lit(n), F.col(f"{p}_{n}"))]), lambda _, v: v.isNotNull())
    some = F.when(F.col("documents") > 0, F.col("documents")).otherwise(F.raise_error(F.lit("no documents to report on")).cast("bigint"))
    return one.select(some.alias("documents"), as_map("a").alias("field_accuracy"), as_map("e").alias("field_exact_match_rate"), "precision", "recall", "f1", "arithmetic_consistency_rate", "coverage", "false_accept_rate")
