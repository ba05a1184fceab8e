"""Operators on small cases: numbers, text, validation, evaluation, lines, model answers, profile, stream."""

import json
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from paperproof.functions import numbers as N
from paperproof.functions import text as X
from paperproof.operators import annotation as A
from paperproof.operators import canonical as C
from paperproof.operators import evaluate as E
from paperproof.operators import landing as LA
from paperproof.operators import model_json as MJ
from paperproof.operators import ocr_lines as L
from paperproof.operators import profile as P
from paperproof.operators import validate as V
from paperproof.plans import schema as S
from paperproof.sources import annotations as SA
from paperproof.sources import images as SI
from paperproof.sources import model_client as MC

EU = {"75,000": "75", "1.234": "1234", "40,000.": "40000", "-45,50": "-45.5", "1.234,56": "1234.56", "1,234.56": "1234.56", "1.234.567": "1234567", "1,2,3": "invalid_amount", "7,": "7", "EUR": "no_numeric_amount", "1234567890123": "out_of_range", "1,1234567": "out_of_range", "Rp 0.000": "0"}
GROUPED = {"75,000": "75000", "43.636": "43636", "40,000.": "40000", "-45,50": "-4550", "1,2,3": "123", "19%": "19", "EUR": "no_numeric_amount", "12,500.00": "1250000"}
QUANTITY = {"1 x": "1", "x2": "2", "1,5": "1.5", "1,000": "1", "2x3": "2", "0": "non_positive_quantity", "-1": "non_positive_quantity", "unknown": "no_numeric_quantity", "": "no_numeric_quantity"}


@pytest.mark.parametrize(("parse", "cases"), [(N.parse_amount, EU), (N.parse_grouped_amount, GROUPED), (N.parse_quantity, QUANTITY)])
def test_numbers(spark, parse, cases):
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", parse(F.col("raw")).alias("p"))
    for r in df.collect():
        want = cases[r.raw]
        assert (r.p.error == want) if "_" in want else (r.p.error is None and r.p.value == Decimal(want)), r


def test_text(spark):
    spaced = ["  a  b\x1c\n", "　", " - ", ""]
    df = spark.createDataFrame([(x,) for x in spaced], "x string").select(X.normalize_text(F.col("x")), X.is_missing(F.col("x")))
    assert [tuple(r) for r in df.collect()] == [(" ".join(x.split()), " ".join(x.split()) in ("", "-")) for x in spaced]
    same = spark.createDataFrame([("Straße", "STRASSE"), (" A  b", "a B"), ("a", "b")], "a string, b string").select(X.same_text(F.col("a"), F.col("b")))
    assert [r[0] for r in same.collect()] == [True, True, False]


def dec(value, status="extracted", confidence=None):
    return Row(value=None if value is None else Decimal(value), value_text=value, raw_text=None, status=status, confidence=confidence, evidence=None)


def txt(value, status="extracted", confidence=None):
    return Row(value=value, raw_text=None, status=status, confidence=confidence, evidence=None)


NONE = dec(None, "not_present")


def item(d="Cappuccino", q="2", u="3.50", t="7.00"):
    return Row(description=txt(d) if d else txt(None, "not_present"), quantity=dec(q) if q else NONE, unit_price=dec(u) if u else NONE, line_total=dec(t) if t else NONE)


def receipt(spark, *rows):
    base = {"schema_version": "0.1.0", "document_id": "d", "line_items": [item()], "subtotal": dec("7.00"), "tax": dec("1.12"), "total": dec("8.12"), "currency": txt("EUR")}
    every = [base | r for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in S.RECEIPT_COLUMNS) for r in every], S.RECEIPT)


VALIDATION = [
    ({}, []), ({"line_items": [item(d=None)]}, ["MISSING_CRITICAL_FIELD"]), ({"total": dec(None, "unreadable")}, ["UNREADABLE_CRITICAL_FIELD"]), ({"line_items": [item(q=None, u=None)]}, []),
    ({"total": dec("8.12", "uncertain")}, ["MISSING_CRITICAL_FIELD", "LOW_CONFIDENCE"]), ({"currency": txt("EUR", confidence=0.2)}, ["LOW_CONFIDENCE"]), ({"currency": txt("EUR", confidence=0.5)}, []),
    ({"line_items": [item(u="3.00")]}, ["LINE_TOTAL_MISMATCH"]), ({"line_items": [item(q="3", u="3.33", t="10.00")], "subtotal": dec("10.00"), "total": dec("11.12")}, []), ({"subtotal": dec("9.00")}, ["DOCUMENT_TOTAL_MISMATCH"] * 2),
    ({"total": dec("99.00")}, ["DOCUMENT_TOTAL_MISMATCH"]), ({"subtotal": NONE, "tax": NONE, "total": dec("99.00")}, ["DOCUMENT_TOTAL_MISMATCH"]), ({"line_items": []}, []), ({"currency": txt("IDR")}, ["UNSUPPORTED_CURRENCY"]),
]


def test_validation(spark):
    df = receipt(spark, *[{"document_id": str(i)} | r for i, (r, _) in enumerate(VALIDATION)])
    got = {r.document_id: r for r in V.validate(df, allowed_currencies=["EUR"]).collect()}
    for i, (_, codes) in enumerate(VALIDATION):
        assert [x.code for x in got[str(i)].validation_issues] == codes, i
        assert got[str(i)].decision.requires_review == bool(codes) and all(x.message for x in got[str(i)].validation_issues)
    assert not any(x.code == "UNSUPPORTED_CURRENCY" for r in V.validate(df).collect() for x in r.validation_issues)


def test_faults(spark):
    bad = [{}, {"document_id": ""}, {"currency": txt("eur")}, {"total": dec(None)}, {"tax": dec("1", "not_present")}, {"total": dec("8.12", confidence=1.5)}, {"subtotal": dec("7", "sure")}]
    assert [len(r[0]) for r in receipt(spark, *bad).select(S.faults()).collect()] == [0, 1, 1, 1, 1, 1, 1]
    assert '"value":"8.12"' in receipt(spark, {}).select(S.as_json()).first()[0]


def test_evaluation(spark):
    rows = [{"document_id": "same"}, {"document_id": "extra", "line_items": [item(), item("Tea", "1", "2", "2.00")]}, {"document_id": "off", "currency": txt("USD")}, {"document_id": "none", "line_items": []}]
    gold = [{"document_id": d} for d in ("same", "extra", "off")] + [{"document_id": "none", "currency": txt(None, "not_annotated")}]
    ev = E.evaluate_documents(receipt(spark, *rows), receipt(spark, *gold))
    got = {r.document_id: r for r in ev.collect()}
    assert got["same"].fully_correct and not got["off"].fully_correct
    assert (got["extra"].precision, got["extra"].recall) == (0.5, 1.0) and got["extra"].f1 == pytest.approx(2 / 3)
    assert (got["none"].precision, got["none"].recall, got["none"].f1) == (None, 0.0, None)
    rep = E.report(ev).first()
    assert rep.field_accuracy["currency"] == pytest.approx(2 / 3) and rep.field_accuracy["total"] == 1.0 and rep.documents == 4
    with pytest.raises(Exception, match="no documents"):
        E.report(ev.limit(0)).collect()


def greedy(predicted, truth):
    """The matching by its definition: all pairs that agree, best first, then by position, each taken if both are free."""
    pairs = []
    for p in range(len(predicted[0])):
        for g in range(len(truth[0])):
            n = sum(w for w, a, b in zip(E.WEIGHTS.values(), predicted, truth, strict=True) if b[g] is not None and a[p] == b[g])
            pairs += [(-n, p, g)] if n else []
    out = []
    for n, p, g in sorted(pairs):
        if all(p != x and g != y for _, x, y in out):
            out.append((-n, p, g))
    return out


def test_matching_is_the_greedy_one():
    pick = random.Random(7)
    for _ in range(600):
        some = lambda n, extra: [[pick.choice(["", "=a", "=b", "=c", *extra]) for _ in range(n)] for _ in range(4)]
        p, g = some(pick.randint(1, 7), []), some(pick.randint(1, 7), [None])
        assert E.assigned(p, g) == greedy(p, g)
    assert E.assigned([[]] * 4, [["="]] * 4) == E.assigned([["="]] * 4, [[]] * 4) == []


def test_long_receipts_are_matched_in_seconds(spark):
    import time

    long = [item(f"thing {i % 700}", str(1 + i % 9), "2.00", str(2 * (1 + i % 9))) for i in range(2000)]
    other = [item(f"Thing  {(i * 7) % 700}", str(1 + i % 8), "2.00", str(2 * (1 + i % 9))) for i in range(2000)]
    pairs = receipt(spark, {"line_items": long}).select("document_id", F.struct("line_items", *S.DOCUMENT_FIELDS).alias("p")).join(receipt(spark, {"line_items": other}).select("document_id", F.struct("line_items", *S.DOCUMENT_FIELDS).alias("g")), "document_id")
    began = time.time()
    row = E.evaluate_pairs(pairs).select("matches", "matched").first()
    assert row.matched == 2000 and time.time() - began < 30
    scores = [m.score for m in row.matches]
    assert scores == sorted(scores, reverse=True) and len({m.p for m in row.matches}) == len({m.g for m in row.matches}) == 2000


def test_evaluation_prunes_what_is_not_read(spark):
    ev = E.evaluate_documents(receipt(spark, {}), receipt(spark, {}))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "_assigned" not in plan(E.field_rates(ev)) and "MISMATCH" not in plan(E.report(ev)) and "0.01" not in plan(E.field_rates(ev)) and "0.01" not in plan(ev.select("matches"))
    assert "_assigned" in plan(ev.select("matches"))


def test_mask_says_which_issues_there_are(spark):
    df = receipt(spark, *[{"document_id": str(i)} | r for i, (r, _) in enumerate(VALIDATION)])
    bit = {"MISSING_CRITICAL_FIELD": V.MISSING, "UNREADABLE_CRITICAL_FIELD": V.UNREADABLE_FIELD, "LOW_CONFIDENCE": V.DOUBTFUL, "LINE_TOTAL_MISMATCH": V.LINE_TOTAL, "DOCUMENT_TOTAL_MISMATCH": V.DOCUMENT_TOTAL, "UNSUPPORTED_CURRENCY": V.CURRENCY}
    got = {r.document_id: r.mask for r in df.select("document_id", V.issue_mask(allowed_currencies=["EUR"]).alias("mask")).collect()}
    assert got == {str(i): sum({bit[c] for c in codes}) for i, (_, codes) in enumerate(VALIDATION)}
    df = df.unionByName(df.limit(1).withColumn("line_items", F.lit(None).cast(df.schema["line_items"].dataType)).withColumn("document_id", F.lit("none")))
    plain = lambda d: sorted((r.document_id, r.decision) for r in d.collect())
    assert plain(V.decide(df, allowed_currencies=["EUR"])) == plain(V.validate(df, allowed_currencies=["EUR"]))


def test_lines_from_words(spark):
    tops = [(0, 0), (8, 1), (16, 2)]
    words = spark.createDataFrame([("d", i, t, i, f"w{i}", 90.0) for t, i in tops] + [("d", 9, 0, 9, " ", 99.0), ("d", 8, 0, 8, "no", -1.0)], "document_id string, word_idx int, top long, left long, text string, conf double")
    assert [(r.line_idx, r.text, r.confidence) for r in L.lines_from_words(words).orderBy("line_idx").collect()] == [(0, "w0 w1", 90.0), (1, "w2", 90.0)]
    assert L.lines_from_words(words.limit(0)).count() == 0
    images = spark.createDataFrame([("p", b"xy")], "path string, content binary")
    ocr = lambda b: {"top": [1], "left": [2], "text": [b.decode()], "conf": ["95"]}
    assert SI.read_words(images, ocr).first().text == "xy"


def folded(words, tolerance):
    """document_id, line_idx, text, confidence by the definition."""
    docs, out = {}, []
    for d, i, top, left, text, conf in words:
        if text is not None and text.split() and conf is not None and conf >= 0:
            docs.setdefault(d, []).append((-(1 << 62) if top is None else top, -(1 << 62) if left is None else left, i, text.strip(), conf))
    for d, ws in docs.items():
        lines = []
        for w in sorted(ws):
            if lines and w[0] - lines[-1][0][0] <= tolerance:
                lines[-1].append(w)
            else:
                lines.append([w])
        for k, x in enumerate(lines):
            x = sorted(x, key=lambda w: w[1])
            out.append((d, k, " ".join(w[3] for w in x), pytest.approx(sum(w[4] for w in x) / len(x))))
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


WORDS = "document_id string, word_idx int, top long, left long, text string, conf double"


@pytest.mark.parametrize("tolerance", [0, 3, 10])
def test_lines_are_a_fold(spark, tolerance):
    pick = random.Random(tolerance)
    words = [(pick.choice(["a", "b", "c", None]), i, pick.choice([None, *range(0, 90, 4)]), pick.choice([None, 1, 2, 3]), pick.choice(["x", " y z ", "", "\u3000", None, "w"]), pick.choice([90.0, 0.0, -1.0, None, 55.5])) for i in range(400)]
    got = [tuple(r) for r in L.lines_from_words(spark.createDataFrame(words, WORDS), line_tolerance_px=tolerance).collect()]
    assert sorted(got, key=lambda r: (str(r[0]), r[1])) == folded(words, tolerance)


def test_a_page_of_many_words(spark):
    import time

    words = spark.range(50_000).selectExpr("'page' AS document_id", "CAST(id AS INT) AS word_idx", "id DIV 8 * 7 AS top", "id % 8 * 50 AS left", "CONCAT('w', id) AS text", "90.0D AS conf")
    began = time.time()
    got = L.lines_from_words(words).collect()
    assert len(got) == 3125 and time.time() - began < 30
    assert max(r.line_idx for r in got) == 3124 and sum(len(r.text.split()) for r in got) == 50_000


def test_a_line_with_a_control_character_is_an_item(spark):
    lines = spark.createDataFrame([("a", 0, "Tea\u0001 green 2 x 3,50 7,00", 1.0), ("a", 1, "Cake\u0001 4,00", 1.0)], "document_id string, line_idx int, text string, confidence double")
    got = L.extract_baseline(lines).first().line_items
    assert [(x.description.value, x.line_total.value) for x in got] == [("Tea\u0001 green", 7), ("Cake\u0001", 4)]


def test_baseline_keeps_documents_without_lines(spark):
    lines = spark.createDataFrame([("a", 0, "Gesamt 10,00", 1.0), ("a", 1, "Gesamt 99,99", 1.0), ("a", 2, "EUR", 1.0), ("a", 3, "bar $", 1.0)], "document_id string, line_idx int, text string, confidence double")
    got = {r.document_id: r for r in L.extract_baseline(lines, spark.createDataFrame([("a",), ("b",)], "document_id string")).collect()}
    assert got["a"].total.value == 10 and got["a"].line_items[0].description.value == "Gesamt" and got["a"].currency.value == "USD"
    assert got["b"].line_items == [] and got["b"].total.status == "not_present"


def test_annotation_errors_and_profile(spark, tmp_path):
    good = '{"gt_parse":{"menu":{"nm":["-","Gyro  Platter"],"cnt":"1 x","price":["20,000","20.000"]},"sub_total":[],"total":{"total_price":["1,0","11%"]}},"meta":{"split":"train","image_id":7}}'
    rows = [good, "{invalid", None, '{"a":1} x', "[1]", '{"gt_parse":{"menu":3},"meta":{"image_id":1}}', '{"gt_parse":{"menu":[{"price":5}]},"meta":{"image_id":2}}']
    df = spark.createDataFrame(list(enumerate(rows)), "ord int, ground_truth string")
    got = A.adapt_annotations(df).orderBy("ord").collect()
    assert [r.error for r in got] == [None, "invalid_json", "invalid_json", "invalid_json", "root not an object", "menu not objects", "menu[0].price not text"]
    x = got[0]
    assert (x.document_id, x.line_items[0].description.value, x.line_items[0].description.raw_text, x.line_items[0].line_total.value) == ("cord-train-7", "Gyro Platter", "- | Gyro  Platter", 20000)
    assert (x.subtotal.status, x.total.value, x.currency.status) == ("not_annotated", 10, "not_annotated")
    report = P.profile_report(df, order="ord")
    assert report["documents"]["total"] == 7 and report["documents"]["valid_json"] == 3 and report["adapter_error_details"]["invalid_json"] == 3
    assert report["line_items"]["per_document"]["max"] == 1 and len(report["adapter_error_examples"]) == 2
    assert list(report["adapter_error_details"]) == ["invalid_json", "json_root_not_object", "menu not objects", "menu[0].price not text"]
    assert [e["context"] for e in report["adapter_error_examples"]] == [{}, {"non_string_item_fields": [{"index": 0, "field": "price", "value": 5}]}]
    odd = '{"gt_parse":{"menu":[{"nm":["a"],"price":5}],"sub_total":{"tax_price":" - ","etc":"-","service_price":["1",2]},"total":[3]},"meta":{"image_id":2,"split":"test"}}'
    odd = spark.createDataFrame([(2, '{"gt_parse":{"menu":4},"meta":{"image_id":1}}'), (1, '{"gt_parse":7}'), (3, odd)], "ord int, ground_truth string")
    report = P.profile_report(odd, order="ord")
    assert list(report["adapter_error_details"]) == ["missing_or_invalid_gt_parse", "menu not objects", "menu[0].price not text"]
    assert report["adapter_error_examples"][1] == {"document_id": "cord-test-2", "error": "menu[0].price not text", "context": {"non_string_item_fields": [{"index": 0, "field": "nm", "value": ["a"]}, {"index": 0, "field": "price", "value": 5}], "sub_total": {"tax_price": " - ", "service_price": ["1", 2]}, "total": [3]}}
    P.write_report(report, str(tmp_path / "a" / "r.json"))
    assert (tmp_path / "a" / "r.json").read_text().endswith("}\n")


def annotation(i, price="5", split="train"):
    item = {"nm": f"n{i}", "price": price}
    return json.dumps({"gt_parse": {"menu": [item] * (i % 4) if i % 5 else item, "sub_total": {"tax_price": f"{i},00"}}, "meta": {"split": split, "image_id": i}})


def test_profiles_of_parts_add_up(spark, tmp_path):
    rows = [(i, ["{", annotation(i), annotation(i, 5), annotation(i, "x"), "[1]", annotation(i, split="test")][i % 6]) for i in range(40)]
    every = spark.createDataFrame(rows, "ord int, ground_truth string")
    a, b = every.where("ord % 7 < 3"), every.where("ord % 7 >= 3")
    whole = P.profile_state(every, order="ord")
    parts = P.merged_states(P.profile_state(a, order="ord"), P.profile_state(b, order="ord"))
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert P.state_report(parts) == {k: v for k, v in P.profile_report(every, "ord").items() if k != "adapter_error_examples"}
    LA.land(a, str(tmp_path / "landed"))
    LA.land(b, str(tmp_path / "landed"))
    landed = LA.read_landed(spark, str(tmp_path / "landed"))
    assert P.profile_report(landed, "ord") == P.profile_report(every, "ord")
    key = lambda r: (r.ord, str(r.error), str(r.line_items), str(r.total))
    assert sorted(map(key, A.adapt_annotations(landed).collect())) == sorted(map(key, A.adapt_annotations(every).collect()))
    n = [len(json.loads(t)["gt_parse"]["menu"]) if isinstance(json.loads(t)["gt_parse"]["menu"], list) else 1 for _, t in rows if t.startswith('{"gt')]
    got, n = P.items_per_document(every).first(), sorted(n)
    assert (got.min, got.max, got.median, got.p95) == (n[0], n[-1], (n[(len(n) - 1) // 2] + n[len(n) // 2]) / 2, n[-(-len(n) * 95 // 100) - 1]) and got["mean"] == pytest.approx(sum(n) / len(n), abs=1e-3)
    assert tuple(P.items_per_document(every.limit(0)).first()) == (None,) * 5


def test_presence_reads_presence_alone(spark, tmp_path):
    LA.land(spark.createDataFrame([(1, annotation(1))], "ord int, ground_truth string"), str(tmp_path / "landed"))
    landed = LA.read_landed(spark, str(tmp_path / "landed"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    read = plan(P.profile_rows(landed, sections=("document_field_presence", "line_item_field_presence"))).split("ReadSchema: ")[1].split("\n")[0]
    assert "present" in read and not any(x in read for x in ("raw", "value", "kind", "format", "odd", "image_id"))
    read = plan(P.items_per_document(landed)).split("ReadSchema: ")[1].split("\n")[0]
    assert "n_items:int" in read and "items:array" not in read


def test_stream_profile(spark, tmp_path):
    from paperproof.streaming import receipts as ST

    every = spark.createDataFrame([(annotation(i) if i % 3 else "{",) for i in range(40)], "ground_truth string")
    every.repartition(4).write.parquet(str(tmp_path / "in"))
    q = ST.running_profile(ST.annotation_stream(spark, str(tmp_path / "in"), files_per_trigger=1)).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("states").collect())) == sorted(map(str, P.profile_state(every).collect()))


def test_files_are_in_the_order_of_the_manifest(spark, tmp_path):
    """First-seen errors and examples stand as one reader going through the files would meet them."""
    texts = {"b": ["{", annotation(1, 5), annotation(2)], "a": ["[1]", annotation(3, 5), annotation(7, 7), "{"], "c d": ['{"gt_parse":1}', annotation(6, [1])] * 2}
    for name, rows in texts.items():
        spark.createDataFrame([(t, i) for i, t in enumerate(rows)], "ground_truth string, n int").coalesce(1).write.option("parquet.block.size", "1024").parquet(str(tmp_path / name))
    paths = [str(tmp_path / n) for n in ("b", "c d", "a")]
    rows = SA.read_annotations(spark, paths, "ground_truth", order="at")
    assert [r.ground_truth for r in rows.orderBy("at").collect()] == [t for n in ("b", "c d", "a") for t in texts[n]]
    report = P.profile_report(rows, order="at")
    met = Counter()
    for n in ("b", "c d", "a"):
        for r in A.adapt_annotations(spark.createDataFrame([(i, t) for i, t in enumerate(texts[n])], "i int, ground_truth string")).orderBy("i").collect():
            met[P.CODES.get(r.error, r.error)] += r.error is not None
    assert list(report["adapter_error_details"].items()) == [(k, v) for k, v in met.most_common() if k]
    assert [e["document_id"] for e in report["adapter_error_examples"]] == [f"cord-train-{i}" for i in (1, 6, 6, 3, 7)]
    again = SA.read_annotations(spark, [str(tmp_path / "?"), paths[1]], "ground_truth", order="at")
    assert {r.at.entry for r in again.collect()} == {0, 1}


def answer(url, headers, body):
    import json

    field = lambda s, v=None: {"status": s, "value": v}
    if "fail" in body["contents"][0]["parts"][0]["text"]:
        return MC.HttpResponse(429, {"error": {"message": "slow down"}})
    said = {"line_items": [], "subtotal": field("not_present"), "tax": field("uncertain", "x"), "total": field("extracted", "7,00"), "currency": field("extracted", " eur ")}
    return MC.HttpResponse(200, {"candidates": [{"content": {"parts": [{"text": json.dumps(said)[:9]}, {"text": json.dumps(said)[9:]}]}}]})


def test_model_client(spark):
    lines = spark.createDataFrame([("a", 0, "Tea 7,00"), ("b", 0, "fail")], "document_id string, line_idx int, text string")
    got = {r.document_id: r for r in MC.extract_with_model(lines, url="http://x", api_key="k", http_post=answer).collect()}
    assert got["a"].error is None and got["a"].total.value == 7 and got["a"].currency.value == "EUR" and got["a"].tax.status == "uncertain"
    assert got["b"].error == "http 429: slow down" and got["b"].total is None


def test_manifest():
    assert SA.manifest_paths([{"url": "a"}]) == SA.manifest_paths({"parquet_files": [{"url": "a"}]}) == ["a"]
    assert SA.source_block({"dataset": "d", "parquet_files": [{"url": "a", "size": 3}, {"url": "b", "size": 4}]}, ["x"]) == {"dataset": "d", "files": 2, "advertised_bytes": 7, "columns": ["x"]}
    with pytest.raises(ValueError, match="entry 1 has no url"):
        SA.manifest_paths([{"url": "a"}, {"size": 1}])
    for bad in ([], {}, {"parquet_files": []}, "x"):
        with pytest.raises(ValueError, match="manifest"):
            SA.manifest_paths(bad)


def test_report_command(spark, tmp_path, capsys):
    from paperproof import cli

    rows = [('{"gt_parse":{"menu":[{"nm":"a","price":"5"}],"total":{"total_price":"5"}},"meta":{"image_id":1}}', 1), ("x", 2)]
    spark.createDataFrame(rows, "ground_truth string, n int").write.parquet(str(tmp_path / "in"))
    (tmp_path / "m.json").write_text(json.dumps({"dataset": "receipts", "parquet_files": [{"url": str(tmp_path / "in"), "size": 12}]}))
    stop, spark.__class__.stop = spark.__class__.stop, lambda self: None
    try:
        assert cli.main(["--manifest", str(tmp_path / "m.json"), "--output", str(tmp_path / "r.json"), "--order", "n"]) == 0
    finally:
        spark.__class__.stop = stop
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["source"] == {"dataset": "receipts", "files": 1, "advertised_bytes": 12, "columns": ["ground_truth", "n"]} and report["documents"]["total"] == 2
    assert "2 documents" in capsys.readouterr().out


def test_report_of_a_manifest_parses_once_and_follows_its_order(spark, tmp_path):
    from paperproof.cli import manifest_report
    from paperproof.operators.landing import read_landed

    good, bare, odd = '{"gt_parse":{"menu":[{"nm":"a","price":"5"}]},"meta":{"image_id":1}}', '{"gt_parse":{"menu":[]}}', '{"gt_parse":{"menu":[{"nm":3}]},"meta":{"image_id":2}}'
    for name, texts in (("z", [good, odd]), ("a", [bare, odd, bare])):
        spark.createDataFrame([(t, b"image") for t in texts], "ground_truth string, image binary").coalesce(1).write.parquet(str(tmp_path / name))
    for names, first in (("za", "text field not text"), ("az", "no document id")):
        store = str(tmp_path / f"store-{names}")
        report = manifest_report(spark, [{"url": str(tmp_path / n), "size": 5} for n in names], dataset="d", store=store)
        assert next(iter(report["adapter_error_details"])) == first and report["adapter_error_details"] == {"text field not text": 2, "no document id": 2}
        assert report["adapter_error_examples"][0]["error"] == first and len(report["adapter_error_examples"]) == 4
        assert report["source"] == {"dataset": "d", "files": 2, "advertised_bytes": 10, "columns": ["ground_truth"]} and report["documents"]["total"] == 5
        assert "ground_truth" not in read_landed(spark, store).columns and read_landed(spark, store).count() == 5
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
            manifest_report(spark, [{"url": str(tmp_path / "z")}], store=store)


ANSWERS = [
    (200, {"candidates": []}, "no candidates"), (200, {}, "no candidates"), (200, {"candidates": [{"content": {"parts": [{"text": "  "}]}}]}, "empty answer"), (200, {"candidates": [{"content": {"parts": [{"text": "{no"}]}}]}, "answer not JSON"),
    (200, {"candidates": [{"content": {"parts": [{"text": "[1]"}]}}]}, "answer not an object"), (500, "down", 'http 500: "down"'), (0, "no answer: lost", 'http 0: "no answer: lost"'), (400, {"error": {"message": "bad key"}}, "http 400: bad key"),
]


def test_answers_of_odd_shapes(spark):
    f = lambda status="extracted", value=None: {"status": status, "value": value}
    whole = {"line_items": [], "subtotal": f("not_present"), "tax": f("unreadable", "5"), "total": f("extracted", "7,00"), "currency": f("extracted", "eur")}
    item = {"description": f("extracted", " a  b "), "quantity": f("extracted", "2 x"), "unit_price": f("uncertain", "3,5"), "line_total": f("extracted", "no")}
    cases = [
        (whole, None), ([], "root not an object"), (None, "root not an object"), ("{", "invalid_json"), (whole | {"line_items": {}}, "line_items not a list"), (whole | {"line_items": [item, 5]}, "line_items[1] not an object"),
        (whole | {"line_items": [item | {"quantity": None}]}, "line_items[0].quantity not an object"), (whole | {"line_items": [item | {"unit_price": {"value": "1"}}]}, "line_items[0].unit_price.status unknown"),
        ({k: v for k, v in whole.items() if k != "tax"}, "tax not an object"), (whole | {"total": f(5)}, "total.status unknown"), (whole | {"total": f("maybe")}, "total.status unknown"), (whole | {"line_items": [item]}, None),
        (whole | {"total": f("extracted", 7), "currency": f("uncertain", "x y")}, None),
    ]
    rows = [(i, x if isinstance(x, str) else json.dumps(x)) for i, (x, _) in enumerate(cases)] + [(99, None)]
    got = {r.i: r for r in MJ.adapt_model_json(spark.createDataFrame(rows, "i int, raw string")).collect()}
    assert [got[i].error for i in range(len(cases))] == [e for _, e in cases] and got[99].error == "invalid_json"
    assert all((r.total is None) == (r.error is not None) == (r.line_items is None) for r in got.values())
    x = got[11].line_items[0]
    assert (x.description.value, x.description.raw_text, x.quantity.value, x.unit_price.status, x.unit_price.value) == ("a b", " a  b ", 2, "uncertain", Decimal("3.5"))
    assert (x.line_total.status, x.line_total.raw_text, got[0].tax.status, got[0].tax.value, got[0].subtotal.status, got[0].currency.value) == ("uncertain", "no", "unreadable", None, "not_present", "EUR")
    assert (got[12].total.status, got[12].total.value, got[12].currency.status, got[12].currency.value) == ("uncertain", None, "uncertain", "x y")


def test_faulty_answers(spark):
    df = spark.createDataFrame([(str(i), code, json.dumps(body)) for i, (code, body, _) in enumerate(ANSWERS)], "document_id string, status_code int, body string")
    assert [r.call_error for r in MC.unwrapped(df).orderBy("document_id").collect()] == [e for *_, e in ANSWERS]
    assert MC.unwrapped(df).where("raw IS NOT NULL").count() == 0


def test_calls_are_tried_again():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    codes = [503, 429, 200, 404]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(codes.pop(0))
            self.end_headers()
            self.wfile.write(b'{"ok": 1}' if len(codes) == 1 else b"plain")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert MC.post_json(url, {}, {"a": 1}, pause=0.01) == MC.HttpResponse(200, {"ok": 1})
    assert MC.post_json(url, {}, {"a": 1}, pause=0.01) == MC.HttpResponse(404, "plain")
    server.shutdown()
    server.server_close()
    assert MC.post_json(url, {}, {}, pause=0.01).status_code == 0


def test_words_and_currency_keep_their_inner_spaces(spark):
    words = spark.createDataFrame([("d", 0, 0, 0, "\t a  b \u3000", 90.0)], "document_id string, word_idx int, top long, left long, text string, conf double")
    assert L.lines_from_words(words).first().text == "a  b"
    lines = spark.createDataFrame([("a", 0, "  paid   in  EUR ", 1.0)], "document_id string, line_idx int, text string, confidence double")
    assert L.extract_baseline(lines).first().currency.raw_text == "  paid   in  EUR "
    data = spark.createDataFrame([("p", [1, 1], [2, 1], ["b", "a"], ["95", "85"])], "document_id string, top array<int>, left array<int>, text array<string>, conf array<string>")
    assert [r.text for r in L.lines_from_words(SI.words_from_columns(data)).collect()] == ["a b"]


def test_same_and_exact_differ(spark):
    ev = E.evaluate_documents(receipt(spark, {"currency": txt(" eur")}), receipt(spark, {}, {"document_id": "alone"}))
    r = E.report(ev).first()
    assert (r.field_accuracy["currency"], r.field_exact_match_rate["currency"]) == (1.0, 0.0)
    assert [tuple(x) for x in E.unmatched(receipt(spark, {}), receipt(spark, {}, {"document_id": "alone"})).collect()] == [("alone", "truth")]


def test_canonical_json_is_read_back_whole_or_not_at_all(spark):
    whole = receipt(spark, {"total": dec("8.12", confidence=0.5), "tax": NONE}).select("*", S.as_json().alias("raw"))
    text = whole.first().raw
    ev = [{"page": 1, "text": "t", "bounding_box": {"left": 0, "top": 0, "right": 1, "bottom": 2}}]
    change = lambda f: json.dumps(f(json.loads(text)))
    cases = [(text, True), ("{", False), ("[]", False), (None, False), ('{"document_id":"x","currency":{"status":"not_a_real_status"}}', False)]
    cases += [(change(lambda r: r | {"more": 1}), False), (change(lambda r: {k: v for k, v in r.items() if k != "tax"}), False), (change(lambda r: {k: v for k, v in r.items() if k not in ("schema_version", "line_items")}), True)]
    cases += [(change(lambda r: r | {"total": {"status": "extracted", "value": v}}), ok) for v, ok in (("8.1", True), (8.1, True), ("x", False), (None, False), ([], False))]
    cases += [(change(lambda r: r | {"total": r["total"] | {"evidence": e}}), ok) for e, ok in ((ev, True), ([], True), (None, False), ([{"text": ""}], False), ([{"page": 1}], False), ([ev[0] | {"x": 1}], False), ([ev[0] | {"bounding_box": {"left": 0}}], False))]
    cases += [(change(lambda r: r | {"line_items": v}), ok) for v, ok in (([], True), (None, False), ([1], False), ([{}], False), ({}, False))]
    cases += [(change(lambda r: r | {"document_id": 5}), False), (change(lambda r: r | {"schema_version": "2"}), False), (change(lambda r: r | {"total": r["total"] | {"confidence": "high"}}), False), (change(lambda r: r | {"total": r["total"] | {"confidence": 2}}), False)]
    got = C.read_receipts(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, raw string"))
    rows = got.orderBy("i").collect()
    assert [r.schema_valid for r in rows] == [ok for _, ok in cases]
    assert all((r.document_id is not None) == r.schema_valid == (r.total is not None) for r in rows)
    assert got.where("i = 0").select(S.as_json()).first()[0] == text
    assert tuple(C.schema_valid_rate(got).first()) == (len(cases), sum(ok for _, ok in cases), pytest.approx(sum(ok for _, ok in cases) / len(cases)))


def test_stream(spark, tmp_path):
    from paperproof.streaming import receipts as ST

    good = '{"gt_parse":{"menu":[],"total":{"total_price":"5"}},"meta":{"image_id":%d}}'
    spark.createDataFrame([(good % i,) for i in range(3)], "ground_truth string").write.parquet(str(tmp_path / "in"))
    q = ST.reason_counts(ST.decided(ST.annotation_stream(spark, str(tmp_path / "in")))).writeStream.outputMode("complete").format("memory").queryName("reasons").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("reasons").collect()] == [("missing_critical_field", 3)]
