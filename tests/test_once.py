"""What work over whole tables costs: steps taken once, and the shortcuts for usual values beside the rules for odd ones."""

import json
import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from paperproof.functions import numbers as N
from paperproof.functions import text as X
from paperproof.functions import variant as J
from paperproof.operators import canonical as C
from paperproof.operators import landing as LA
from paperproof.operators import model_json as MJ
from paperproof.operators import ocr_lines as L
from paperproof.operators import profile as P
from paperproof.plans import schema as S
from paperproof.sources import answers as AN
from paperproof.sources import model_client as MC


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_parsed_once_and_whole(spark):
    texts = ["1", "1],[2", "1,2", "[1],2", "1]", "1}", '{"a":1}', ' {"a":1} ', '{"a":1},{"a":2}', '{"a":1}],"x', '"a","b', '"a', "", " ", ",", "1,", "null", "[]", "[1", '{"v":1},"w":2', '"\\', "1 2", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.j for r in df.select("t", F.to_json(J.parse_json(F.col("t"))).alias("j")).collect()}
    for t in texts:
        try:
            want = json.loads(t or "")
        except ValueError:
            assert got[t] is None, t
        else:
            assert json.loads(got[t]) == want, t
    assert plan(df.select(J.parse_json(F.col("t")).alias("p"))).count("parseJson") == 1


def test_steps_of_number_and_format_are_taken_once(spark):
    df = spark.createDataFrame([("1",)], "t string")
    for parse in (N.parse_amount, N.parse_grouped_amount, N.parse_quantity):
        assert plan(df.select(parse(F.col("t")).alias("p"))).count("regexp_replace(") == 1
    assert plan(df.select(X.quantity_format(F.col("t")).alias("p"))).count("lower(") == 1


def test_numbers_by_their_definition(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choice("0012345.,-+x% ") for _ in range(pick.randint(1, 9))) for _ in range(3000)] + ["+00.10", "-0", "-0.0", "000", "5.", "123456789012", "1234567890123", "0.1234567", "0.1234560"]

    def plain(t, grouped):
        if grouped:
            m = re.search(r"[-+]?[0-9][0-9.,]*", t)
            return m and m[0].translate({44: None, 46: None})
        m = re.search(r"[-+]?[0-9]+(?:[.,][0-9]+)?", t)
        return m and m[0].replace(",", ".")

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.parse_grouped_amount(F.col("t")).alias("g"), N.parse_quantity(F.col("t")).alias("q"))
    for r in df.collect():
        for got, grouped in ((r.g, True), (r.q, False)):
            p = plain(r.t, grouped)
            d = p and Decimal(p)
            if p is None:
                assert got.error in ("no_numeric_amount", "no_numeric_quantity")
            elif abs(d) >= 10**12 or d != round(d, 6):
                assert got.error == "out_of_range"
            elif not grouped and d <= 0:
                assert got.error == "non_positive_quantity"
            else:
                whole = re.sub(r"^(-?)0+(?=[0-9])", r"\1", re.sub(r"^\+|\.$", "", p))
                assert (got.value, got.value_text, got.error) == (d, whole, None), r


def test_normal_texts(spark):
    pick = random.Random(6)
    texts = ["".join(pick.choice(["a", "-", " ", "\t", " ", "é", "~"]) for _ in range(pick.randint(0, 6))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalize_text(F.col("t")).alias("n"), X.is_missing(F.col("t")).alias("m"), X.is_blank(F.col("t")).alias("b")).collect()
    for r in rows:
        n = " ".join(r.t.split())
        assert (r.n, r.m, r.b) == (n, n in ("", "-"), n == "")


def test_let_copies_nothing(spark):
    """A value bound within a row is no array of one, which Spark would copy, and type anew, at each level for each row."""
    df = spark.createDataFrame([('{"gt_parse":{"menu":{"nm":"a","cnt":"1","price":"2"}},"meta":{"image_id":1}}',)], "ground_truth string")
    assert "transform(array(" not in plan(df.select(N.parse_quantity(F.col("ground_truth")).alias("p")))
    row = LA.landed(df).first()
    assert (row["items"][0].nm.value, row["items"][0].cnt.value, row["items"][0].price.value, row["items"][0].unitprice.kind) == ("a", 1, 2, "absent")


def test_presence_and_statuses_of_every_kind_of_value(spark):
    kinds = ['"a"', '""', '"-"', '" "', "null", "5", "0", "false", "[]", "{}", '["1","2"]', '["1","1"]', '["-","3"]', "[null]", '["1",2]', '{"a":1}', '"5%"', '["5%","7"]']
    texts = ['{"gt_parse":{"menu":[{"nm":%s,"cnt":%s,"price":%s}],"sub_total":{"tax_price":%s},"total":{"total_price":%s}},"meta":{"image_id":%d}}' % (k, k, k, k, k, i) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, ground_truth string")
    cells = {kinds[r.i]: r for r in LA.landed(df).collect()}
    of = lambda k: cells[k]["items"][0]
    assert {k for k in kinds if of(k).price.present} == {k for k in kinds if json.loads(k) not in ("", None, [], {}) or json.loads(k) in (0, False) and k in ("0", "false")}
    assert [of(k).price.kind for k in kinds] == ["text"] * 4 + ["absent"] + ["other"] * 3 + ["texts", "other", "texts", "texts", "texts", "other", "other", "other", "text", "texts"]
    assert [of(k).price.value for k in ('["1","2"]', '["1","1"]', '["-","3"]', '"5%"', '["5%","7"]')] == [None, 1, 3, None, 7]
    assert of('"a"').price.unreadable and of('"-"').nm.value is None and of('["-","3"]').nm.value == "3" and of('"5%"').cnt.value == 5
    odd = {k: json.loads(cells[k].odd) for k in kinds}
    assert {k for k in kinds if "non_string_item_fields" in odd[k]} == {k for k in kinds if not isinstance(json.loads(k), str | None)}
    assert {k for k in kinds if "total" in odd[k]} == {k for k in kinds if not isinstance(json.loads(k), str)} | {'"-"'}


FIELD = {"value": "1", "raw_text": None, "status": "extracted", "confidence": None, "evidence": []}


def receipt_json(**more):
    item = {n: FIELD for n in S.ITEM_FIELDS}
    return {"schema_version": "0.1.0", "document_id": "d", "line_items": [item, item], "subtotal": FIELD, "tax": FIELD, "total": FIELD, "currency": FIELD | {"value": "EUR"}} | more


def test_plain_receipts_are_read_as_all_others(spark):
    """Types of lists are those of all their elements together; what only one element has wrong must be seen."""
    item = {n: FIELD for n in S.ITEM_FIELDS}
    without = lambda x, n: {k: v for k, v in x.items() if k != n}
    field = lambda **f: {"line_items": [item, item | {"quantity": FIELD | f}, item]}
    good = [{}, {"line_items": []}, field(confidence=0.5), field(raw_text="x"), field(evidence=[{"text": "a"}]), field(value=5), {"line_items": [item, item | {"quantity": without(FIELD, "evidence")}]}, {"line_items": [item | {"tax": FIELD}][:0]}, {"total": without(FIELD, "confidence")}]
    bad = [field(evidence=None), field(evidence=[None]), field(status=None), field(value=None), field(value="x"), field(confidence=2), field(confidence="x"), field(raw_text=1), field(more=1), {"line_items": [item, without(item, "tax") | {"more": 1}]}, {"line_items": [item, without(item, "quantity")]}, {"line_items": [item, None]}, {"line_items": [None]}, {"line_items": None}, {"total": None}, {"currency": FIELD}, {"schema_version": None}, {"schema_version": 1}, {"document_id": ""}, {"document_id": 1}, {"tax": FIELD | {"evidence": None}}, {"tax": FIELD | {"evidence": [None]}}, {"more": 1}]
    texts = [json.dumps(receipt_json(**x)) for x in good + bad] + [json.dumps(without(receipt_json(), "schema_version")), json.dumps(without(receipt_json(), "line_items"))]
    rows = C.read_receipts(spark.createDataFrame(list(enumerate(texts)), "i int, raw string")).collect()
    valid = {r.i for r in rows if r.schema_valid}
    assert valid == {*range(len(good)), len(texts) - 2, len(texts) - 1}
    first = next(r for r in rows if r.i == 0)
    assert first.line_items[1].quantity.value == 1 and first.line_items[1].quantity.evidence == [] and first.currency.value == "EUR"
    shown = plan(C.read_receipts(spark.createDataFrame([("",)], "raw string")))
    assert "format_string" not in shown and "_plain" in shown


def test_a_receipt_holds_if_it_has_no_faults(spark):
    pick = random.Random(8)
    field = lambda: {"value": pick.choice(["1", None]), "raw_text": None, "status": pick.choice(["extracted", "extracted", "not_present", "guessed"]), "confidence": pick.choice([None, 0.5, 2.0]), "evidence": pick.choice([[], None, [{"text": "a", "page": 1}], [{"text": "", "page": 1}]])}
    docs = []
    for i in range(400):
        usual = lambda: field() if pick.random() < 0.1 else FIELD
        docs.append(receipt_json(document_id=str(i), line_items=[{n: usual() for n in S.ITEM_FIELDS}], subtotal=usual(), tax=usual(), total=usual(), currency=pick.choice([FIELD, FIELD | {"value": "EUR"}])))
    rows = spark.read.schema(S.RECEIPT).json(spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").rdd.map(lambda r: r.j))
    got = rows.select((F.size(S.faults()) == 0).alias("none"), S.holds().alias("holds")).collect()
    assert all(r.none == r.holds for r in got) and 0 < sum(r.holds for r in got) < 400


def test_prompts_are_made_once(spark, tmp_path):
    """The join of answers to documents reads the prompts that were sent, and doesn't make them, and what they come from, again."""
    log = str(tmp_path / "log")

    def noted(batches):
        for b in batches:
            with open(log, "a") as f:
                f.writelines(f"{d}\n" for d in b["document_id"])
            yield b

    asked = spark.createDataFrame([(f"d{i}", f"prompt {i}") for i in range(20)], "document_id string, prompt string").mapInPandas(noted, "document_id string, prompt string")
    got = AN.ask(asked, str(tmp_path / "store"), url="u", api_key="k", http_post=lambda url, headers, body: MC.HttpResponse(200, "x"))
    assert got.count() == len(got.collect()) == 20
    assert len(open(log).read().split()) == 20


def test_answers_are_unwrapped_once(spark):
    df = spark.createDataFrame([("a", 200, "{}")], "document_id string, status_code int, body string")
    assert plan(MC.unwrapped(df)).count("parseJson") <= 2


def test_slots_are_one_value(spark):
    """Total and tax ask which lines the slots before them took; as columns of their own those would be looked for again for each line."""
    lines = spark.createDataFrame([("a", i, t, 1.0) for i, t in enumerate(["Netto 5,00", "Netto MwSt total 1,00", "Netto total 6,00", "Tea 2 x 1,00 2,00"])], "document_id string, line_idx int, text string, confidence double")
    docs = L.extract_baseline(lines)
    row = docs.first()
    assert (row.subtotal.value, row.tax.value, row.total.value, len(row.line_items)) == (5, 1, 6, 1)
    shown = plan(docs.select("subtotal", "tax", "total", "line_items"))
    assert "_found" in shown and "_subtotal_line" not in shown


def test_profile_of_texts_without_items(spark):
    df = spark.createDataFrame([(1, '{"gt_parse":{},"meta":{"image_id":1}}'), (2, "x")], "ord int, ground_truth string")
    rows = {(r.section, r.key, r.subkey): r.n for r in P.profile_rows(df).collect()}
    assert rows["documents", "total", None] == 2 and rows["line_items", "total", None] == 0 and rows["document_field_statuses", "total", "not_present"] == 1


def test_first_error_of_an_answer(spark):
    field = lambda s="extracted": {"status": s, "value": "1"}
    item = lambda **f: {n: field() for n in S.ITEM_FIELDS} | f
    doc = {n: field() for n in S.DOCUMENT_FIELDS}
    cases = [({"line_items": [item(), item(quantity=field("x"), line_total=3)]}, "line_items[1].quantity.status unknown"), ({"line_items": [item(), 5]}, "line_items[1] not an object"), ({"line_items": [item(unit_price=7), 5]}, "line_items[0].unit_price not an object"), ({"line_items": [], "tax": 1}, "tax not an object"), ({"line_items": [item()]}, None)]
    df = spark.createDataFrame([(json.dumps(doc | c),) for c, _ in cases], "raw string")
    assert [r.error for r in MJ.adapt_model_json(df).collect()] == [e for _, e in cases]
