"""The answer store: what is committed is never sent again."""

import json
import os
from collections import Counter

import pytest

from paperproof.sources import answers as AN
from paperproof.sources import model_client as MC

ASKED = "document_id string, prompt string"


def model(log, dies_at=None):
    """A model that writes each prompt that it gets to a file; at one prompt it ends its process, the first time."""

    def post(url, headers, body):
        prompt = body["contents"][0]["parts"][0]["text"]
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == dies_at and not os.path.exists(log + ".died"):
            open(log + ".died", "w").close()
            os._exit(1)
        busy = prompt.startswith("busy") and not os.path.exists(log + ".calm")
        return MC.HttpResponse(503 if busy else 200, {"said": prompt.upper()})

    return post


def sent(log):
    return Counter(open(log).read().split("\n")[:-1]) if os.path.exists(log) else Counter()


def answers(df):
    return {r.document_id: (r.status_code, json.loads(r.body)["said"] if r.body else None) for r in df.collect()}


def test_no_prompt_is_sent_again_after_its_commit(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    asked = spark.createDataFrame([(f"d{i}", f"prompt {i % 60}") for i in range(90)], ASKED)
    settings = {"url": "u", "api_key": "k", "per_round": 10, "per_task": 3, "threads": 2}
    with pytest.raises(Exception):  # noqa: B017  a worker that dies ends the job of a local session
        AN.ask(asked, store, http_post=model(log, "prompt 37"), **settings)
    before, kept = sent(log), {r[0] for r in AN.stored_answers(spark, store).select("body").collect()}
    done = {json.loads(b)["said"].lower() for b in kept}
    assert 0 < len(done) < 60 and "prompt 37" not in done
    got = answers(AN.ask(asked, store, http_post=model(log, "prompt 37"), **settings))
    assert got == {f"d{i}": (200, f"PROMPT {i % 60}") for i in range(90)}
    after = sent(log)
    assert all(after[p] == before[p] == 1 for p in done) and set(after) == {f"prompt {i}" for i in range(60)}
    again = sent(log)
    assert answers(AN.ask(asked, store, http_post=model(log), **settings)) == got and sent(log) == again


def test_busy_answers_are_asked_for_again_and_settings_part_keys(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    asked = spark.createDataFrame([("a", "busy one"), ("b", "fine"), ("c", None), ("c", None), (None, "fine")], ASKED)
    settings = {"url": "u", "api_key": "k", "http_post": model(log)}
    got = AN.ask(asked, store, **settings).collect()
    assert sorted((str(r.document_id), r.status_code) for r in got) == [("None", 200), ("a", 503), ("b", 200), ("c", 200), ("c", 200)]
    open(log + ".calm", "w").close()
    assert answers(AN.ask(asked.where("document_id = 'a'"), store, **settings)) == {"a": (200, "BUSY ONE")}
    assert sent(log) == {"busy one": 2, "fine": 1, "": 1}
    AN.ask(asked.where("document_id = 'b'"), store, temperature=0.5, **settings).collect()
    assert sent(log)["fine"] == 2
    assert AN.ask(asked.limit(0), store, **settings).count() == 0 and AN.ask(asked.limit(0), str(tmp_path / "none"), **settings).count() == 0


def test_receipts_by_the_store(spark, tmp_path):
    lines = spark.createDataFrame([("a", 0, "Tea 7,00"), ("b", 0, "x")], "document_id string, line_idx int, text string")
    field = {"status": "not_present", "value": None}
    said = json.dumps({"line_items": [], "subtotal": field, "tax": field, "total": {"status": "extracted", "value": "7,00"}, "currency": field})
    post = lambda url, headers, body: MC.HttpResponse(200, {"candidates": [{"content": {"parts": [{"text": said}]}}]}) if "Tea" in body["contents"][0]["parts"][0]["text"] else MC.HttpResponse(400, {"error": {"message": "no"}})
    for _ in range(2):
        got = {r.document_id: r for r in MC.extract_with_model(lines, url="u", api_key="k", http_post=post, store=str(tmp_path / "s")).collect()}
        assert got["a"].total.value == 7 and got["a"].error is None and got["b"].error == "http 400: no"
