import hashlib
import re
from collections import defaultdict

import pytest

from paperproof.llm import lines as L

from .cases import ODD, docs

SF = "/root/testdata/sf0.001"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


def brute(rows, min_docs):
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add((doc_id, text or ""))
    gone = {k for k, d in held.items() if len(k) >= 1 and len(d) >= min_docs}
    out = []
    for doc_id, text in rows:
        every = (text or "").split("\n")
        left = [x for x in every if key(x) not in gone]
        out.append((doc_id, len(every), len(every) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def got(spark, rows, min_docs, **settings):
    return sorted(map(tuple, L.without_frequent_lines(docs(spark, rows), min_docs=min_docs, **settings).collect()), key=str)


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_odd_documents(spark, min_docs):
    rows = [*ODD, (8, "Same line\n\nother\n same LINE\t"), (9, "SAME LINE"), (10, "same line\n\n\n"), (11, "\nÄ\nä")]
    assert got(spark, rows, min_docs) == brute([r[:2] for r in rows], min_docs)
    assert got(spark, [], min_docs) == []


def test_a_line_in_very_many_documents_and_twice_in_one(spark):
    rows = [(i, f"common\nown {i}\ncommon\nnine {i // 9}") for i in range(500)]
    assert got(spark, rows, 10) == brute(rows, 10)


def test_whole_table_by_digest(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted(((a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in brute(rows, 10)), key=str)
    assert got(spark, rows, 10, digest=True) == want
    assert any(r[2] for r in want)


def test_bitmaps_say_which_lines_stay(spark):
    rows = [(i, f"head\nbody {i}\nfoot") for i in range(12)]
    for r in L.keep_bitmaps(docs(spark, rows)).collect():
        assert (r.n_lines, r.n_dropped) == (3, 2)
        assert L.kept_lines(["head", "body", "foot"], r.keep) == ["body"]
