import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paperproof.llm import mixing as M

from .cases import ODD, docs

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight; what passes a cap is shared again among the rest."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), {}
    while True:
        left = total - sum(full.values())
        open_ = [s for s in order if s not in full]
        got = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s: most * sizes[s] for s in open_ if got[s] > most * sizes[s]}
        if not over:
            return got | full
        full |= over


def check(spark, rows):
    plan = M.mix_plan(docs(spark, rows)).collect()
    size = lambda text: len([x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x])
    assert sorted(((r.doc_id, r.source, r["size"]) for r in plan), key=str) == sorted(((r[0], r[2] if len(r) > 2 else "s", size(r[1])) for r in rows), key=str)
    sizes = defaultdict(int)
    for r in plan:
        sizes[r.source] += r["size"]
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * max((r["size"] for r in plan if r.source == s), default=0) + 1
    return plan


@pytest.mark.parametrize("rows", [[], [(1, "a b", None)], [*ODD, (8, "x y", None), (9, "z", "t"), (10, "", "empty")]])
def test_odd_documents(spark, rows):
    check(spark, rows)


def test_whole_table_and_rerun(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in d.collect()]
    first, second = check(spark, rows), check(spark, list(reversed(rows)))
    assert sorted((r.doc_id, r.copies) for r in first) == sorted((r.doc_id, r.copies) for r in second)


def brute_copies(rows, seed=42):
    """Copies of each of rows (doc_id, text, source): a running sum over the source's rows in order of size, and the integers it crosses."""
    size = lambda r: len([x for x in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if x])
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    sizes = {s: sum(map(size, rs)) for s, rs in by.items()}
    want = brute_targets(sizes)
    out = {}
    for s, rs in by.items():
        total = int(hashlib.md5(f"{seed}:{s or ''}".encode()).hexdigest()[:8], 16) / 2**32
        rate = want[s] / sizes[s] if sizes[s] else 0.0
        for k, r in enumerate(sorted(rs, key=lambda r: (size(r), r[0])), 1):
            out[r[0]] = math.floor(k * rate + total) - math.floor((k - 1) * rate + total)
    return out


def test_rows_are_repeated_as_planned(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in d.collect()]
    got = M.mixed(d)
    assert got.columns == d.columns
    n = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {k: v for k, v in brute_copies(rows).items() if v}


def test_equal_rows_share_their_copies(spark):
    rows = [*ODD, (8, "x y", None), (8, "x y", None), (8, "x y", None), (None, "x y", None), (None, None, None)]
    plan, got = M.mix_plan(docs(spark, rows)), M.mixed(docs(spark, rows))
    want = {(r.doc_id, r.source): r.n for r in plan.groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect() if r.n}
    assert {(r.doc_id, r.source): r.n for r in got.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()} == want
    assert M.mixed(docs(spark, [])).count() == 0
