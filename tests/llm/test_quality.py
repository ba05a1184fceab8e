import math
import string
import zlib

import numpy as np
import pytest

from paperproof.llm import quality as Q

from .cases import ODD, docs


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def brute(rows, labels):
    marks = {}
    for i, q in labels:
        if i is not None and q in (0, 1) and not out(i):
            marks.setdefault(i, set()).add(q)
    x = np.array([Q.statistics(t) for _, t in rows]).reshape(-1, len(Q.NAMES))
    y = np.array([min(marks[i]) if len(marks.get(i, ())) == 1 else -1 for i, _ in rows])
    m = Q.fitted({k: (float((y == k).sum()), x[y == k].sum(0), x[y == k].T @ x[y == k]) for k in (0, 1)})
    return sorted(((i, out(i), round(float(s), 6), int(s >= 0.5)) for (i, _), s in zip(rows, m.scores(x), strict=True)), key=str)


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 1), (3, None), (4, 1), (4, 0), (5, 2), (None, 1), (6, 1)], [(1, 1), (2, 1), (5, 1)]])
def test_odd_documents(spark, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = sorted(((r.doc_id, r.held_out, round(r.score, 6), r.predicted) for r in Q.quality_scores(docs(spark, ODD), lab).collect()), key=str)
    assert got == brute(ODD, labels)
    assert Q.quality_scores(docs(spark, []), lab).count() == 0
    left = Q.good_documents(docs(spark, ODD), lab)
    assert left.columns == docs(spark, []).columns and left.count() == sum(p for *_, p in got)


def test_held_out_accuracy(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.quality_scores(d, lab).collect()}
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.doc_id, r.quality) for r in lab.collect()])
    assert sorted(((r.doc_id, r.held_out, round(r.score, 6), r.predicted) for r in got.values()), key=str) == want
    hits = [got[r.doc_id].predicted == r.quality for r in lab.collect() if got[r.doc_id].held_out]
    assert len(hits) > 100 and np.mean(hits) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = lab.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    a, b = ({r.doc_id: r.score for r in Q.quality_scores(d, x).collect()} for x in (lab, other))
    assert a == pytest.approx(b)


def plain_statistics(text):
    """The statistics by counting characters and words, without the operator's tables."""
    t = text or ""
    size = len(t.encode())
    n_of = lambda chars: sum(t.count(c) for c in chars)
    upper, lower, beyond = n_of(string.ascii_uppercase), n_of(string.ascii_lowercase), sum(len(c.encode()) for c in t if ord(c) > 127)
    words, lines = [w.decode() for w in t.encode().split()], [x for x in t.split("\n") if x]
    lengths, seen, again = [len(w.encode()) for w in words], set(), 0
    for x in lines:
        again += len(x.encode()) if x in seen else 0
        seen.add(x)
    n, n_words = size + 120, len(words) + 20
    shares = [(upper + 2) / (upper + lower + beyond + 100), (t.count("\n") + 1) / n_words, n_of("!?") / n, t.count("|") / n, n_of("#$%&*@^~_<>\\{}[]`") / n, (n_of(".,;:") + 3) / n, beyond / n]
    distinct = math.log1p((len(set(words)) + 18) / n_words**0.8)
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [math.asin(math.sqrt(min(1, x))) for x in shares] + [math.log((sum(lengths) + 100) / n_words), (sum(x <= 3 for x in lengths) + 9) / n_words, distinct, again / (n + 400), doubled / n_words]


def plain_scores(x, y, pool=0.1, sphere=0.02, temperature=4.0):
    """The discriminant by full covariances: inverses and determinants, no factors, no sums of products. y is 0, 1 or -1 (not learnt from)."""
    parts = [x[y == k] for k in (0, 1)]
    cov = [np.cov(p, rowvar=False, bias=True) for p in parts]
    n = [len(p) for p in parts]
    pooled = (cov[0] * n[0] + cov[1] * n[1]) / sum(n)
    unit = np.maximum(np.diag(pooled), 1e-9) ** 0.5
    logs = []
    for k in (0, 1):
        s = ((1 - pool) * cov[k] + pool * pooled) / unit / unit[:, None]
        s = (1 - sphere) * s + sphere * np.diag(s).mean() * np.eye(len(s))
        z = (x - parts[k].mean(axis=0)) / unit
        logs.append(math.log(n[k] / sum(n)) - (np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) + np.linalg.slogdet(s)[1]) / 2)
    return 1 / (1 + np.exp((logs[0] - logs[1]) / temperature))


def test_scores_follow_their_definition(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows, marks = d.collect(), {r.doc_id: r.quality for r in lab.collect()}
    x = np.array([plain_statistics(r.text) for r in rows])
    assert x == pytest.approx(np.array([Q.statistics(r.text) for r in rows]), abs=1e-9)
    for t in ("", "A", "\n\n", "a a a\na a a\n", "Ä|ß !? 12", "\x1c\xa0 x"):
        assert Q.statistics(t) == pytest.approx(plain_statistics(t), abs=1e-9)
    y = np.array([-1 if out(r.doc_id) or marks.get(r.doc_id) not in (0, 1) else marks[r.doc_id] for r in rows])
    got = {r.doc_id: r.score for r in Q.quality_scores(d, lab).collect()}
    assert [got[r.doc_id] for r in rows] == pytest.approx(plain_scores(x, y).tolist(), abs=1e-5)
