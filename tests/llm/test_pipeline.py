import numpy as np

import __spark_entry__
import corpus_pipeline as C

from .test_decontaminate import brute_tiles
from .test_mixing import brute_copies
from .test_near import brute_kept
from .test_quality import out as held_out
from .test_quality import plain_scores, plain_statistics
from .test_tokens import brute as brute_tokens
from .cases import ODD, docs

SF = "/root/testdata/sf0.001"


def plain_quality(texts, labels):
    """Whether each text is good, by statistics counted anew and a discriminant of full covariances."""
    marks = {r.doc_id: r.quality for r in labels}
    y = np.array([-1 if held_out(k) or marks.get(k) not in (0, 1) else marks[k] for k in texts])
    scores = plain_scores(np.array([plain_statistics(t) for t in texts.values()]), y)
    return dict(zip(texts, scores >= 0.5, strict=True))


def plain_words(text):
    """Runs of letters, digits and characters beyond ASCII, lower-cased in ASCII."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low).split(" ")


def plain_hits(texts, items, k=5, threshold=0.5):
    """Texts that tiles of an item cover half of, by the definition of the greedy tiling; only pairs with a run of k words in common are tried."""
    bad, worded = set(), {i: [w for w in plain_words(t) if w] for i, t in texts.items()}
    runs = lambda w: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    seen = {i: runs(w) for i, w in worded.items()}
    for t in items:
        p = [w for w in plain_words(t) if w]
        for i in texts:
            if i not in bad and runs(p) & seen[i] and sum(n for *_, n in brute_tiles(p, worded[i], k)) >= threshold * len(p):
                bad.add(i)
    return bad


def test_every_stage_against_a_plain_version(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in d.collect()}
    for name, stage in C.STAGES:
        out = stage(spark, d, SF)
        got = out.collect()
        if name != "tokenize":
            assert out.schema == d.schema and all(tuple(r) == tuple(rows[r.doc_id]) for r in got)
        kept = [r.doc_id for r in got]
        before = [r.doc_id for r in d.collect()]
        if name == "quality":
            good = plain_quality({k: rows[k].text for k in before}, spark.read.parquet(f"{SF}/labels.parquet").collect())
            want = [k for k in before if good[k]]
            assert 0 < len(want) < len(before)
        elif name == "near_dedup":
            want = brute_kept([(k, rows[k].text) for k in before])
        elif name == "decontaminate":
            bad = plain_hits({k: rows[k].text for k in before}, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
            want = [k for k in before if k not in bad]
            assert bad
        elif name == "mix":
            want = [k for k, n in brute_copies([(k, rows[k].text, rows[k].source) for k in before]).items() for _ in range(n)]
        else:
            assert sorted(map(tuple, got)) == sorted(brute_tokens([(r.doc_id, r.text) for r in d.collect()], C.tokenizer_path()))
            break
        assert sorted(kept) == sorted(want)
        d = C.stored(out, name)


def test_odd_documents(spark):
    d = docs(spark, ODD)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        assert stage(spark, d.limit(0), SF).count() == 0, name
        d = C.stored(out, name)
    assert C.STAGES[-1][1](spark, d, SF).count() == d.count()


def test_run_is_registered(spark):
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
