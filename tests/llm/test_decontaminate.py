import random

import pytest

from paperproof.llm import decontaminate as D

from .cases import ODD, docs


def brute_tiles(p, t, least):
    """Greedy tiling by its definition: the longest unmarked common run first, ties by position."""
    up, ut, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and i + n not in up and j + n not in ut:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        up |= set(range(i, i + n))
        ut |= set(range(j, j + n))
        out.append((i, j, n))


@pytest.mark.parametrize("seed", range(60))
def test_tiles_cover_as_greedy_tiling_does(seed):
    rng = random.Random(seed)
    p = [rng.choice("abcd" if seed % 2 else "abcdefghij") for _ in range(rng.randint(0, 40))]
    t = [rng.choice("abcde") for _ in range(10)] + p[20:] + ["z"] + p[:20] + [rng.choice("abcde") for _ in range(20)]
    got, want = D.tiles(p, t, 3), brute_tiles(p, t, 3)
    assert sorted(got) == sorted(want)
    for i, j, n in got:
        assert p[i : i + n] == t[j : j + n] and n >= 3


def brute(rows, bench, k=5, threshold=0.5):
    out = []
    for d, text in rows:
        for i, b in bench:
            w = D.plain_words(b)
            if w:
                got = brute_tiles(w, D.plain_words(text), min(k, len(w)))
                if (c := sum(x[2] for x in got) / len(w)) >= threshold:
                    out.append((d, i, round(c, 9)))
    return sorted(out, key=str)


def test_repeated_words_are_no_product():
    import time

    began = time.process_time()
    assert D.Block([(1, "a " * 200)], 5, 0.5)("a " * 40_000) == [(1, 1.0, 1, 200)]
    assert time.process_time() - began < 2


@pytest.mark.parametrize("block_chars", [8 << 20, 60])
def test_reordered_passages_and_odd_documents(spark, block_chars):
    item = "Alpha beta gamma delta epsilon zeta, eta theta iota kappa lambda mu. Nu xi omicron pi rho sigma"
    w = item.split()
    rows = [*ODD[:5], (10, "Before. " + " ".join(w[12:] + ["x"] + w[6:12] + ["y"] + w[:6])), (11, " ".join(w[:5])), (12, "ALPHA " + item.lower()), (13, " ".join(w[:9]) + " Z"), (14, " ".join(w[:8]))]
    bench = [(1, item), (2, item), (3, None), (4, "One two"), (5, "six seven eight nine ten eleven twelve"), (6, "")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, round(r.coverage, 9)) for r in D.contaminated(docs(spark, rows), b, block_chars=block_chars).collect()), key=str)
    assert got == brute(rows, bench)
    assert {10, 12, 13} <= {d for d, *_ in got} and not {11, 14} & {d for d, *_ in got}
    left = D.decontaminated(docs(spark, rows), b, block_chars=block_chars)
    bad = {d for d, *_ in got}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in rows if d not in bad)
    assert left.columns == docs(spark, []).columns


def test_empty_sides(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs(spark, ODD), b).count() == 0
    assert D.decontaminated(docs(spark, ODD), b).count() == len(ODD)
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(docs(spark, []), one).count() == D.contaminated(docs(spark, []), one, block_chars=1).count() == 0
    assert D.decontaminated(docs(spark, ODD), one, block_chars=1).count() == len(ODD)


def test_table_finds_every_verbatim_passage_and_nothing_else(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows = sorted(map(tuple, D.contaminated(d, b).collect()))
    assert rows == sorted(map(tuple, D.contaminated(d, b, block_chars=1).collect()))
    got = {r[:2] for r in rows}
    items = [(r.item_id, " ".join(x.decode() for x in D.plain_words(r.text))) for r in b.collect()]
    texts = [(r.doc_id, " ".join(x.decode() for x in D.plain_words(r.text))) for r in d.collect()]
    verbatim = {(doc, i) for doc, t in texts for i, x in items if x in t}
    assert verbatim and verbatim <= got
    five = lambda s: {tuple(s.split()[k : k + 5]) for k in range(len(s.split()) - 4)}
    grams, by = {i: five(x) for i, x in items}, dict(texts)
    assert all(len(grams[i] & five(by[doc])) >= 0.3 * len(grams[i]) for doc, i in got)


def test_shared_boilerplate_makes_no_candidates(spark):
    """300 items and 300 texts share 12 words, which no item is half of; what is asked about grows with the hits alone."""
    shared = " ".join(f"boiler{i}" for i in range(12))
    own = lambda name, i, n: " ".join(f"{name}{i}x{k}" for k in range(n))
    bench = [(i, own("item", i, 15) + " " + shared + " " + own("tail", i, 15)) for i in range(300)]
    rows = [(i, own("doc", i, 20) + " " + shared) for i in range(300)] + [(1000 + i, own("new", i, 9) + " " + bench[i][1]) for i in range(4)]
    b = spark.createDataFrame(bench, "item_id long, text string")
    seeds = D.item_seeds(b.withColumnRenamed("item_id", "item"), 5)
    met = D.item_seeds(docs(spark, rows).select(D.F.col("doc_id").alias("item"), "text"), 5).withColumnRenamed("item", "row").join(seeds.select("k", "h").distinct(), ["k", "h"], "left_semi")
    assert sorted(map(tuple, D.candidate_pairs(met, seeds, 0.5).select("row", "item").collect())) == [(1000 + i, i) for i in range(4)]
    got = D.contaminated(docs(spark, rows), b, block_chars=1).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got) == [(1000 + i, i, 1.0) for i in range(4)]


@pytest.mark.parametrize("seed", range(30))
def test_a_hit_holds_a_seed_that_is_asked_for(seed):
    import numpy as np

    rng = random.Random(seed)
    item = [rng.choice("abcdefg").encode() for _ in range(rng.randint(3, 30))]
    k, threshold = min(3, len(item)), rng.choice([0.3, 0.5, 0.9])
    h = D._gram_hashes(D._word_hashes(item), k)
    often = np.array([{x: rng.randint(1, 9) for x in set(h.tolist())}[x] for x in h.tolist()])
    wanted = set(D.asked(k, len(item), h.view(np.int64), np.arange(len(h)), often, threshold).tolist())
    for _ in range(60):
        text = [rng.choice(item) if rng.random() < 0.2 else b"-" for _ in range(3)] + item[rng.randint(0, len(item)) :] + item[: rng.randint(0, len(item))]
        if sum(n for *_, n in D.tiles(item, text, k)) >= threshold * len(item):
            assert wanted & set(D._gram_hashes(D._word_hashes(text), k).view(np.int64).tolist())
