import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from paperproof.llm import near as N

from .cases import ODD, docs


def brute_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_kept(rows, similarity=0.8, k=5):
    """The least id of each component of pairs whose shingle sets are alike; every pair with a shingle in common is counted."""
    ids, sets = [r[0] for r in rows], [brute_set(r[1], k) for r in rows]
    root, having = list(range(len(rows))), defaultdict(list)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(i, j):
        a, b = sorted((top(i), top(j)), key=lambda x: ids[x])
        root[b] = a

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in having[x])
        for j, both in common.items():
            if both / (len(s) + len(sets[j]) - both) >= similarity:
                join(i, j)
        if not s:
            join(i, next(j for j in range(len(rows)) if not sets[j]))
        for x in s:
            having[x].append(i)
    return sorted({ids[top(i)] for i in range(len(rows))})


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert sorted(r.doc_id for r in N.without_near_copies(d).collect()) == brute_kept(rows)


def test_recall_over_a_whole_larger_table(spark):
    """sf0.1 has a few dozen pairs of different texts at 0.8 or more; whole components are compared, so one lost link shows."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    want = brute_kept(rows)
    assert len(want) < len({r[1] for r in rows})
    assert sorted(r.doc_id for r in N.without_near_copies(d).collect()) == want


def test_no_pair_of_short_texts_is_lost(spark):
    """8 words, and the same with one more: 4 of 5 shingles in common, whose fingerprints may be far apart."""
    pick = random.Random(11)
    rows, far = [], 0
    while far < 3 or len(rows) < 40_000:
        w = " ".join(f"w{pick.randrange(10**9)}" for _ in range(8))
        rows += [(len(rows), w), (len(rows) + 1, w + f" x{len(rows)}")]
        far += (N.set_print(N.shingle_set(rows[-1][1], 5)) ^ N.set_print(N.shingle_set(rows[-2][1], 5))).bit_count() > N.BITS
    assert sorted(r.doc_id for r in N.without_near_copies(docs(spark, rows)).collect()) == [r[0] for r in rows[::2]]


def test_candidates_are_all_pairs_that_may_be_alike():
    pick = np.random.default_rng(4)
    n, fps = pick.integers(0, 100, 300), pick.integers(0, 2**63, 300, dtype=np.uint64)
    got = {frozenset((i, j)) for i, later in N.candidates(fps, n, 0.8, 24) for j in later.tolist()}
    for i in range(300):
        for j in range(i):
            low, high = sorted((n[i], n[j]))
            if int(fps[i] ^ fps[j]).bit_count() <= 24 or (0 < low < N.SMALL and low >= 0.8 * high):
                assert frozenset((i, j)) in got


def test_threshold_is_met_exactly(spark):
    """Sets of 8 shingles of which 8 of 10, 0.8, and 8 of 11, under it, are shared; links are kept through a middle text."""
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w[:12])), (2, " ".join(w[:14])), (3, " ".join(w[:15])), (4, " ".join(w[:17])), (9, " ".join(w[20:40]))]
    got = [sorted(r.doc_id for r in N.without_near_copies(docs(spark, some)).collect()) for some in (rows[:2], [rows[0], rows[2]], rows)]
    assert got == [[1], [1, 3], [1, 9]]


def test_one_row_of_each_group_stays(spark):
    rows = [*ODD, (20, "One two three four five six seven."), (21, "  one TWO three four five six seven.")]
    left = N.without_near_copies(docs(spark, rows))
    assert left.columns == docs(spark, []).columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 4, 5, 6, 7, None], key=str)
    assert N.without_near_copies(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block", [N.BLOCK, 20_000])
def test_family_of_variants_under_and_over_the_threshold(spark, block):
    """Form letters mostly under 0.8 to each other and to the least of them; the few links are between arbitrary members."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.027 else f"x{rng.random()}" for w in base)) for i in range(300)]
    want = brute_kept(rows)
    assert 200 < len(want) < 300
    assert sorted(r.doc_id for r in N.without_near_copies(docs(spark, rows), block=block).collect()) == want


def test_pipeline_links_pairs_whose_fingerprints_are_far_apart(spark):
    """Pairs at 0.8 or more of sf0.1 whose fingerprints differ in 12 bits or more."""
    ids = [4, 2540, 5108, 5918, 3650, 7230]
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("doc_id").isin(ids))
    rows = [(r.doc_id, r.text) for r in d.collect()]
    want = brute_kept(rows)
    assert want == [4, 3650, 5108]
    assert sorted(r.doc_id for r in C.near_dedup(spark, d, "").collect()) == want


def leaves(tree):
    return sum(isinstance(node, int) for node in tree)


def test_near_copies_are_found_through_vantage_point_trees(spark, monkeypatch):
    """The trees cut the fingerprints into shards, and what no shard holds isn't found: there is no other path."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 1000 or doc_id in (2540, 5108, 5918, 3650, 7230)")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    want, different = brute_kept(rows), len({r[1] for r in rows})
    assert len(want) < different
    trees, build = [], N.build
    monkeypatch.setattr(N, "build", lambda *a: trees.append(build(*a)) or trees[-1])
    assert sorted(r.doc_id for r in N.without_near_copies(d, shard=64).collect()) == want
    assert len(trees) == N.BANDS and min(map(leaves, trees)) > 4
    monkeypatch.setattr(N, "route", lambda *a: iter(()))
    assert N.without_near_copies(d, shard=64).count() == different


@pytest.mark.parametrize("common, more, trees, far", [(400, 100, N.LARGE_BANDS, N.FAR), (64, 16, N.LARGE_BANDS, N.FAR), (4, 1, N.BANDS, N.FAR_SMALL), (12, 3, N.BANDS, N.FAR_SMALL)])
def test_pairs_at_the_threshold_meet_in_a_tree(common, more, trees, far):
    """Sets at 0.8 are within a tree's overlap in some band, and the checking words are no reason against them."""
    pick = np.random.default_rng(7)
    for _ in range(1000):
        h = pick.integers(0, 2**63, common + more, dtype=np.uint64)
        pair = np.stack([N.set_words(np.sort(h[:common])), N.set_words(np.sort(h))])
        assert any(int(np.bitwise_xor(*N.band(pair, b))).bit_count() <= N.NEAR for b in range(trees))
        assert np.bitwise_count(np.bitwise_xor(*pair[:, -N.CHECK :])).sum() <= far


def brute_families(rows, similarity=0.8):
    label = list(range(len(rows)))
    for i, a in enumerate(rows.tolist()):
        for j, b in enumerate(rows.tolist()[:i]):
            low, high = sorted((a[1], b[1]))
            apart = sum((x ^ y).bit_count() for x, y in zip(map(int, a[3]), map(int, b[3]), strict=True))
            if (a[2] ^ b[2]).bit_count() <= N.NEAR and low >= similarity * high and apart <= (0 if high < 5 else N.FAR_SMALL if low < N.SMALL else N.FAR):
                label = [label[j] if x == label[i] else x for x in label]
    least = {x: min(t for t, y in zip(rows["text"].tolist(), label, strict=True) if x == y) for x in label}
    return sorted((t, least[x]) for t, x in zip(rows["text"].tolist(), label, strict=True) if t != least[x])


def test_a_shard_compares_all_pairs_within_the_overlap():
    pick = np.random.default_rng(3)
    for most in (1, 7, 100, 1 << 20) * 3:
        rows = np.zeros(int(pick.integers(0, 150)), N.ROW)
        rows["text"], rows["n"] = pick.permutation(1000)[: len(rows)] - 500, pick.choice([3, 4, 5, 60, 70, 80], len(rows))
        rows["band"] = pick.choice([0, 1, 2, 3, 5, 9, 1 << 15, (1 << 15) + 1], len(rows))
        base = pick.integers(0, 2**63, (4, N.CHECK), dtype=np.uint64)[pick.integers(0, 4, len(rows))]
        noise = np.packbits(pick.random((len(rows), 64 * N.CHECK)) < 0.16, axis=1).view("<u8")
        rows["check"] = base ^ noise.reshape(len(rows), N.CHECK)
        u, v = N.shard_families(rows, 0.8, most=most)
        assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == brute_families(rows)
