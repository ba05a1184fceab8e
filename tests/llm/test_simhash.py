import re

import numpy as np
import pytest
import xxhash

from paperproof.llm import simhash as S

from .cases import ODD, docs


def brute_fp(text, k=3):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, fps, bits):
    left, comp = set(range(len(ids))), {}
    while left:
        todo = [left.pop()]
        found = [*todo]
        while todo:
            i = todo.pop()
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= bits}
            left -= near
            todo += near
            found += near
        for i in found:
            comp[i] = min((ids[j] for j in found if ids[j] is not None), default=None)
    return comp


def check(spark, rows, bits=2, **settings):
    got = sorted(map(tuple, S.simhash_groups(docs(spark, rows), bits=bits, **settings).collect()), key=str)
    fps = [brute_fp(r[1]) for r in rows]
    comp = brute_groups([r[0] for r in rows], fps, bits)
    assert got == sorted(((r[0], f"{fps[i]:016x}", comp[i]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("rows", [ODD, [], [(5, None)]])
def test_odd_documents(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize(("bits", "bands"), [(6, 1), (9, 5), (11, 3)])
def test_whole_table(spark, bits, bands):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in d.collect()], bits=bits, bands=bands, shard_rows=16)


@pytest.mark.parametrize("bits", [0, 2, 6])
def test_every_close_pair_meets(bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base[rng.integers(0, 40, 3000)] ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)), rng.integers(0, 2**63, 2000, dtype=np.uint64)]))
    tree = S.build(x, 64, bits)
    at = [set() for _ in x]
    for shard, rows in S.route(x, tree, bits):
        for i in rows.tolist():
            at[i].add(shard)
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= bits, 1))
    assert all(at[a] & at[b] for a, b in zip(i.tolist(), j.tolist(), strict=True))
    member, centre = S.stars(x, bits, leaf=64)
    comp = brute_groups(x.tolist(), x.tolist(), bits)
    want = {v: comp[k] for k, v in enumerate(x.tolist())}
    got = dict(zip(member.tolist(), centre.tolist(), strict=True))
    assert {v: got.get(v, v) for v in want} == want


@pytest.mark.parametrize(("bits", "bands"), [(7, 4), (9, 5), (3, 4)])
def test_bands_lose_no_close_pair(bits, bands):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 2**63, 600, dtype=np.uint64)[rng.integers(0, 600, 3000)]
    for _ in range(bits // 2 + 1):
        x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    x = np.unique(x)
    whole = {v: c for v, c in zip(*(a.tolist() for a in S.stars(x, bits, leaf=10_000)), strict=True)}
    best = {v: v for v in x.tolist()}
    for mask in S.band_masks(bands):
        for v, c in zip(*(a.tolist() for a in S.stars(x, bits, mask, bits // bands, leaf=32)), strict=True):
            a, b = sorted((best[v], best[c]))
            best = {k: a if r == b else r for k, r in best.items()} if a != b else best
    assert {v: whole.get(v, v) for v in best} == best


def test_connected_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (3, 4)]
    got = dict(map(tuple, S.connected(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(61)} | {k: 1000 for k in range(1000, 1200)}
