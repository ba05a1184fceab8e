import hashlib
import zlib

import numpy as np
import pytest
import xxhash

from paperproof.llm import minhash
from paperproof.llm.minhash import MinHash, edited_pairs

from .cases import ODD, docs


def brute(rows):
    m = MinHash()
    tie = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1] or ""), r[1] or ""))
    out = []
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = m.codes(text), m.codes(edited), m.codes(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), m.pack(a), m.pack(b), m.likeness(a, b), m.likeness(a, c)))
    return out


@pytest.mark.parametrize("rows", [ODD, ODD[:1], [], [r for r in ODD if r[0]], [(None, "a"), (None, "b")]])
def test_pairs_are_brute_force(spark, rows):
    got = edited_pairs(docs(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("ids", [(None,), (5,), (None, 5), (None, 1, 5), (1, 900), (900,)])
def test_frequent_ids_are_cut_into_parts(spark, ids):
    rows = [(i, f"text {i} {k}") for i in ids for k in range(150)] + [(i, f"text {i}") for i in range(2, 300)] + [(ids[0], "same words")] * 40
    got = edited_pairs(docs(spark, rows), per_partition=2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)
    d = docs(spark, [(5, str(k)) for k in range(800)]).withColumn("tie", minhash.F.xxhash64("text"))
    sizes = [r["count"] for r in d.groupBy(minhash.part_of([2, 5, 9], [1, 8, 1], 0)("doc_id", "tie").alias("part")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 150


def test_plan_is_as_long_for_many_parts(spark, capsys):
    rows, sizes = [(i, f"text {i}") for i in range(3000)], []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (4, 1000):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        sizes.append(len(edited_pairs(docs(spark, rows))._jdf.queryExecution().optimizedPlan().toString()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sizes[1] < sizes[0] + 3000


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, edited_pairs(d).collect())) == sorted(brute([(r.doc_id, r.text) for r in d.collect()]))


@pytest.mark.parametrize(("bins", "bits"), [(256, 8), (256, 4), (512, 2), (1024, 1)])
def test_likeness_estimates_jaccard(bins, bits):
    rng = np.random.default_rng(bins + bits)
    m, errors = MinHash(5, bins, bits), []
    for n in (12, 60, 400, 3000):
        for share in (0.0, 0.3, 0.7, 0.95):
            for _ in range(12):
                w = [f"w{x}" for x in rng.integers(0, 10**9, 2 * n)]
                cut = int(n * share)
                a, b = w[:n], w[:cut] + w[n : 2 * n - cut]
                s, t = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
                errors.append(m.likeness(m.codes(" ".join(a)), m.codes(" ".join(b))) - len(s & t) / len(s | t))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.09
    assert len(m.pack(m.codes("x"))) == bins * bits // 4


def test_equal_texts_have_equal_fingerprints():
    m = MinHash()
    assert m.pack(m.codes("")) == m.pack(m.codes(None)) == m.pack(m.codes(" \n"))
    assert m.likeness(m.codes(""), m.codes("")) == 1 and m.likeness(m.codes(""), m.codes("one two three")) < 0.05


def plain_codes(text, k=5, bins=256, bits=8):
    """The fingerprint in whole numbers, from its definition alone: hash words and shingles, least hash by bin, empty bins ask others."""
    mask = 2**64 - 1

    def mixed(x):
        x = (x + 0x9E3779B97F4A7C15) & mask
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if len(words) < k:
        hashes = [mixed(zlib.crc32(b" ".join(words)) + len(words))]
    else:
        own = [mixed(zlib.crc32(w) | len(w) << 32) for w in words]
        hashes = []
        for i in range(len(words) - k + 1):
            h = 0
            for x in own[i : i + k]:
                h = mixed(h ^ x)
            hashes.append(h)
    least = {}
    for h in hashes:
        b = h * bins >> 64
        least[b] = min(h, least.get(b, h))
    out = []
    for b in range(bins):
        asked, t = b, 0
        while asked not in least:
            asked, t = mixed(mixed(b | t << 32)) % bins, t + 1
        out.append(mixed(least[asked]) % 2**bits)
    return out


@pytest.mark.parametrize("text", ["", "One", "a b c d", "a b c d e", " ".join(f"w{i * i % 97}" for i in range(60)), " ".join(f"w{i}" for i in range(900)), "Ä ß \u00a0x Y z a b"])
def test_codes_follow_their_definition(text):
    assert MinHash().codes(text).tolist() == plain_codes(text)
