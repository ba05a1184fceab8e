import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperproof.llm import divergence as D
from paperproof.llm.queries import op13_source_divergence

from .cases import ODD

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
KIND = "doc_id long, text string, lang string, source string, n long, docs long, part string, item string, rank int"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, min_docs=3, top=200):
    """rows: (text, lang, source)"""
    groups, held, own = sorted({(x or "", s or "") for _, x, s in rows}), defaultdict(set), defaultdict(Counter)
    for i, (text, lang, source) in enumerate(rows):
        for t in TERM.findall(lowered(text)):
            held[lang or "", t].add(i)
            own[lang or "", source or ""][t] += 1
    out = []
    for lang, source in groups:
        kept = sorted(t for x, t in held if x == lang and len(held[x, t]) >= min_docs)
        others = [s for x, s in groups if x == lang]
        p = {s: {t: 1 + 10**9 * (own[lang, s][t] + 1) // (sum(own[lang, s][k] for k in kept) + len(kept)) for t in kept} for s in others}
        whole = {t: sum(own[lang, s][t] for s in others) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        mine = p[source]
        pairs = [(s, sum((mine[t] - p[s][t]) ** 2 // p[s][t] for t in kept)) for s in others if s != source]
        terms = [(t, (mine[t] - q[t]) ** 2 // q[t]) for t in kept if own[lang, source][t] and mine[t] > q[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            out += [(lang, source, part, x, v, k + 1) for k, (x, v) in enumerate(sorted(items, key=lambda y: (-y[1], y[0].encode()))[:most])]
    return sorted(out)


def got(spark, rows, **settings):
    table = spark.createDataFrame([(i, *r, 5, 5, "p", "i", 1) for i, r in enumerate(rows)], KIND)
    return sorted(map(tuple, D.source_divergence(table, **settings).collect()))


def texts(seed, n):
    pick = random.Random(seed)
    words = ["The", "the", "tHE", "é", "É", "漢字", "a1b", "x-y", "có", "z", "İ", "ß"] + [chr(97 + i) * 2 for i in range(20)]
    return [(" ".join(pick.choices(words, k=pick.randint(0, 30))), pick.choice(["en", "de", None, ""]), pick.choice([None, "", "s1", "s2", "é", "z"])) for _ in range(n)]


@pytest.mark.parametrize("min_docs,top", [(1, 2), (3, 200), (50, 200)])
def test_against_the_definition(spark, min_docs, top):
    rows = [*texts(1, 120), *((t, "en", "odd") for _, t in ODD if not t or len(t) < 999), ("", "fr", "a"), (None, "fr", "b"), ("", "it", "alone"), ("one " * 3000, "en", "long")]
    assert got(spark, rows, min_docs=min_docs, top=top) == brute(rows, min_docs, top)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_one_source_and_one_word_hold_most(spark):
    rows = [("common common word", "en", "hot")] * 400 + [(f"common own{chr(97 + i % 9)}", "en", f"s{i % 5}") for i in range(60)]
    assert got(spark, rows) == brute(rows)


def test_many_sources(spark):
    pick = random.Random(5)
    rows = [(" ".join(pick.choices([chr(97 + i) for i in range(26)], k=8)), "en", f"s{i % 60}") for i in range(400)]
    assert got(spark, rows) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZ é漢0-\n_", max_size=8), max_size=6))
def test_bounds_are_the_pattern(rows):
    raw = [r.encode() for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    whole = b"".join(raw)
    row, p, q = D.bounds(np.frombuffer(whole, np.uint8), offsets)
    assert [(i, whole[a:b].decode()) for i, a, b in zip(row, p, q, strict=True)] == [(i, t) for i, r in enumerate(rows) for t in TERM.findall(r)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=4), min_size=1, max_size=40), st.sampled_from([len, lambda x: 7, lambda x: x[0]]))
def test_colliding_digests_are_told_apart(words, digest):
    raw = "".join(words).encode()
    stops = np.cumsum([len(w) for w in words])
    starts = stops - [len(w) for w in words]
    group, first = D.grouped(raw, starts, stops, digest)
    assert [words[first[g]] for g in group] == words and len({*group.tolist()}) == len({*words})


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**14), st.integers(1, 8 * 10**15))
def test_probability_is_exact(n, whole):
    n = min(n, whole - 1)
    assert D.probability(np.array([n]), np.array([whole])).tolist() == [1 + 10**9 * (n + 1) // whole]


@pytest.mark.parametrize("block", [1, 600, 1 << 20])
def test_blocks_of_terms_sum_alike(block):
    pick = np.random.default_rng(2)
    counts = pick.integers(0, 3, (500, 40)) * pick.integers(0, 9, (500, 40))
    rows, who = np.nonzero(counts)
    order = np.argsort(who, kind="stable")
    rows, who = rows[order], who[order]
    x = D.Language([f"s{i}" for i in range(40)], counts.sum(0).tolist(), 500, block)
    x.add(who, counts[rows, who], rows, 500)
    p = D.probability(counts, x.sizes[None, :])
    assert (x.sums == np.array([[D.divergence(p[:, s], p[:, t]).sum() for t in range(40)] for s in range(40)])).all()


def test_whole_table_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = op13_source_divergence(spark, SF)
    cur = con.execute(D.ORACLE)
    assert [c[0] for c in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
