import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperproof.llm import pieces as P
from paperproof.llm.queries import op11_pieces, tokenizer_path

from .cases import ODD, docs

SF = "/root/testdata/sf0.001"
MODEL = tokenizer_path("piece_bpe_32k.model")
BITS = ["  ", " ", "\n", "th", "the", "ing", "▁", "é", "ß", "漢字", "😀", "\t", "12", "<s>", "<0x41>", "\x00", "،ر", "ง", "'s", "....", "====", "́", "𝕏", "aaa", " ", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def ids(text):
    return P.pieces(MODEL).encode([text.encode()])[0].tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(BITS), st.text(max_size=6)), max_size=20).map("".join))
def test_encodes_as_the_library(library, text):
    assert ids(text) == library.encode(text)
    got, n = P.pieces(MODEL).encode([text.encode(), b"", b" " + text.encode()])
    assert got.tolist() == library.encode(text) + library.encode(" " + text) and n[1] == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.sampled_from([0, 1, 2, 13, 259, 28705]), st.integers(3, 258)), max_size=10))
def test_decodes_any_ids_as_the_library(library, some):
    assert P.pieces(MODEL).decode(np.array(some, np.int32), np.array([0, len(some)])) == [library.decode(some)]


def merged(coder, text):
    """The merges by their definition."""
    symbols = list(text)
    while True:
        ranks = [coder.order.get(a + b, np.inf) for a, b in zip(symbols, symbols[1:], strict=False)]
        if not ranks or min(ranks) == np.inf:
            return symbols
        i = ranks.index(min(ranks))
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_neighbours_fit_exactly_where_their_merge_keeps_them():
    coder, pick = P.Pieces(MODEL), random.Random(3)
    some = pick.choices(sorted(coder.id), k=300)
    near = [p for p in coder.id if set(p) <= set("▁ethand")]
    pairs = [*zip(some, pick.choices(sorted(coder.id), k=300), strict=True), *((pick.choice(near), pick.choice(near)) for _ in range(3000))]
    said = [coder.fits(a, b) for a, b in pairs]
    assert said == [merged(coder, a + b) == [a, b] for a, b in pairs] and len(set(said)) == 2
    assert all(coder.fits("", p) == (merged(coder, p) == [p]) for p in some)


def test_longest_matches_are_taken_back(library):
    coder = P.Pieces(MODEL)
    words = {w for r in ("thanderingsh", "beredtheress", "ouverneraient", "unterschiedlicherweise") for i in range(len(r)) for w in (r[i:] + r[:i], r[i:])}
    greedy = [[p for _, p in coder.automaton.iter_long("▁" + w)] for w in words]
    true = [[coder.piece[i] for i in coder.encode([w.encode()])[0]] for w in words]
    assert any(g != t for g, t in zip(greedy, true, strict=True))
    assert true == [library.encode(w, out_type=str) for w in words]


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 30_000, "漢字" * 20_000, "=-" * 30_000, "theand" * 20_000, "word " * 40_000, "é\n" * 9_000])
def test_long_texts_without_breaks(library, text):
    assert ids(text) == library.encode(text)


def test_few_remembered_segments_change_nothing():
    small, text = P.Pieces(MODEL, keep=3), [f"some words {i} ofthe text{i}".encode() for i in range(200)]
    got = [small.encode(text[i : i + 20])[0].tolist() for i in range(0, 200, 20)]
    assert sum(got, []) == P.pieces(MODEL).encode(text)[0].tolist()


def digest(library, text):
    got = library.encode(text or "")
    return len(got), hashlib.sha256(",".join(map(str, got)).encode()).hexdigest(), hashlib.sha256(library.decode(got).encode()).hexdigest()


def test_odd_documents(spark, library):
    table = docs(spark, ODD)
    got = P.piece_digest(table, MODEL).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=r[0], n_tokens=a, ids_sha256=b, decoded_sha256=c)) for r in ODD for a, b, c in [digest(library, r[1])])
    assert P.piece_digest(docs(spark, []), MODEL).collect() == []
    whole = P.encoded(table.withColumnRenamed("size", "ids"), MODEL)
    assert set(whole.columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard", "ids", "fingerprint", "label"}
    back = P.decoded(whole, MODEL, text="label").collect()
    assert all(r.label == (r.text or "") and r.shard == 7 for r in back)


def test_null_ids_decode_to_nothing(spark):
    table = spark.createDataFrame([(1, [264, None]), (2, None), (3, [])], "k int, ids array<int>").where("k > 1")
    assert [r.decoded for r in P.decoded(table, MODEL).orderBy("k").collect()] == ["", ""]


def test_whole_table(spark, library):
    want = sorted((r.doc_id, *digest(library, r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, op11_pieces(spark, SF).collect())) == want
