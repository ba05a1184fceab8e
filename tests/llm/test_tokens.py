import zlib

import numpy as np
import pytest

from paperproof.llm import tokens
from paperproof.llm.queries import tokenizer_path

from .cases import ODD, docs


def brute(rows, path):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("rows", [ODD, [], [(9, None)]])
def test_digest_is_brute_force(spark, rows):
    got = tokens.token_digest(docs(spark, rows), tokenizer_path(), block_docs=3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, tokenizer_path()), key=str)


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {tuple(r) for r in tokens.token_digest(d, tokenizer_path()).collect()}
    assert got == set(brute([(r.doc_id, r.text) for r in d.collect()], tokenizer_path()))


def test_short_document_access(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens.write_tokens(d, str(tmp_path), tokenizer_path(), block_docs=16)
    whole = {r.doc_id: r.ids for r in tokens.read_tokens(spark, str(tmp_path)).collect()}
    for k in (0, 15, 16, 77, 199):
        assert tokens.read_document(spark, str(tmp_path), k) == [whole[k]]
    assert tokens.read_document(spark, str(tmp_path), 10**6) == []


def test_other_tokenizers_get_whole_texts(spark):
    texts = ["Hello  world\n\nthis is\ta test", "", "été 42"]
    e = tokens.Encoder(tokenizer_path("byte_bpe_50k.json"))
    ids, n = e(texts)
    assert not e.exact and ids.tolist() == [i for t in texts for i in e._whole(t)] and n.sum() == len(ids)


def test_wrong_dictionary_is_found(spark, tmp_path):
    d = docs(spark, [(1, "a b c")])
    tokens.write_tokens(d, str(tmp_path), tokenizer_path())
    m = spark.read.parquet(f"{tmp_path}/meta").withColumn("dict_sha256", tokens.F.lit("no")).collect()
    spark.createDataFrame(m, "format int, width int, end_id int, tokenizer string, dict_sha256 string, dict binary").write.mode("overwrite").parquet(f"{tmp_path}/meta")
    with pytest.raises(ValueError, match="hash"):
        tokens.read_tokens(spark, str(tmp_path))


def test_width_follows_the_vocabulary_and_ids_never_wrap(spark, tmp_path):
    d = docs(spark, [(1, "a b c")])
    with pytest.raises(ValueError, match="fit"):
        tokens.write_tokens(d, str(tmp_path / "end"), tokenizer_path(), end_id=70_000, width=2)
    tokens.write_tokens(d, str(tmp_path / "wide"), tokenizer_path(), end_id=70_000)
    assert tokens._meta(spark, str(tmp_path / "wide"))[0] == 4
    assert tokens.read_tokens(spark, str(tmp_path / "wide")).first().ids[-1] == 70_000
    with pytest.raises(ValueError, match="fit"):
        tokens._checked(tokens.np.array([1, 70_000], tokens.np.uint32), 2)


def test_few_documents_have_a_dictionary_too(spark, tmp_path):
    d = docs(spark, [(i, "some words of a short text") for i in range(3)])
    tokens.write_tokens(d, str(tmp_path), tokenizer_path())
    assert tokens._meta(spark, str(tmp_path))[1]
    assert len(tokens.read_document(spark, str(tmp_path), 1)) == 1
