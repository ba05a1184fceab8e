"""Token-ID / binary output: documents as token ids in blocks of zstandard frames with one shared dictionary.

A token file set is two Parquet tables, so that any store Spark can write to will do and a lost task leaves nothing behind:

* ``meta``: one row: format version, id width, end id, tokenizer file name, dictionary and its SHA-256.
* ``blocks``: one row per block of neighbouring documents. ``payload`` holds one zstandard frame per document, each
  compressed alone with the shared dictionary; ``ends`` is the offset index into the payload, ``n_tokens`` and ``doc_ids``
  go with it. ``shard`` and ``block`` order the blocks by doc_id. ``dict_sha256`` names the dictionary.

One short document is read by its block's row (doc_id bounds are Parquet statistics) and one frame of it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from paperproof.llm.common import new_path, parts

FORMAT = 1
BLOCKS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("first_doc_id", T.LongType()), T.StructField("last_doc_id", T.LongType()), T.StructField("dict_sha256", T.StringType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("total", T.LongType()), T.StructField("payload", T.BinaryType()),
])

# Letters below U+0250 that are their own NFC form, and marks which are one pre-token with their neighbours alone.
_LETTERS = re.compile("[a-zà-öø-ÿ]+")
_MARKS = ".,;:!?"
_SPACED = bytes(32 if b == 10 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Encoder:
    """Ids of texts, the same as the tokenizer's own: text between two spaces is encoded once and kept, up to ``keep`` pieces.

    Cutting at spaces and newlines is exact for a tokenizer whose normaliser and pre-tokenizer work within them and drop
    them; ``exact`` says so, and other tokenizers get whole texts.
    """

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model = self.tokenizer.model
        self.exact = self.tokenizer.encode("a B\nc", add_special_tokens=False).ids == sum((self._whole(x) for x in ("a", "b", "c")), [])
        # where each plain word is one model call; tried on this tokenizer, never assumed
        self.plain = self.exact and all(self._whole(w + m) == self._piece(w, m) for w in ("window", "été", "größe", "qqzzxxjw") for m in ("", ".", ",", "!?"))
        self.top_id = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.ends = array("I", [0]), array("q", [1])

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, core: str, marks: str) -> list[int]:
        if not core.isascii():
            core = "".join(map(_BYTES.__getitem__, core.encode()))
        got = [t.id for t in self.model.tokenize(core)] if core else []
        return got + [t.id for t in self.model.tokenize(marks)] if marks else got

    def _encode(self, piece: str) -> list[int]:
        core = piece.rstrip(_MARKS)
        if self.plain and (not core or _LETTERS.fullmatch(core)):
            return self._piece(core, piece[len(core):])
        return self._whole(piece)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of each text's."""
        if not self.exact or any("<|" in t for t in texts):
            each = [self._whole(t) for t in texts]
            return np.fromiter((i for x in each for i in x), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        raw = [t.encode().translate(_SPACED) for t in texts]
        pieces = pc.split_pattern(pa.array(raw, pa.binary()).cast(pa.large_string()), " ")
        coded = pieces.values.dictionary_encode()
        if len(self.slots) > self.keep:
            self.clear()
        slot = np.empty(len(coded.dictionary), np.int64)
        for i, piece in enumerate(coded.dictionary.to_pylist()):
            at = self.slots.get(piece)
            if at is None:
                self.ids.extend(self._encode(piece) if piece else ())
                self.ends.append(len(self.ids))
                at = self.slots[piece] = len(self.ends) - 2
            slot[i] = at
        ids, ends = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.int64)  # views; what is taken from them is copied
        at = slot[coded.indices.to_numpy(zero_copy_only=False)] if len(slot) else np.empty(0, np.int64)
        n = ends[at + 1] - ends[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        got = ids[np.repeat(ends[at] - upto[:-1], n) + np.arange(upto[-1])]
        bounds = upto[pieces.offsets.to_numpy()]
        return got, np.diff(bounds)


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, n_docs: int, most_chars: int, size: int) -> bytes:
    """A dictionary trained on the id arrays of at most n_docs short documents, chosen by hash of their id. Where they are too few
    to train on, the arrays themselves are the dictionary; without any it is empty."""
    some = docs.where(F.length("text").between(1, most_chars)).orderBy(F.xxhash64("doc_id", F.lit(7)), "text").select("text").limit(n_docs)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = encoder(tokenizer)(b["text"].to_pylist())
            cut = np.concatenate(([0], np.cumsum(n)))
            yield pa.record_batch({"ids": [_checked(ids[p:q], width).tobytes() for p, q in zip(cut, cut[1:], strict=False)]})

    samples = [bytes(r[0]) for r in some.mapInArrow(encoded, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, [s for s in samples if len(s) >= 8], level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] if sum(map(len, samples)) >= 8 else b""


def _checked(ids: np.ndarray, width: int) -> np.ndarray:
    if len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"id {int(ids.max())} doesn't fit {width} bytes")
    return ids.astype(f"<u{width}")


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, width: int | None = None, block_docs: int = 1024, block_bytes: int = 4 << 20,
    train_docs: int = 512, train_chars: int = 65_536, dict_bytes: int = 65_536, level: int = 3,
) -> None:
    """Write the token file set of docs(doc_id, text, ...) under path, in ascending doc_id order.

    Each document's ids end with end_id. width is the bytes of an id, taken from the tokenizer's largest id where it isn't given; an
    id that doesn't fit is an error. A null text is an empty one: it has the end id alone. A null doc_id comes first.
    Repeated rows are all written, ordered by text where ids tie. No documents: no blocks. Further columns aren't read.
    One range shuffle by doc_id; ids are made after it, in order, so nothing but the text is ever moved. The dictionary is
    fitted on at most train_docs documents of at most train_chars characters.
    """
    spark = docs.sparkSession
    width = width or (2 if max(encoder(tokenizer).top_id, end_id) < 1 << 16 else 4)
    if end_id >> (8 * width):
        raise ValueError(f"id {end_id} doesn't fit {width} bytes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    trained = _dictionary(docs, tokenizer, end_id, width, train_docs, train_chars, dict_bytes)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(FORMAT, width, end_id, tokenizer.rsplit("/", 1)[-1], name, trained)], "format int, width int, end_id int, tokenizer string, dict_sha256 string, dict binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()), ("dict_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("total", pa.int64()), ("payload", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, no = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        doc_ids: list = []
        counts: list[int] = []
        ends: list[int] = []
        frames: list[bytes] = []

        def block() -> pa.RecordBatch:
            nonlocal no
            known = [x for x in doc_ids if x is not None]
            row = [shard, no, min(known, default=None), max(known, default=None), name, [*doc_ids], [*counts], [*ends], sum(counts), b"".join(frames)]
            no += 1
            for x in (doc_ids, counts, ends, frames):
                x.clear()
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for b in parts(batches, "text"):
            if len(b):
                ids, n = encoder(tokenizer)(b["text"].to_pylist())
                at = 0
                for doc_id, k in zip(b["doc_id"].to_pylist(), n.tolist(), strict=True):
                    frame = pack.compress(_checked(np.append(ids[at : at + k], end_id), width).tobytes())
                    at += k
                    if frames and (len(frames) >= block_docs or ends[-1] + len(frame) > block_bytes):
                        yield block()
                    doc_ids.append(doc_id)
                    counts.append(k + 1)
                    ends.append((ends[-1] if ends else 0) + len(frame))
                    frames.append(frame)
        if frames:
            yield block()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")


def _meta(spark: SparkSession, path: str) -> tuple[int, bytes, str]:
    m = spark.read.parquet(f"{path}/meta").first()
    if m["format"] != FORMAT:
        raise ValueError(f"token file format {m['format']} isn't {FORMAT}")
    if hashlib.sha256(m["dict"]).hexdigest() != m["dict_sha256"]:
        raise ValueError("the dictionary doesn't match its hash")
    return m["width"], bytes(m["dict"]), m["dict_sha256"]


def _unpacker(trained: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


def token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with block_start: the number of ids in all blocks before. Only a row per shard meets in one task for it."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("total").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("in_shard")).join(shards, "shard")
    return blocks.join(starts, ["shard", "block"]).withColumn("block_start", F.col("shard_start") + F.col("in_shard"))


def read_tokens(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """Every document of a token file set: doc_id, start, n_tokens, ids_crc32, and with ids the array itself."""
    width, trained, name = _meta(spark, path)
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _unpacker(trained)
        for b in batches:
            for row in (r for i in range(len(b)) for r in b.slice(i, 1).to_pylist()):
                if row["dict_sha256"] != name:
                    raise ValueError("a block was written with another dictionary")
                start, p, crcs, starts, arrays = row["block_start"], 0, [], [], []
                for n, q in zip(row["n_tokens"], row["ends"], strict=True):
                    got = np.frombuffer(opened.decompress(row["payload"][p:q]), f"<u{width}").astype("<u4")
                    if len(got) != n:
                        raise ValueError("a frame doesn't hold the ids that the index says")
                    starts.append(start)
                    crcs.append(zlib.crc32(got.tobytes()))
                    if ids:
                        arrays.append(got.astype(np.int32))
                    start, p = start + n, q
                cols = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(row["n_tokens"], pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
                yield pa.record_batch(cols | ({"ids": pa.array(arrays, pa.list_(pa.int32()))} if ids else {}))

    return token_blocks(spark, path).select("dict_sha256", "doc_ids", "n_tokens", "ends", "payload", "block_start").mapInArrow(unpack, kind)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id: the block's statistics find it, and its frame alone is opened."""
    width, trained, _ = _meta(spark, path)
    found = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("first_doc_id").__le__(doc_id) & F.col("last_doc_id").__ge__(doc_id))
    found = found.select(F.explode(F.arrays_zip("doc_ids", "ends", F.transform(F.sequence(F.lit(1), F.size("ends")), lambda i: F.when(i > 1, F.get("ends", i - 2)).otherwise(0)).alias("starts"))).alias("d"), "payload")
    found = found.where(F.col("d.doc_ids") == doc_id).select(F.expr("substring(payload, cast(d.starts + 1 as int), cast(d.ends - d.starts as int))").alias("frame"))
    return [np.frombuffer(_unpacker(trained).decompress(bytes(r.frame)), f"<u{width}").tolist() for r in found.collect()]


def token_digest(docs: DataFrame, tokenizer: str, path: str | None = None, **settings) -> DataFrame:
    """Write docs as a token file set and read it back: doc_id, start, n_tokens, ids_crc32. Rows as for write_tokens."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, **settings)
    return read_tokens(spark, path, ids=False)
