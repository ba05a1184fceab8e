"""Line dedup: which lines of each document stay, as a compressed bitmap per document.

Line hashes are range-partitioned on (hash, document) and sorted by document and position inside each partition, so a
hash is a run of neighbouring rows. A task streams its rows once and holds no more of a run than its first ``min_docs``
documents. A very frequent hash spans many partitions; runs cut by a partition's end are settled by a second, small sum.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperproof.llm.common import LOWER, dropped, parts, stored

_LINE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])
_RUN = "h1 long, h2 long, doc_id long, text_hash long, pos int, n_lines int, state int"
DROP, OPEN, MARK = 0, 1, 2


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2) of the key of each line with at least min_chars code points, with document and position."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            if len(b):
                digests, ids, hashes, pos, sizes = [], [], [], [], []
                for doc_id, th, text in zip(b["doc_id"].to_pylist(), b["text_hash"].to_pylist(), b["text"].to_pylist(), strict=True):
                    rows = text.encode().translate(LOWER).split(b"\n")
                    for i, line in enumerate(rows):
                        key = line.strip()
                        if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                            digests.append(xxhash.xxh3_128_digest(key))
                            ids.append(doc_id)
                            hashes.append(th)
                            pos.append(i)
                            sizes.append(len(rows))
                h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(pos, pa.int32()), pa.array(sizes, pa.int32())], schema=_LINE)

    return docs.mapInArrow(hashed, "h1 long, h2 long, doc_id long, text_hash long, pos int, n_lines int")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _runs(min_docs: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, docs, first = None, None, 0, True  # docs: distinct documents of the run so far
        held: list[tuple] = []
        out: list[tuple] = []

        def ended(last: bool) -> None:
            """The run is over. One that began or ends with the partition may go on in another, so it isn't settled here."""
            if key is not None and (first or last):
                out.extend((*r, OPEN) for r in held)
                if docs >= min_docs:
                    out.append((*key, None, None, None, None, MARK))
            held.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 7
            out.clear()
            return pa.record_batch([pa.array(c, pa.int64() if i < 4 else pa.int32()) for i, c in enumerate(cols)], names=["h1", "h2", "doc_id", "text_hash", "pos", "n_lines", "state"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != key:
                    if key is not None:
                        ended(last=False)
                        first = False
                    key, doc, docs = row[:2], None, 0
                if docs == 0 or row[2:4] != doc:
                    doc, docs = row[2:4], docs + 1
                    if docs == min_docs:
                        out.extend((*r, DROP) for r in held)
                        held.clear()
                if docs >= min_docs:
                    out.append((*row, DROP))
                else:
                    held.append(row)
                if len(out) >= 20_000:
                    yield batch()
        ended(last=True)
        yield batch()

    return stream


def dropped_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos, n_lines of every line whose key at least min_docs documents have."""
    lines = stored(line_hashes(_keyed(docs), min_chars), "lines")
    by = ["h1", "h2", "doc_id", "text_hash"]
    runs = lines.repartitionByRange(*by).sortWithinPartitions(*by, "pos").mapInArrow(_runs(min_docs), _RUN)
    runs = stored(runs, "line-runs")
    dropped(lines)
    cut = runs.where(F.col("state") != DROP).groupBy("h1", "h2").agg(F.max("state").alias("top"), F.countDistinct(F.struct("doc_id", "text_hash")).alias("n"))
    frequent = cut.where((F.col("top") == MARK) | (F.col("n") >= min_docs)).select("h1", "h2")
    late = runs.where(F.col("state") == OPEN).join(frequent, ["h1", "h2"], "left_semi")
    cols = ["doc_id", "text_hash", "pos", "n_lines"]
    return runs.where(F.col("state") == DROP).select(cols).unionByName(late.select(cols))


def keep_bitmaps(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep for each document of docs(doc_id, text, ...) that loses a line.

    keep is a zlib-compressed bitmap, first line in the highest bit of the first byte: 1 for lines that stay. Documents
    without a row lose nothing. Rows with the same doc_id and text count as one document; a null text is an empty one, an
    empty line never has a key. Lines are cut at \\n; a key is the line without spaces [\\x20\\x09-\\x0D] at its ends, A-Z
    lower-cased. Keys of at least min_chars code points that at least min_docs documents have lose all their lines.
    """

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, pos in zip(b["n_lines"].to_pylist(), b["pos"], strict=True):
                bits = np.ones(n, bool)
                bits[np.asarray(pos.values)] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.record_batch([b["doc_id"], b["text_hash"], b["n_lines"], b["n_dropped"], pa.array(keep, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])

    per_doc = dropped_lines(docs, min_docs, min_chars).groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("pos"))
    per_doc = per_doc.select("doc_id", "text_hash", F.col("n_lines").cast("long").alias("n_lines"), F.size("pos").cast("long").alias("n_dropped"), "pos")
    return per_doc.mapInArrow(bitmaps, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")


def kept_lines(lines: list, keep: bytes | None) -> list:
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return [x for x, k in zip(lines, bits.tolist(), strict=True) if k]


def without_frequent_lines(docs: DataFrame, *, digest: bool = False, **settings) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays, or with digest the SHA-256 of its UTF-8, for each row of docs."""
    keyed, bitmaps = _keyed(docs), stored(keep_bitmaps(docs, **settings), "line-bitmaps")
    same = keyed["doc_id"].eqNullSafe(bitmaps["doc_id"]) & (keyed["text_hash"] == bitmaps["text_hash"])
    both = keyed.join(bitmaps, same, "left").select(keyed["doc_id"], "text", "keep")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            if len(b):
                n, gone, left = [], [], []
                for text, keep in zip(b["text"].to_pylist(), b["keep"].to_pylist(), strict=True):
                    lines = text.encode().split(b"\n")
                    stay = kept_lines(lines, keep)
                    n.append(len(lines))
                    gone.append(len(lines) - len(stay))
                    left.append(hashlib.sha256(b"\n".join(stay)).hexdigest() if digest else b"\n".join(stay).decode())
                yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["doc_id", "n_lines", "n_dropped", "left"])

    out = both.mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, left string")
    return out.withColumnRenamed("left", "kept_sha256" if digest else "text")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, t, string_split(t, chr(10)) AS a FROM d),
l AS (SELECT rid, doc_id, t, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos FROM s),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT (doc_id, t)) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.k = f.k GROUP BY rid
"""
