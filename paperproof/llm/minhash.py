"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Each shingle is hashed once; the hash's top bits choose a bin, and a bin keeps its least value. An empty bin takes the
value of a bin that a hash of (bin, attempt) chooses, attempt after attempt, until that one isn't empty. Only the low
``bits`` bits of each value are stored. Two fingerprints' share m of equal codes is likeness (m - c) / (1 - c), c = 2 ** -bits
being the share that unlike values agree in by chance.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperproof.llm.common import words

_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values: the constants of splitmix64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(_ODD[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[2])
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """A 64-bit hash of each k-word shingle. Fewer words are one shingle; no words are the empty one."""
    w = words(text)
    if len(w) < k:
        return _mixed(np.array([zlib.crc32(b" ".join(w)) + len(w)], np.uint64))
    x = _mixed(np.fromiter(map(zlib.crc32, w), np.uint64, len(w)) | (np.fromiter(map(len, w), np.uint64, len(w)) << np.uint64(32)))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = _mixed(h ^ x[i : len(x) - k + 1 + i])
    return h


def _asked(bins: int, empty: np.ndarray, first: int, last: int) -> np.ndarray:
    """The bins that the empty ones ask: row t holds attempt first + t of each."""
    at = empty.astype(np.uint64)[None] | (np.arange(first, last, dtype=np.uint64)[:, None] << np.uint64(32))
    return (_mixed(_mixed(at)) % np.uint64(bins)).astype(np.int64)


class MinHash:
    """Fingerprints of texts with ``bins`` (a power of two) bins of ``bits`` (a divisor of 8, at most 8) bits; hex strings."""

    def __init__(self, k: int = 5, bins: int = 256, bits: int = 8):
        self.k, self.bins, self.bits = k, bins, bits
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self.attempts = _asked(bins, np.arange(bins), 0, 64)

    def codes(self, text: str | None) -> np.ndarray:
        h = np.sort(shingle_hashes(text, self.k))
        bin_of = (h >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.diff(bin_of, prepend=-1))
        value, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        value[bin_of[first]] = _mixed(h[first])
        full[bin_of[first]] = True
        lent = np.flatnonzero(~full)
        for t in range(len(self.attempts)):
            if not len(lent):
                break
            asked = self.attempts[t, lent]
            ok = full[asked]
            value[lent[ok]] = value[asked[ok]]
            lent = lent[~ok]
        t, n = len(self.attempts), 512
        while len(lent) and len(full_bins := np.flatnonzero(full)) > 1:  # few full bins: the attempts go on in blocks
            asked = _asked(self.bins, lent, t, t + n)
            ok = full[asked]
            hit, col = ok.argmax(0), np.arange(len(lent))
            found = ok[hit, col]
            value[lent[found]] = value[asked[hit, col][found]]
            lent, t = lent[~found], t + n
        if len(lent):
            value[lent] = value[full_bins[0]]  # the only full bin ends all attempts
        return (value & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def pack(self, codes: np.ndarray) -> str:
        return np.packbits(np.unpackbits(codes[:, None], axis=1)[:, 8 - self.bits :]).tobytes().hex()

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        chance = 2.0**-self.bits
        return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def edited_pairs(docs: DataFrame, *, k: int = 5, bins: int = 256, bits: int = 8, per_partition: int = 4) -> DataFrame:
    """For each row of docs(doc_id, text, ...), in ascending doc_id order: its fingerprint, that of its edited text (its last
    quarter of code points replaced by the next document's first as many, or all), and how alike they and the next one are.

    A null text is an empty one; a document without words has the fingerprint of the empty shingle, so empty texts are alike.
    Null ids come first; equal ids, and null ones, stand in order of a hash of their texts, then of text. After the last document comes
    the first, so a lone one is its own next.

    The text moves once: bounds, which tasks look ids up in, taken from doc_id's quantiles cut the order into parts, and the first document of each part also
    goes to the end of the part before. An id that several quantiles fall on, and the null ids, are cut by that hash into as many parts
    as their share asks for. The parts are sorted by Spark, and a task holds two documents at a time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("q"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    times = Counter(found["q"] or ())
    bounds = sorted({*times, *([found["least"]] if found["ids"] else [])})
    nulls = found["n"] - found["ids"]
    placed = docs.withColumn("part", part_of(bounds, [max(1, times[v]) for v in bounds], max(1, round(parts * nulls / found["n"])) if nulls else 0)("doc_id", "tie"))
    # the first row of a part also ends the part before; there are as many of these rows as parts
    first = {r["part"]: r["least"] for r in placed.groupBy("part").agg(F.min("doc_id").alias("least")).collect()}
    order = sorted(first)
    ends = spark.createDataFrame([(p, first[p], order[k - 1]) for k, p in enumerate(order)], "part int, first long, before int")
    heads = placed.join(F.broadcast(ends), "part").where(F.col("doc_id").eqNullSafe(F.col("first")))
    heads = heads.groupBy("part", "before", "first").agg(F.min(F.struct("tie", "text")).alias("h"))
    heads = heads.select(F.col("first").alias("doc_id"), "h.text", "h.tie", F.col("before").alias("part"), F.lit(1).alias("tail"))
    rows = placed.withColumn("tail", F.lit(0)).unionByName(heads)
    sort = ["part", "tail", "doc_id", "tie", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = MinHash(k, bins, bits)
        held, out = None, []

        def done(one: tuple, after: tuple) -> None:
            doc_id, text, codes = one[1:]
            n = len(text)
            cut = n // 4
            edited = text[: n - cut] + after[2][:cut]
            other = m.codes(edited)
            out.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), m.pack(codes), m.pack(other), m.likeness(codes, other), m.likeness(codes, after[3])))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 7
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            for p in range(0, len(b), 64):
                for part, tail, doc_id, text in zip(*(c.to_pylist() for c in b.slice(p, 64).columns), strict=True):
                    now = (part, doc_id, text, m.codes(text))
                    if held is not None and held[0] == part:
                        done(held, now)
                    held = None if tail else now
                if len(out) >= 256:
                    yield batch()
        yield batch()

    return rows.repartition("part").sortWithinPartitions(*sort).select("part", "tail", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def part_of(bounds: list[int], widths: list[int], nulls: int):
    """The part of a row(doc_id, tie) as a function of Arrow columns, so that a plan is as long for many parts as for few.

    Null ids share the first ``nulls`` parts, and each of the sorted bounds begins as many as its width says. Rows whose id is the
    bound are spread over these by their hash, in its order; greater ids are in the last of them."""
    edges, wide = np.array(bounds, np.int64), np.array(widths, np.int64)
    ends = nulls + np.cumsum(wide)

    def spread(tie: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return np.minimum(np.floor((tie / 2.0**64 + 0.5) * n).astype(np.int64), n - 1)

    @F.arrow_udf("int")
    def part(doc_id: pa.Array, tie: pa.Array) -> pa.Array:
        ids, hashes = doc_id.fill_null(0).to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False)
        out = np.zeros(len(ids), np.int64)
        if len(edges):
            at = np.maximum(np.searchsorted(edges, ids, "right") - 1, 0)
            out = ends[at] - 1
            hot = (edges[at] == ids) & (wide[at] > 1)
            out[hot] += spread(hashes[hot], wide[at][hot]) - wide[at][hot] + 1
        none = doc_id.is_null().to_numpy(zero_copy_only=False)
        out[none] = spread(hashes[none], max(1, nulls))
        return pa.array(out, pa.int32())

    return part
