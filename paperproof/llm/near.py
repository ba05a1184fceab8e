"""Near copies by Jaccard similarity of word shingles: SimHash fingerprints, vantage-point trees, connected families, an exact count.

Fingerprints of unlike texts differ in half of their bits, those of texts at a similarity of 0.8 in 0.15 of them (0.19 for sets of 4
and 5 shingles, the most for any sizes). At that radius no triangle bound over all bits of a fingerprint can cut off a branch. So a
fingerprint has ``WORDS`` words of 64 bits, cut into bands of ``WIDTH`` bits, and each band has a vantage-point tree of its own with an
overlap of ``NEAR`` bits: any two texts whose band differs in at most that many meet in a shard of that tree. A pair at 0.8 does in
some band but for 6 in 10 million pairs of larger sets, and 2 in a million of sets of 4 and 5 shingles. Texts of ``SMALL`` shingles or more
go through ``LARGE_BANDS`` of the trees, others through all.

Within a shard, two texts within ``NEAR`` bits of the band are neighbours if their sizes allow the threshold and ``CHECK`` further
words differ in no more bits than texts at 0.8 do (5.5 standard deviations above their mean or more). A shard's task returns stars, and families are what
stars join. Pairs are never listed. First each of a family's texts is compared with the least of them, which joins most copies. Where
a family's texts still belong to several components, all pairs of different components are then compared, in tasks of a pair of
blocks of the family's texts each, so a family of many texts is many tasks. A pair becomes a link if its similarity, counted from the
whole sets, reaches the threshold; tasks return no link that their others imply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperproof.llm.common import dropped, parts, slices, stored, words
from paperproof.llm.simhash import build, connected, neighbours, route

#: Words of a fingerprint, those at its end that neighbours are checked by, bits of a band, and overlap of a band's tree.
WORDS, CHECK, WIDTH, NEAR = 18, 4, 16, 1
#: Trees, and those that larger sets go through; the words that check these are no part of their bands.
BANDS, LARGE_BANDS = 64 * WORDS // WIDTH, 44
#: Differing bits of single-word fingerprints up to which a pair of larger sets is counted, and the shingles from which a set is one.
BITS, SMALL = 24, 64
#: Differing bits of the checking words up to which larger sets are neighbours, and others.
FAR, FAR_SMALL = 74, 84
#: Shingles in a block of a family's texts, texts of a shard, the most shards of a tree while they have no more than LARGE_SHARD texts each, and texts that trees are fitted on.
BLOCK, SHARD, SHARDS, LARGE_SHARD, SAMPLE = 1 << 19, 1 << 15, 64, 1 << 18, 1 << 14
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)  # fixed values: constants of splitmix64


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_ODD[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD[1])
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different k-word shingles; fewer words are one shingle, no words none."""
    w = words(text)
    if len(w) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)][: len(w)], np.uint64)
    x = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _stirred(h ^ x[i : len(w) - k + 1 + i])
    return np.unique(h)


def set_print(h: np.ndarray) -> int:
    """The SimHash of a shingle set: a bit is 1 if it is in over half of the hashes. Zero for an empty set."""
    ones = np.zeros(64, np.int64)
    for p in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[p : p + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def set_words(h: np.ndarray) -> np.ndarray:
    """The SimHash of a shingle set in WORDS words of bits, each of other hashes: a bit is 1 if it is in over half of the hashes. Where
    it is in half of them it is that of the least hash, so that few shingles make as many ones as zeros."""
    if not len(h):
        return np.zeros(WORDS, np.uint64)
    plus = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(_ODD[1])
    ones = np.zeros(64 * WORDS, np.int64)
    for p in range(0, len(h), 255):  # a byte holds the sum of so many bits
        each = _stirred(h[p : p + 255, None] + plus).astype("<u8", copy=False)
        bits = np.unpackbits(each.view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
        if not p:
            least = bits[0]
    return np.packbits(2 * ones + least > len(h), bitorder="little").view("<u8").astype(np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64))


def printed_rows(docs: DataFrame, *, k: int) -> DataFrame:
    """doc_id, text_hash, n (shingles in the set), fp, prints (the words of its fingerprint) for each row of docs; a null text is an empty one. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            sets = [shingle_set(t, k) for t in b["text"].to_pylist()]
            fps = np.array([set_print(s) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([b["doc_id"], b["text_hash"], pa.array(map(len, sets), pa.int32()), pa.array(fps), _lists([set_words(s) for s in sets])], names=["doc_id", "text_hash", "n", "fp", "prints"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n int, fp long, prints array<long>")


def shingle_sets(texts: DataFrame, *, k: int) -> DataFrame:
    """text_hash, n, shingles for each row of texts(text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            sets = [shingle_set(t, k) for t in b["text"].to_pylist()]
            yield pa.record_batch([b["text_hash"], pa.array(map(len, sets), pa.int32()), _lists(sets)], names=["text_hash", "n", "shingles"])

    return texts.select("text_hash", "text").mapInArrow(run, "text_hash long, n int, shingles array<long>")


# --- families: a row of a shard is a text's hash, set size, band and checking words ---

ROW = np.dtype([("text", "<i8"), ("n", "<i4"), ("band", "<u2"), ("check", "<u8", (CHECK,))])


def band(prints: np.ndarray, b: int) -> np.ndarray:
    """Band b of fingerprints, one a row."""
    each = 64 // WIDTH
    return (prints[:, b // each] >> np.uint64(b % each * WIDTH)) & np.uint64((1 << WIDTH) - 1)


def _least_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, with the least one of its component for each row, where pairs (i, j) join components."""
    label = label.copy()
    while len(i):
        a, b = label[i], label[j]
        i, j = i[a != b], j[a != b]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    return label


def shard_families(rows: np.ndarray, similarity: float, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(text, least text of its family) for those rows of a shard that have a neighbour, other than the least themselves.

    Rows are compared with the first of each band within NEAR first, then all pairs of such bands that didn't become one family by that, about ``most`` at a time."""
    rows = rows[np.lexsort((rows["text"], rows["band"]))]
    masks = [0, *(1 << b for b in range(WIDTH))]
    same = 1 / (1 - similarity) - 1e-6 if similarity < 1 else np.inf  # smaller sets are equal or under the threshold

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        some = np.flatnonzero((label[i] != label[j]) & (low >= similarity * high))
        i, j, low, high = i[some], j[some], low[some], high[some]
        apart = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in check)
        return some[apart <= np.where(high < same, 0, np.where(low < SMALL, FAR_SMALL, FAR))]

    def columns() -> tuple[np.ndarray, ...]:
        return rows["n"].astype(np.int64), rows["band"].astype(np.int64), np.ascontiguousarray(rows["check"].T)

    (n, x, check), label = columns(), np.arange(len(rows))
    for m in masks:
        start = np.searchsorted(x, x ^ m)
        i = np.flatnonzero((start < len(x)) & (x[np.minimum(start, len(x) - 1)] == x ^ m))
        met = near(i, start[i])
        label = _least_labels(label, i[met], start[i[met]])

    order = np.lexsort((label, x))
    first = label[order]
    rows, label = rows[order], np.argsort(order)[first]
    n, x, check = columns()
    key = x * len(rows) + first
    for m in masks:
        ends = [np.searchsorted(x, x ^ m), *(np.searchsorted(key, (x ^ m) * len(rows) + first, side) for side in ("left", "right")), np.searchsorted(x, x ^ m, "right")]
        for start, stop in ((ends[0], ends[1]), (ends[2], ends[3])):  # a band's rows of one's own family are left out
            start = np.maximum(start, np.arange(len(x)) + 1)
            size = np.maximum(stop - start, 0)
            i = np.flatnonzero(size)
            for each in np.split(i, np.flatnonzero(np.diff(np.cumsum(size[i]) // most)) + 1):
                for k in range(0, int(size[each].max(initial=0)), most):
                    wide = np.clip(size[each] - k, 0, most)
                    left = np.repeat(each, wide)
                    right = np.repeat(start[each] + k - np.cumsum(wide) + wide, wide) + np.arange(len(left))
                    met = near(left, right)
                    label = _least_labels(label, left[met], right[met])
    least = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(least, label, rows["text"])
    joined = least[label] != rows["text"]
    return rows["text"][joined], least[label][joined]


def families(texts: DataFrame, *, similarity: float, shard: int = SHARD) -> DataFrame:
    """(text_hash, family) for each of texts(text_hash, n, prints) with a neighbour: family is the least text_hash of what neighbours join.

    The trees are fitted on one text in so many that about SAMPLE are taken, chosen by hash; every text then goes through them."""
    total = texts.count()
    found = texts.where(F.pmod(F.xxhash64("text_hash", F.lit(1)), F.lit(total // SAMPLE + 1)) == 0).select("prints").toPandas()["prints"]
    sample = np.stack(found.to_list()).view(np.uint64) if len(found) else np.zeros((0, WORDS), np.uint64)
    shards = max(min(SHARDS, total // shard), total // LARGE_SHARD) + 1
    trees = [build(band(sample, b), shards, NEAR) for b in range(BANDS)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy()
            prints = batch["prints"].flatten().to_numpy().view(np.uint64).reshape(len(n), WORDS)
            rows = np.zeros(len(n), ROW)
            rows["text"], rows["n"], rows["check"] = batch["text_hash"].to_numpy(), n, prints[:, -CHECK:]
            small = np.flatnonzero(n < SMALL)
            for b in range(BANDS):
                some = np.arange(len(n)) if b < LARGE_BANDS else small
                if not len(some):
                    break
                values = band(prints, b)[some]
                rows["band"][some] = values
                dealt = [(shard, rows[some[at]].tobytes()) for shard, at in route(values, trees[b], NEAR)]
                yield pa.record_batch([pa.array([b] * len(dealt), pa.int32()), pa.array([d[0] for d in dealt], pa.int32()), pa.array([d[1] for d in dealt], pa.binary())], names=["tree", "shard", "rows"])

    def search(part: pd.DataFrame) -> pd.DataFrame:
        u, v = shard_families(np.frombuffer(b"".join(part["rows"]), ROW), similarity)
        return pd.DataFrame({"text": u, "centre": v})

    dealt = texts.select("text_hash", "n", "prints").mapInArrow(deal, "tree int, shard int, rows binary")
    stars = stored(dealt.groupBy("tree", "shard").applyInPandas(search, "text long, centre long"), "stars")
    # a centre is the least of its star, and is joined to itself; components are formed of centres alone, however many texts have one
    stars, each = stars.unionByName(stars.select(F.col("centre").alias("text"), "centre")).distinct(), stars
    first = stored(stars.groupBy("text").agg(F.min("centre").alias("first")), "first")
    roots = stored(connected(stars.join(first, "text").select(F.col("centre").alias("u"), F.col("first").alias("v"))), "roots")
    dropped(each)
    out = stored(first.join(roots, first["first"] == roots["node"], "left").select(F.col("text").alias("text_hash"), F.coalesce("root", "first").alias("family")), "families")
    dropped(first, roots)
    return out


def exact_links(pairs: DataFrame, sets: DataFrame, *, similarity: float) -> DataFrame:
    """Those of pairs(u, v) of text hashes whose sets have that Jaccard similarity or more. Two empty sets are alike."""
    side = lambda name: sets.select(F.col("text_hash").alias(name), F.col("n").alias(f"n_{name}"), F.col("shingles").alias(f"set_{name}"))
    either = F.col("n_u") + F.col("n_v") - F.col("both")
    met = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", F.size(F.array_intersect("set_u", "set_v")).alias("both"))
    return met.where((either == 0) | (F.col("both") / either >= similarity)).select("u", "v")


def block_links(sets: list[np.ndarray], fps: np.ndarray, comp: np.ndarray, block: np.ndarray, similarity: float, bits: int) -> Iterator[tuple[int, int]]:
    """Links of a family's texts that join components: all pairs of different components are compared, those of one block only if there is
    one block alone."""
    n, label = np.array([len(s) for s in sets]), comp.copy()
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ids = np.split(ids, np.cumsum(n)[:-1])
    several = (block != block[0]).any()
    held = np.zeros(max((int(x.max()) for x in ids if len(x)), default=0) + 1, bool)
    for i, later in candidates(fps, n, similarity, bits):
        later = later[(label[later] != label[i]) & (np.minimum(n[i], n[later]) >= similarity * np.maximum(n[i], n[later])) & (n[later] > 0)]
        if several:
            later = later[block[later] != block[i]]
        if not len(later):
            continue
        held[ids[i]] = True
        both = np.add.reduceat(held[np.concatenate([ids[j] for j in later])], np.cumsum([0, *n[later][:-1]]), dtype=np.int64)
        held[ids[i]] = False
        for j in later[both / (n[i] + n[later] - both) >= similarity].tolist():
            if label[i] != label[j]:
                yield i, j
                label[label == label[j]] = label[i]


def candidates(fps: np.ndarray, n: np.ndarray, similarity: float, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): all pairs of fingerprints within bits, and of those further apart the ones with a set of fewer than SMALL shingles whose sizes allow the similarity."""
    yield from neighbours(fps, bits)
    order = np.argsort(n, kind="stable")
    sizes = n[order]
    for k in range(np.searchsorted(sizes, 1), np.searchsorted(sizes, SMALL)):
        later = order[k + 1 : np.searchsorted(sizes, int(sizes[k] / similarity) + 1, "right")]
        later = later[np.bitwise_count(fps[later] ^ fps[order[k]]) > bits]
        if len(later):
            yield int(order[k]), later


def rest_links(met: DataFrame, roots: DataFrame, sets: DataFrame, *, similarity: float, bits: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between the components of roots, of all pairs that share a family of met; families of two are known already."""
    now = stored(met.where("many > 2").join(roots, "text_hash", "left").select("family", "text_hash", "n", "fp", F.coalesce("root", "text_hash").alias("comp")), "now")
    several = now.groupBy("family").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("n").alias("total")).where("low <> high")
    several = stored(several.select("family", "total", F.greatest(F.ceil(F.col("total") / block), F.lit(1)).cast("int").alias("blocks")), "several")
    n_parts = 1 + (several.where("blocks = 1").agg(F.sum("total")).first()[0] or 0) // block
    at = F.pmod(F.xxhash64("text_hash", F.lit(7)), "blocks").cast("int")
    rest = now.join(several, "family").withColumn("block", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = F.col("blocks") == 1
    rest = rest.select("family", "text_hash", "fp", "comp", "block", F.when(one, F.pmod(F.xxhash64("family"), F.lit(n_parts))).otherwise(F.col("family")).alias("part"), F.when(one, -1).otherwise(F.least("block", "other")).alias("first"), F.when(one, -1).otherwise(F.greatest("block", "other")).alias("second"))
    rest = rest.join(sets.select("text_hash", "shingles"), "text_hash")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for _, g in part.groupby("family", sort=False):
            hashes, fps = g["text_hash"].to_numpy(), g["fp"].to_numpy(np.int64).view(np.uint64)
            for i, j in block_links(g["shingles"].to_list(), fps, g["comp"].to_numpy(), g["block"].to_numpy(), similarity, bits):
                u.append(min(hashes[i], hashes[j]))
                v.append(max(hashes[i], hashes[j]))
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    more = stored(rest.groupBy("part", "first", "second").applyInPandas(search, "u long, v long"), "links")
    dropped(now, several)
    return more


def alike(texts: DataFrame, docs: DataFrame, *, similarity: float, k: int, bits: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(text_hash, root) for the texts that have a link: root is the same through a whole component of exact links.

    texts(text_hash, least, n, fp, prints) has each different text once, least being the document that stands for its copies;
    docs(key, text) has the documents, key is the (id, hash) of a row."""
    family = families(texts, similarity=similarity, shard=shard)
    each = family.join(texts.select("text_hash", "n", "fp"), "text_hash")
    tops = each.groupBy("family").agg(F.min(F.struct("text_hash", "n", "fp")).alias("top"), F.count("*").alias("many"))
    met = stored(each.join(tops, "family").select("family", "text_hash", "n", "fp", "many", "top"), "met")
    dropped(family)
    near = ((F.bit_count(F.col("fp").bitwiseXOR(F.col("top.fp"))) <= bits) | (F.least("n", "top.n") < SMALL)) & (F.least("n", "top.n") >= similarity * F.greatest("n", "top.n"))
    pairs = met.where((F.col("text_hash") != F.col("top.text_hash")) & near).select(F.col("top.text_hash").alias("u"), F.col("text_hash").alias("v"))
    one = texts.join(met.select("text_hash"), "text_hash", "left_semi").select(F.struct(F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("hash")).alias("key"))
    some = docs.join(one, "key", "left_semi").select("key.hash", "text").groupBy(F.col("hash").alias("text_hash")).agg(F.first("text").alias("text"))
    sets = stored(shingle_sets(some, k=k), "sets")
    links = stored(exact_links(pairs, sets, similarity=similarity), "links")
    roots = stored(connected(links).select(F.col("node").alias("text_hash"), "root"), "alike")
    dropped(links)
    more = rest_links(met, roots, sets, similarity=similarity, bits=bits, block=block)
    dropped(met, sets)
    if not more.isEmpty():
        first, roots = roots, stored(connected(roots.select(F.col("text_hash").alias("u"), F.col("root").alias("v")).unionByName(more)).select(F.col("node").alias("text_hash"), "root"), "alike")
        dropped(first)
    dropped(more)
    return roots


def without_near_copies(docs: DataFrame, *, k: int = 5, similarity: float = 0.8, bits: int = BITS, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """docs with one row of each group: the one with the least doc_id (then text hash). Null ids come last.

    A group is what exact links join: pairs of texts with a Jaccard similarity of their k-word shingle sets of at least
    ``similarity``. Of the pairs of a family, those whose single-word fingerprints differ in at most ``bits``, or with a small set, are counted. Equal texts
    are one from the start. Texts without words are alike. Extra columns are kept and not read; of repeated rows one stays.
    An empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least")
    printed = stored(printed_rows(docs, k=k), "prints")
    texts = stored(printed.groupBy("text_hash").agg(least, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prints").alias("prints")), "texts")
    dropped(printed)
    key = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash")).alias("key")
    same = alike(texts, docs.select(key, text.alias("text")), similarity=similarity, k=k, bits=bits, block=block, shard=shard)
    each = texts.select("text_hash", "least").join(same.withColumnRenamed("root", "same"), "text_hash", "left")
    tops = each.groupBy(F.col("same").isNull().alias("alone"), F.coalesce("same", "text_hash").alias("group")).agg(F.min("least").alias("top"))
    keepers = stored(tops.select(F.struct(F.col("top.doc_id").alias("id"), F.col("top.text_hash").alias("hash")).alias("key")), "keepers")
    dropped(texts, same)
    rows = docs.select(F.struct("*").alias("doc"), key)
    first = F.row_number().over(W.partitionBy("key").orderBy(F.lit(0)))
    return rows.join(keepers, "key", "left_semi").withColumn("nth", first).where("nth = 1").select("doc.*")
