"""SimHash near-dedup: fingerprints, exact pairs in Hamming distance through vantage-point trees, connected groups.

A tree of vantage points cuts the distinct fingerprints into shards. At a node with pivot p and radius r, a fingerprint x
with d(x, p) <= r goes inside, another outside; one with r < d(x, p) <= r + bits goes to both. By the triangle bound any
two fingerprints within ``bits`` of each other then meet in a shard: if one is inside, the other is in the overlap. Of
several pivots and radii a node takes the one with the least overlap. Shards are searched by trees of the same kind, each in
a task of its own, which returns stars (a fingerprint and the least one of its group there), never all pairs. Groups of
different shards are joined by connected components over the stars' centres. Equal fingerprints are one from the start, so
copies of one text cost nothing.

An overlap as wide as the spread of distances (4 bits, for unlike texts) would put nearly everything into every shard. For
more than a few bits the fingerprint is therefore cut into bands: of two fingerprints within ``bits``, one band at least is
within ``bits // bands``, so a tree of each band with that overlap still meets every pair, and pairs are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperproof.llm.common import dropped, slices, stored, words

CHUNK = 1 << 16


def digests(w: list[bytes], k: int) -> Iterator[bytes]:
    grams = map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else [b" ".join(w)] if w else []
    return map(xxhash.xxh64_digest, grams, repeat(42))


def simhash(texts: list[str], k: int = 3, whole_below: int = 0) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if set in over half of the XXH64 (seed 42) of the texts' k-word shingles, repeats included.

    Texts of fewer than k words have one shingle, those of none fingerprint 0. Texts of fewer than whole_below words have
    the hash of their whole word sequence as fingerprint, as few shingles make chance neighbours.
    """
    ones, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    rows: list[int] = []
    lens: list[int] = []
    held: list[bytes] = []

    def count() -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8), axis=1)
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        np.add.at(ones, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        for x in (rows, lens, held):
            x.clear()

    for i, text in enumerate(texts):
        w = words(text)
        each = digests(w, max(k, len(w)) if len(w) < whole_below else k)
        while part := list(islice(each, CHUNK)):
            n[i] += len(part)
            rows.append(i)
            lens.append(len(part))
            held += part
            if len(held) >= CHUNK:
                count()
    if held:
        count()
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, *, k: int = 3, whole_below: int = 0) -> DataFrame:
    """doc_id, text_hash, fp for each row of docs(doc_id, text, ...); a null text is an empty one. fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [simhash(b["text"][p:q].to_pylist(), k, whole_below) for p, q in slices(pc.binary_length(b["text"]).to_pylist(), 4 << 20)]
            yield pa.record_batch([b["doc_id"], b["text_hash"], pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64())], names=["doc_id", "text_hash", "fp"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


# --- vantage-point trees: a node is (pivot, radius, inside, outside), a leaf the number of its shard ---


def build(sample: np.ndarray, shards: int, bits: int, pivots: int = 24) -> list:
    """A tree with about as many leaves as shards. Nodes whose overlap would hold nearly all of a side stay leaves."""
    nodes: list = []
    leaves = 0

    def grow(x: np.ndarray, want: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(None)
        best = None
        if want > 1 and len(x) >= 16:
            p = x[np.linspace(0, len(x) - 1, min(pivots, len(x))).astype(int)]
            inside = np.stack([np.cumsum(np.bincount(d, minlength=65 + bits)) for d in np.bitwise_count(x[None] ^ p[:, None])]) / len(x)
            share, reach = inside[:, :65], inside[:, bits : 65 + bits]
            cost = np.where((share >= 0.25) & (share <= 0.75), reach - share + 0.1 * np.abs(share - 0.5), 9.0)
            i, r = np.unravel_index(np.argmin(cost), cost.shape)
            if cost[i, r] < 0.7 and reach[i, r] < 0.95:
                best = p[i], int(r), share[i, r]
        if best is None:
            nodes[at] = leaves
            leaves += 1
            return at
        d = np.bitwise_count(x ^ best[0])
        near = max(1, min(want - 1, round(want * best[2])))
        nodes[at] = (best[0], best[1], grow(x[d <= best[1]], near), grow(x[d > best[1]], want - near))
        return at

    grow(np.sort(sample), shards)
    return nodes


def band_masks(bands: int) -> list[np.uint64]:
    """The bits of each band; bands are neighbours of nearly the same width."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    return [np.uint64((1 << q) - (1 << p)) for p, q in zip(cuts, cuts[1:], strict=False)]


def route(fps: np.ndarray, nodes: list, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in fps) for each leaf that has any."""
    todo = [(0, np.arange(len(fps)))]
    while todo:
        at, rows = todo.pop()
        if isinstance(nodes[at], int):
            yield nodes[at], rows
            continue
        pivot, radius, inside, outside = nodes[at]
        d = np.bitwise_count(fps[rows] ^ pivot)
        todo += [(k, some) for k, some in ((inside, rows[d <= radius + bits]), (outside, rows[d > radius])) if len(some)]


def _linked(x: np.ndarray, bits: int) -> np.ndarray:
    """For each of x the first position of its group, by passes over all pairs in blocks until nothing changes. From the second pass
    on, only those with a neighbour are looked at; a block holds no more than 2 million distances."""
    label, rows = np.arange(len(x)), np.arange(len(x))
    while True:
        new, some = label.copy(), x[rows]
        step = max(1, CHUNK * 32 // max(1, len(rows)))
        linked = []
        for p in range(0, len(rows), step):
            near = np.bitwise_count(some[p : p + step, None] ^ some[None]) <= bits
            many = np.flatnonzero(near.sum(axis=1) > 1)
            if len(many):
                linked.append(rows[p + many])
                new[linked[-1]] = np.where(near[many], label[rows][None], len(x)).min(axis=1)
        rows = np.concatenate(linked) if linked else rows[:0]
        new = new[new]
        if (new == label).all():
            return label
        label = new


def stars(fps: np.ndarray, bits: int, mask: np.uint64 | None = None, near: int | None = None, leaf: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint of its group) for those of the distinct fps that have a neighbour within bits.

    With mask, of pairs that differ in more than ``near`` bits of it only some are looked at."""
    fps = np.unique(fps)
    band, near = (fps, bits) if mask is None else (fps & mask, near)
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = build(band[:: max(1, len(fps) // 8192)], len(fps) // leaf + 1, near)
    for _, rows in route(band, tree, near):
        label = _linked(fps[rows], bits)
        for i in np.flatnonzero(label != np.arange(len(rows))).tolist():
            a, b = sorted((root(rows[i]), root(rows[label[i]])))
            parent[b] = a
    roots = np.fromiter(map(root, range(len(fps))), np.int64, len(fps))
    many = np.bincount(roots, minlength=len(fps))[roots] > 1
    return fps[many], fps[roots[many]]


def neighbours(fps: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, positions after i of those within bits of it) for each of fps, in order of distance from a vantage point: by the
    triangle bound only those whose distances from it differ by at most bits are looked at. Positions are those of fps."""
    away = np.bitwise_count(fps ^ fps[0]).astype(np.int16) if len(fps) else np.zeros(0, np.int16)
    order = np.argsort(away, kind="stable")
    x, away = fps[order], away[order]
    stop = np.searchsorted(away, away + bits, side="right")
    for i in range(len(x)):
        later = np.arange(i + 1, stop[i])
        yield int(order[i]), order[later[np.bitwise_count(x[later] ^ x[i]) <= bits]]


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(u, v): root is the least node of its component. Alternates large and small stars.

    Self-loops and repeated edges may occur. Each half round is written to the shared folder; the driver sees a count and a sum of it.
    """
    size = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges")
    seen = size(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "edges")
        dropped(e)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.when(F.col("lo") > F.col("m"), F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("m").alias("lo"))
        e = stored(small.distinct(), "edges")
        dropped(large)
        now = size(e)
        if now == seen:
            roots = e.select(F.col("lo").alias("node")).distinct()
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        seen = now


def groups(fps: DataFrame, *, bits: int = 2, bands: int = 1, shard_rows: int = 2048, sample_rows: int = 65_536, block_rows: int = 131_072) -> DataFrame:
    """(fp, root) for each distinct fp of fps(fp, ...) with a neighbour within bits: root is the same through a whole component.

    The trees of shards, one for each band, are fitted on at most sample_rows fingerprints; every fingerprint then goes through
    them. A shard of more than block_rows fingerprints is cut into blocks of about that many, and each pair of its blocks is a
    task, so no task holds more than two blocks however many fingerprints crowd into a shard.
    """
    distinct = stored(fps.select("fp").distinct(), "fingerprints")
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp", F.lit(1))).limit(min(sample_rows, n // 4 + 1024)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    masks, near = band_masks(bands), bits // bands
    trees = [build(sample & m, min(n // shard_rows + 1, max(1, len(sample) // 16)), near) for m in masks]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["fp"].to_numpy().view(np.uint64)
            rows = [(k, shard, len(at)) for k, (mask, nodes) in enumerate(zip(masks, trees, strict=True)) for shard, at in route(x & mask, nodes, near)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["band", "shard", "n"]) if rows else pa.record_batch({"band": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})

    cut: dict[tuple[int, int], int] = {}
    if n > block_rows:  # a row per leaf of the trees at most, whose number sample_rows bounds
        large = distinct.mapInArrow(counted, "band int, shard int, n long").groupBy("band", "shard").agg(F.sum("n").alias("n")).where(F.col("n") > block_rows).collect()
        cut = {(r.band, r.shard): -(-r["n"] // block_rows) for r in large}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(k: int, shard: int, first: int, second: int, x: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([*(pa.array(np.full(len(x), v, np.int32)) for v in (k, shard, first, second)), pa.array(x.view(np.int64))], names=["band", "shard", "first", "second", "fp"])

        for b in batches:
            x = b["fp"].to_numpy().view(np.uint64)
            for k, (mask, nodes) in enumerate(zip(masks, trees, strict=True)):
                for shard, rows in route(x & mask, nodes, near):
                    n_blocks = cut.get((k, shard), 1)
                    if n_blocks == 1:
                        yield some(k, shard, 0, 0, x[rows])
                        continue
                    block = ((x[rows] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(n_blocks)
                    for i in range(n_blocks):
                        for j in (*range(i), *range(i + 1, n_blocks)):
                            yield some(k, shard, min(i, j), max(i, j), x[rows][block == i])

    def search(part: pd.DataFrame) -> pd.DataFrame:
        mask = masks[int(part["band"].iloc[0])]
        member, centre = stars(part["fp"].to_numpy(np.int64).view(np.uint64), bits, mask, near)
        return pd.DataFrame({"fp": member.view(np.int64), "centre": centre.view(np.int64)})

    dealt = distinct.mapInArrow(deal, "band int, shard int, first int, second int, fp long")
    found = stored(dealt.groupBy("band", "shard", "first", "second").applyInPandas(search, "fp long, centre long"), "stars")
    first = stored(found.groupBy("fp").agg(F.min("centre").alias("first"), F.count("*").alias("n")), "stars")
    joins = found.join(first.where("n > 1"), "fp").select(F.col("centre").alias("u"), F.col("first").alias("v"))
    roots = stored(connected(joins), "roots")
    dropped(distinct, found)
    return first.join(roots, first["first"] == roots["node"], "left").select("fp", F.coalesce("root", "first").alias("root"))


def components(fps: DataFrame, **settings) -> DataFrame:
    """(fp, keeper) for each distinct fp of fps(doc_id, text_hash, fp): keeper is the least (doc_id, text_hash) of its component."""
    least = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least"))
    linked = stored(groups(fps, **settings), "groups")
    each = stored(least.join(linked, "fp", "left").select("fp", "least", F.col("root").isNotNull().alias("many"), F.coalesce("root", "fp").alias("root")), "least")
    tops = stored(each.where("many").groupBy("root").agg(F.min("least").alias("top")), "tops")
    out = stored(each.join(tops, "root", "left").select("fp", F.coalesce("top", "least").alias("keeper")), "components")
    dropped(linked, each, tops)
    return out


def simhash_groups(docs: DataFrame, *, k: int = 3, whole_below: int = 0, **settings) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs(doc_id, text, ...).

    component_id is the least doc_id reachable over links of at most ``bits`` differing bits, itself included. Empty and
    null texts have fingerprint zero and link like any other. Repeated rows are returned as often as they occur. A null doc_id is
    only a component's id if it has no other. Further columns aren't read.
    """
    fps = stored(fingerprints(docs, k=k, whole_below=whole_below), "simhash")
    each = components(fps, **settings)
    return fps.join(each, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("keeper.doc_id").alias("component_id"))
