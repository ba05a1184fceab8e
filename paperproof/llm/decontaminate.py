"""Benchmark decontamination by greedy string tiling, so that reordered passages are found as well as verbatim ones.

Shared seeds (runs of ``seed_words`` words, or of all words of a shorter item) pick the (document, item) pairs; a pair whose
seeds could not cover enough of the item is dropped unseen. In the others, Karp-Rabin passes mark the longest common runs that
don't overlap, again and again, down to the seed length; the item's share of marked words is its coverage.

A benchmark of up to ``block_chars`` characters goes to every task whole, and documents are filtered where they are read. A larger
one stays a table: its seeds meet those of the documents by a join, of the documents' only those that a bitmap of fixed size
lets through, and pairs with seeds enough are tiled in tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperproof.llm.common import dropped, parts, stored

# A word is a run of ASCII letters, digits and all characters beyond ASCII; A-Z are lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_FACTOR = 0x9E3779B97F4A7C15
_FOUND = "doc_id long, item_id long, coverage double, n_tiles int, item_words int"
#: Bits of the bitmap of a large benchmark's seeds: 2 ** 27, 16 MB.
MAP_BITS = 27


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def _word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def _gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words, from the words' hashes; equal runs have equal ones."""
    h = np.zeros(max(0, len(x) - k + 1), np.uint64)
    for i in range(k if len(h) else 0):
        h = h * np.uint64(_FACTOR) + x[i : len(x) - k + 1 + i]
        h ^= h >> np.uint64(29)
    return h


def tiles(pattern: list, text: list, least: int) -> list[tuple[int, int, int]]:
    """(position in pattern, in text, length) of the tiles: the longest common runs of at least ``least``, none overlapping.

    Ties go to the smaller position in the pattern, then in the text. ``None`` in text never matches.
    """
    used_p, used_t = bytearray(len(pattern)), bytearray(x is None for x in text)
    code = {x: i + 1 for i, x in enumerate(dict.fromkeys(pattern))}
    p, t = [code[x] for x in pattern], [0 if x is None else code.get(x, 0) for x in text]
    found: list[tuple[int, int, int]] = []
    size, base, mod = max(least, min(len(p), len(t)) // 2), len(code) + 1, (1 << 61) - 1

    def windows(x: list[int], used: bytearray) -> Iterator[tuple[int, int]]:
        """(start, Karp-Rabin hash) of each unmarked run of ``size`` words."""
        h, run, top = 0, 0, pow(base, size - 1, mod)
        for i, v in enumerate(x):
            if used[i]:
                h = run = 0
                continue
            if run >= size:
                h = (h - x[i - size] * top) % mod
            h, run = (h * base + v) % mod, run + 1
            if run >= size:
                yield i - size + 1, h

    def matches() -> list[tuple[int, int, int]]:
        at = defaultdict(list)
        for j, h in windows(t, used_t):
            at[h].append(j)
        out = []
        for i, h in windows(p, used_p):
            longest, first = 0, 0
            most = next((x for x in range(i, len(p)) if used_p[x]), len(p)) - i if h in at else 0
            for j in at.get(h, ()):
                if i and j and not used_p[i - 1] and not used_t[j - 1] and p[i - 1] == t[j - 1]:
                    continue  # part of a run that began earlier
                n = 0
                while i + n < len(p) and j + n < len(t) and not used_p[i + n] and not used_t[j + n] and p[i + n] == t[j + n]:
                    n += 1
                if n > longest:
                    longest, first = n, j
                    if n == most:
                        break
            if longest >= size:
                out.append((i, first, longest))
        return sorted(out, key=lambda m: (-m[2], m[0], m[1]))

    while True:
        again = False
        for i, j, n in matches():
            if any(used_p[i : i + n]) or any(used_t[j : j + n]):
                again = True  # what is left of it, or another place of it, comes up in another pass, in its turn
                break
            used_p[i : i + n] = used_t[j : j + n] = b"\1" * n
            found.append((i, j, n))
        if not again:
            if size == least:
                return found
            size = max(least, size // 2)


def covered(item: list[bytes], k: int, at: np.ndarray, h: np.ndarray, threshold: float) -> tuple[float, int] | None:
    """(coverage, tiles) of an item by a text whose runs of k words at positions ``at`` have hashes h that the item has too; None if
    the coverage is below the threshold. The text's words there are the item's."""
    grams = _gram_hashes(_word_hashes(item), k)
    met, words = np.isin(grams, h), np.zeros(len(item), bool)
    for o in range(k):
        words[o : o + len(grams)] |= met
    if words.sum() < threshold * len(item):
        return None
    first = {g: i for i, g in reversed(list(enumerate(grams.tolist())))}
    text: dict[int, bytes] = {}
    for j, g in zip(at.tolist(), h.tolist(), strict=True):
        text.update(zip(range(j, j + k), item[first[g] : first[g] + k], strict=True))
    part: list = []
    before = -2
    for j in sorted(text):
        part += [text[j]] if j == before + 1 else [None, text[j]]
        before = j
    got = tiles(item, part, k)
    coverage = sum(x[2] for x in got) / len(item)
    return (coverage, len(got)) if coverage >= threshold else None


class Block:
    """Some benchmark items, and the search for them in one text."""

    def __init__(self, items: list[tuple[int, str | None]], seed_words: int, threshold: float):
        self.threshold = threshold
        self.items = [(item_id, min(seed_words, n), text) for item_id, text in items if (n := len(plain_words(text)))]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in {k for _, k, _ in self.items}:
            some = [(n, np.unique(_gram_hashes(_word_hashes(plain_words(t)), k))) for n, (_, own, t) in enumerate(self.items) if own == k]
            h, which = np.concatenate([g for _, g in some]), np.repeat([n for n, _ in some], [len(g) for _, g in some])
            order, maybe = np.argsort(h, kind="stable"), np.zeros(1 << 20, bool)
            maybe[(h >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[k] = h[order], which[order], maybe

    def __call__(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, tiles, words of the item) for each item with coverage at the threshold or above."""
        x, out = _word_hashes(plain_words(text)), []
        for k, (seeds, which, maybe) in self.seeds.items():
            h = _gram_hashes(x, k)
            at = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(seeds, h[at])
            n = np.searchsorted(seeds, h[at], side="right") - low
            if not n.any():
                continue
            items = which[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            places = np.repeat(at, n)
            order = np.argsort(items, kind="stable")
            items, places = items[order], places[order]
            cuts = np.flatnonzero(np.diff(items, prepend=-1))
            for p, q in zip(cuts, [*cuts[1:], len(items)], strict=True):
                item_id, _, item_text = self.items[items[p]]
                item = plain_words(item_text)
                if got := covered(item, k, places[p:q], h[places[p:q]], self.threshold):
                    out.append((item_id, *got, len(item)))
        return out


def _small(benchmark: DataFrame, block_chars: int) -> list[tuple[int, str | None]] | None:
    """The items of a benchmark of up to block_chars characters, otherwise None."""
    if (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) > block_chars:
        return None
    return [(r.item_id, r.text) for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0).collect()]


def _found(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _key():
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))


_SEEDS = "item long, k int, n_words int, h long, at int"


def item_seeds(items: DataFrame, seed_words: int) -> DataFrame:
    """item, k, n_words, h, at: the hash of each run of k words of each item(item, text), and where it starts. k is seed_words, fewer for a shorter item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            for i, t in zip(b["item"].to_pylist(), b["text"].to_pylist(), strict=True):
                if w := plain_words(t):
                    k = min(seed_words, len(w))
                    h = _gram_hashes(_word_hashes(w), k)
                    yield pa.record_batch([pa.array([i] * len(h), pa.int64()), pa.array([k] * len(h), pa.int32()), pa.array([len(w)] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(np.arange(len(h)), pa.int32())], names=["item", "k", "n_words", "h", "at"])

    return items.select("item", "text").mapInArrow(run, _SEEDS)


def asked(k: int, n_words: int, h: np.ndarray, at: np.ndarray, often: np.ndarray, threshold: float) -> np.ndarray:
    """The seeds of an item of which a hit holds one at least. Its most frequent seeds are left out, as long as all the words that they stand on
    are fewer than a hit must cover: a text with none but those is no hit."""
    words, out = np.zeros(n_words, bool), []
    where: dict[int, list[int]] = {}
    for x, p in zip(h.tolist(), at.tolist(), strict=True):
        where.setdefault(x, []).append(p)
    n = dict(zip(h.tolist(), often.tolist(), strict=True))
    for x in sorted(where, key=lambda x: (-n[x], x)):
        if not out:
            more = words.copy()
            for p in where[x]:
                more[p : p + k] = True
            if more.sum() < threshold * n_words:
                words = more
                continue
        out.append(x)
    return np.array(out, np.int64)


def candidate_pairs(met: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    """row, item, k of texts and items that may be a hit: prefix filter by seeds. met(row, k, h) are the texts' seeds that items may have, seeds those
    of item_seeds. Seeds that very many texts share are asked for only by items that consist of such."""
    often = met.groupBy("k", "h").agg(F.count("*").alias("often"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                item, k, n_words, some = (b[c][r].as_py() for c in ("item", "k", "n_words", "some"))
                h, at, n = (np.array([x[c] for x in some], np.int64) for c in ("h", "at", "often"))
                h = asked(k, n_words, h, at, n, threshold)
                yield pa.record_batch([pa.array([item] * len(h), pa.int64()), pa.array([k] * len(h), pa.int32()), pa.array(h)], names=["item", "k", "h"])

    held = seeds.join(often, ["k", "h"]).groupBy("item", "k", "n_words").agg(F.collect_list(F.struct("h", "at", "often")).alias("some"))  # of one item
    rare = held.mapInArrow(choose, "item long, k int, h long")
    return met.select("row", "k", "h").join(rare, ["k", "h"]).select("row", "item", "k").distinct()


def seed_join(docs: DataFrame, benchmark: DataFrame, *, seed_words: int, threshold: float) -> DataFrame:
    """key (id and text hash of a document), doc_id, item_id, coverage, n_tiles, item_words: what ``contaminated`` returns, for a
    benchmark of any size. Neither side passes through the driver but for the bitmap. Pairs are those that share a seed which a hit needs; only
    their texts' other seeds are looked at."""
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = stored(item_seeds(items, seed_words), "item-seeds")
    lengths = sorted(r.k for r in seeds.select("k").distinct().collect())  # 1 to seed_words
    bit = F.shiftrightunsigned("h", 64 - MAP_BITS)
    filled = seeds.select(F.shiftright(bit, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - MAP_BITS}) & 63 as int))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bitmap[filled["at"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2 ** MAP_BITS bits, whatever the benchmark

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for b in parts(batches, "text"):
            for row, key, text in zip(b["row"].to_pylist(), b["key"].to_pylist(), b["text"].to_pylist(), strict=True):
                x = _word_hashes(plain_words(text))
                for k in lengths:
                    h = _gram_hashes(x, k)
                    top = h >> np.uint64(64 - MAP_BITS)
                    at = np.flatnonzero(held[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63)) & np.uint64(1))
                    for p in range(0, len(at), 1 << 16):
                        some = at[p : p + (1 << 16)]
                        yield pa.record_batch([pa.array([v] * len(some), t) for v, t in ((row, pa.int64()), (key["id"], pa.int64()), (key["hash"], pa.int64()), (k, pa.int32()))] + [pa.array(h[some].view(np.int64)), pa.array(some.astype(np.int64))], names=["row", "id", "hash", "k", "h", "at"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), _key().alias("key"), "text").where("text is not null")
    met = stored(rows.mapInArrow(doc_seeds, "row long, id long, hash long, k int, h long, at long"), "doc-seeds")
    pairs = stored(candidate_pairs(met, seeds, threshold), "pairs")
    texts = met.join(pairs.select("row", "k").distinct(), ["row", "k"], "left_semi").groupBy("row", "id", "hash", "k").agg(F.collect_list(F.struct("at", "h")).alias("seeds"))  # of one text
    pairs = pairs.join(texts, ["row", "k"]).join(items, "item").select("id", "hash", "item_id", "k", "seeds", "text")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(len(b)):
                r = b.slice(i, 1).to_pylist()[0]
                item = plain_words(r["text"])
                at, h = np.array([x["at"] for x in r["seeds"]]), np.array([x["h"] for x in r["seeds"]], np.int64).view(np.uint64)
                own = np.isin(h, _gram_hashes(_word_hashes(item), r["k"]))
                if got := covered(item, r["k"], at[own], h[own], threshold):
                    out.append((r["id"], r["hash"], r["item_id"], *got, len(item)))
            yield _found(out, ["id", "hash", "item_id", "coverage", "n_tiles", "item_words"], [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()])

    found = stored(pairs.mapInArrow(tiled, "id long, hash long, item_id long, coverage double, n_tiles int, item_words int"), "contaminated")
    dropped(items, seeds, met)
    return found.select(F.struct("id", "hash").alias("key"), F.col("id").alias("doc_id"), "item_id", "coverage", "n_tiles", "item_words")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, seed_words: int = 5, threshold: float = 0.5, block_chars: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, item_words for each pair of docs(doc_id, text, ...) and benchmark(item_id, text, ...)
    in which tiles of at least seed_words words cover at least the share ``threshold`` of the item's words.

    Null and empty texts match nothing; an item of fewer than seed_words words is found where all of it stands in a row.
    Repeated rows of either side are reported as often as they occur; of equal tiles the first counts. An empty side gives no
    rows. Further columns of either side aren't read.
    """
    items = _small(benchmark, block_chars)
    if items is None:
        return seed_join(docs, benchmark, seed_words=seed_words, threshold=threshold).drop("key")
    block = Block(items, seed_words, threshold)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            rows = [(d, *hit) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) for hit in block(t)]
            yield _found(rows, ["doc_id", "item_id", "coverage", "n_tiles", "item_words"], [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, _FOUND)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, seed_words: int = 5, threshold: float = 0.5, block_chars: int = 8 << 20) -> DataFrame:
    """The rows of docs that ``contaminated`` doesn't report, columns as they are; equal rows stay or go together. With a benchmark of up to
    block_chars there is no shuffle."""
    items = _small(benchmark, block_chars)
    if items is None:
        bad = seed_join(docs, benchmark, seed_words=seed_words, threshold=threshold).select("key").distinct()
        return docs.select(F.struct("*").alias("doc"), _key().alias("key")).join(bad, "key", "left_anti").select("doc.*")
    block = Block(items, seed_words, threshold)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            yield b.filter(pa.array([not block(t) for t in b["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
