"""Source divergence audit: how far each source's words are from those of the other sources, and of all, of its language.

Terms are found in bytes: a lookup table over a batch's joined UTF-8 buffer gives their bounds, xxHash groups the slices, and
the bytes of every slice are then compared with those of its group's first. Counts meet in one row per (lang, term), the rows
of a sparse matrix by source; divergences are sums over its segments. Everything is whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from paperproof.llm.common import LOWER, dropped, parts, stored

#: Fixed value: the scale of probabilities.
SCALE = 1_000_000_000
#: The bytes of terms: A-Z, a-z, and all of characters beyond ASCII.
_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_COUNTS = "lang string, source string, term string, n long, docs long"
_FOUND = T.StructType([T.StructField(n, t) for n, t in (("lang", T.StringType()), ("source", T.StringType()), ("part", T.StringType()), ("item", T.StringType()), ("value", T.LongType()))])
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of every term in the joined bytes of rows that offsets part; no term crosses rows."""
    inside = _TERM[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, stops


def grouped(raw: bytes, starts: np.ndarray, stops: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): equal bytes are one group, whatever the digest says."""
    keys = np.fromiter((digest(raw[p:q]) for p, q in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    size, like = stops - starts, first[group]
    same = size == size[like]
    at = np.flatnonzero(same & (like != np.arange(len(like))))
    n = size[at]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    data = np.frombuffer(raw, np.uint8)
    differ = data[np.repeat(starts[at], n) + step] != data[np.repeat(starts[like[at]], n) + step]
    same[at[np.unique(np.repeat(np.arange(len(at)), n)[differ])]] = False
    known: dict[tuple[int, bytes], int] = {}
    more = []
    for i in np.flatnonzero(~same).tolist():  # digests that collide: told apart by their bytes
        key = int(group[i]), raw[starts[i] : stops[i]]
        if key not in known:
            known[key] = len(first) + len(more)
            more.append(i)
        group[i] = known[key]
    return group, np.concatenate((first, np.array(more, first.dtype)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches, "text", 8 << 20):
        text = b["text"].cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = (bytes(memoryview(text.buffers()[2])[offsets[0] : offsets[-1]]) if text.buffers()[2] else b"").translate(LOWER)
        row, starts, stops = bounds(np.frombuffer(raw, np.uint8), offsets - offsets[0])
        if not len(row):
            continue
        term, like = grouped(raw, starts, stops)
        lang, source = (b[c].dictionary_encode() for c in ("lang", "source"))
        owner = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        held, n = np.unique(row * len(like) + term, return_counts=True)  # one for each document and term
        key, where, docs = np.unique(owner[held // len(like)] * len(like) + held % len(like), return_inverse=True, return_counts=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, where, n)
        who, what = key // len(like), like[key % len(like)]
        terms = pa.array([raw[p:q] for p, q in zip(starts[what].tolist(), stops[what].tolist(), strict=True)], pa.binary())
        columns = [lang.dictionary.take(pa.array(who // len(source.dictionary))), source.dictionary.take(pa.array(who % len(source.dictionary))), terms.cast(pa.string()), pa.array(total), pa.array(docs)]
        yield pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it). Null text, lang and source are ''. A (lang, source) group without terms has no row."""
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return own.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / whole), exact for wholes below 9 * 10 ** 15: three decimal digits at a time."""
    left, out = n + 1, (n + 1) // whole
    for _ in range(3):
        left = left % whole * 1000
        out = out * 1000 + left // whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Language:
    """The sources of one language with their whole counts, and the sums of divergences seen so far."""

    def __init__(self, sources: list[str], sizes: list[int], n_terms: int, block: int = 1 << 20):
        self.block, self.sources, self.at = block, sources, {s: i for i, s in enumerate(sources)}
        self.n_terms, self.size = n_terms, int(sum(sizes)) + n_terms
        self.sizes = np.array(sizes, np.int64) + n_terms
        self.none = probability(np.zeros(len(sources), np.int64), self.sizes)
        self.sums = np.zeros((len(sources), len(sources)), np.int64)

    def add(self, who: np.ndarray, counts: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """Add terms: the matrix's nonzeros by source, sorted, with their terms' rows. Gives their probabilities."""
        p, S = probability(counts, self.sizes[who]), len(self.sources)
        held = np.bincount(who, minlength=S)
        cut = np.concatenate(([0], np.cumsum(held)))
        some = np.flatnonzero(held)
        for s in range(S):
            # where s itself has none of a term: its floor against the nonzeros of every source, and against the floors elsewhere
            gone = divergence(self.none[s], self.none) * (n_rows - held)
            gone[some] += np.add.reduceat(divergence(self.none[s], p), cut[some])
            self.sums[s] += gone
        dense = max(1, self.block // S)
        by_row = np.argsort(rows, kind="stable")
        edge = np.searchsorted(rows[by_row], np.arange(n_rows + 1))
        for r in range(0, n_rows, dense):  # what changes where s has the term, in blocks of terms by all sources
            top = min(n_rows, r + dense)
            own = by_row[edge[r] : edge[top]]
            q = np.broadcast_to(self.none, (top - r, S)).copy()
            q[rows[own] - r, who[own]] = p[own]
            own = own[np.argsort(who[own], kind="stable")]
            for k in range(0, len(own), dense):
                few = own[k : k + dense]
                there = q[rows[few] - r]
                change = divergence(p[few, None], there) - divergence(self.none[who[few], None], there)
                heads = np.flatnonzero(np.concatenate(([True], np.diff(who[few]) > 0)))
                self.sums[who[few][heads]] += np.add.reduceat(change, heads, axis=0)
        return p


def _diverging(known: dict[str, tuple[list[str], list[int], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Language] = {}
        for b in batches:
            langs = b["lang"].dictionary_encode()
            for i, name in enumerate(langs.dictionary.to_pylist()):
                mine = b.filter(pa.array(langs.indices.to_numpy() == i))
                x = seen[name] if name in seen else seen.setdefault(name, Language(*known[name]))
                each = mine["by_source"]
                flat = each.flatten()
                source = flat.field("source").dictionary_encode()
                who = np.array([x.at[s] for s in source.dictionary.to_pylist()], np.int64)[source.indices.to_numpy()]
                counts = flat.field("n").to_numpy()
                rows = np.repeat(np.arange(len(mine)), np.diff(each.offsets.to_numpy()))
                order = np.argsort(who, kind="stable")
                who, counts, rows = who[order], counts[order], rows[order]
                p, q = x.add(who, counts, rows, len(mine)), probability(mine["n"].to_numpy(), x.size)[rows]
                over = np.flatnonzero(p > q)
                f = divergence(p[over], q[over])
                terms = mine["term"].take(pa.array(rows[over]))
                yield pa.record_batch([pa.array([name] * len(over), pa.string()), pa.array(x.sources, pa.string()).take(pa.array(who[over])), pa.array(["term"] * len(over), pa.string()), terms.cast(pa.string()), pa.array(f)], names=_FOUND.names)
        for name, x in seen.items():
            S, names = len(x.sources), pa.array(x.sources, pa.string())
            for s in range(S):
                others = np.delete(np.arange(S), s)
                yield pa.record_batch([pa.array([name] * (S - 1), pa.string()), pa.array([x.sources[s]] * (S - 1), pa.string()), pa.array(["pair"] * (S - 1), pa.string()), names.take(pa.array(others)), pa.array(x.sums[s][others])], names=_FOUND.names)

    return run


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` holds each other source of the language and the divergence from it
    over all kept terms, part ``term`` the ``top`` terms that the source uses more than its language does.

    Terms of at least min_docs documents of the language are kept. Null texts, languages and sources are ''; repeated rows
    count each; other columns aren't read; an empty table gives no rows. The groups' names and totals go to every task: they
    are at most as many as the result has rows, and where languages have many sources, only the root of it. A language's
    sources are the width of its matrix, a square of which each task holds.
    """
    groups = stored(docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct(), "divergence-groups")
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = stored(by_term.where(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
    n_terms = dict(kept.groupBy("lang").count().collect())
    sizes = {(r.lang, r.source): r.n for r in kept.select("lang", F.explode("by_source").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n")).collect()}
    known: dict[str, tuple[list[str], list[int], int]] = {}
    for lang, source in sorted(map(tuple, groups.collect())):
        x = known.setdefault(lang, ([], [], n_terms.get(lang, 0)))
        x[0].append(source)
        x[1].append(sizes.get((lang, source), 0))
    found = stored(kept.mapInArrow(_diverging({k: x for k, x in known.items() if x[2]}), _FOUND), "divergences")
    dropped(kept)
    other = groups.select("lang", F.col("source").alias("item"))
    every = groups.join(other, "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = every.unionByName(found.where("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = ranked(found.where("part = 'term'").drop("part")).where(F.col("rank") <= top)
    return ranked(pairs).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT lang, sum(n)::HUGEINT AS size, count(*)::HUGEINT AS v FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT w.lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (s.size + l.v) AS p, 1 + (1000000000 * (k.n + 1)) // (l.size + l.v) AS q
      FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM every QUALIFY part = 'pair' OR rank <= 200
"""
