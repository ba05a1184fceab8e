"""Prefix trie of conversations: what turns they share from the start, and what a cache of shared prefixes saves.

A turn is 20 bytes: 128 bits of the SHA-256 of its role and text, and the text's length. A conversation is its turns' bytes in
a row, so that Spark's order of binary columns is the order of turns. Equal conversations meet in chunks of neighbouring ids
first. The rest is an external mergesort that carries LCPs (the number of turns shared with the row before):

* a range shuffle parts the chunks by key, and each task writes sorted runs, front-coded by their LCPs, as a stored table;
* the runs of a part meet in one task, of bounded bytes, where a loser tree merges them: of two runs' heads, the one that
  shares more turns with the last row out comes first, so only turns beyond those are ever compared;
* a stack of the open path takes the merged rows and gives out each node when no further row can stand below it.

Nodes that neighbouring parts share give partial sums, which meet by their digest. A part knows which these are by the last
key before it and the first key after it, so each shared node counts as a node in its first part alone, and sums add up.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from paperproof.llm.common import dropped, stored

#: Bytes of a turn: 16 of its digest, 4 of its text's length.
UNIT, DIGEST = 20, 16
NOTHING = hashlib.sha256(b"").hexdigest()

_RUN = "part int, first binary, last binary, lcps array<int>, rests array<binary>, chunks array<int>, ns array<long>, ids array<string>"
_LONGS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_NODE = T.StructType([*(T.StructField(n, T.LongType()) for n in _LONGS), T.StructField("ends_sha256", T.StringType()), T.StructField("node", T.BinaryType()), T.StructField("parent", T.BinaryType())])


def turn_unit(role: Column, text: Column) -> Column:
    """A turn as 40 hex digits; equal turns and no others (but for a collision of 128 bits) are equal."""
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    return F.concat(digest, F.lpad(F.lower(F.hex(F.octet_length(text))), 2 * (UNIT - DIGEST), "0"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, units: each conversation with its first h turns taken from conversation conv_id - conv_id % 5, h = crc32(conv_id) % 9.

    Turns are in order of turn (null first), role and digest; null roles and texts are ''; rows without a conv_id belong to no
    conversation. One shuffle: conversations that share their first turns are in one partition."""
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = F.col("conv_id") - F.col("conv_id") % 5
    turns = conversations.where("conv_id IS NOT NULL").select(base.alias("base"), "conv_id", "turn", said("role").alias("role"), turn_unit(said("role"), said("text")).alias("unit")).repartition("base")
    own = turns.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "unit")))["unit"].alias("units"))
    family = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", "units")).alias("members"))  # at most nine
    head = F.get(F.filter("members", lambda m: m["conv_id"] == F.col("base")), F.lit(0))["units"]
    each = family.select(F.coalesce(F.slice(head, 1, 8), F.array().cast("array<string>")).alias("head"), F.explode("members").alias("m")).select("head", "m.*")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    return each.select("conv_id", F.concat(F.slice("head", F.lit(1), h), F.slice("units", h + 1, F.greatest(F.size("units") - h, F.lit(0)))).alias("units"))


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns two keys share, of which ``known`` are known."""
    n = min(len(a), len(b)) // UNIT
    while known < n and a[known * UNIT : known * UNIT + UNIT] == b[known * UNIT : known * UNIT + UNIT]:
        known += 1
    return known


def _run(part: int, rows: list[tuple[bytes, int, int, str]]) -> dict:
    rows.sort(key=lambda r: r[:2])
    lcps, before = [], b""
    for r in rows:
        lcps.append(shared(before, r[0]))
        before = r[0]
    return {"part": part, "first": rows[0][0], "last": before, "lcps": lcps, "rests": [r[0][n * UNIT :] for n, r in zip(lcps, rows, strict=True)], "chunks": [r[1] for r in rows], "ns": [r[2] for r in rows], "ids": [r[3] for r in rows]}


def _runs(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("lcps", pa.list_(pa.int32())), ("rests", pa.list_(pa.binary())), ("chunks", pa.list_(pa.int32())), ("ns", pa.list_(pa.int64())), ("ids", pa.list_(pa.string()))])
        rows: list[tuple[bytes, int, int, str]] = []
        size, part = 0, 0
        for b in batches:
            for part, key, chunk, n, ids in zip(*(b[c].to_pylist() for c in ("part", "key", "chunk", "n", "ids")), strict=True):
                rows.append((key, chunk, n, ids))
                size += len(key) + len(ids) + 64
                if size >= most:
                    yield pa.RecordBatch.from_pylist([_run(part, rows)], schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([_run(part, rows)], schema)

    return run


def unfolded(run: dict) -> Iterator[tuple[int, bytes, int, int, str]]:
    """(lcp, key, chunk, n, ids) of a front-coded run."""
    key = b""
    for lcp, rest, chunk, n, ids in zip(run["lcps"], run["rests"], run["chunks"], run["ns"], run["ids"], strict=True):
        key = key[: lcp * UNIT] + rest
        yield lcp, key, chunk, n, ids


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Rows of sorted runs in one order, each with the turns that it shares with the row before; a loser tree that keeps LCPs."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    lcps = [0] * k  # of each head, with the row that beat it, or with the last row out
    losers: list[int | None] = [None] * max(k, 1)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        n = shared(x[1], y[1], lcps[a])
        a_first = (x[1][n * UNIT : n * UNIT + UNIT], x[2]) <= (y[1][n * UNIT : n * UNIT + UNIT], y[2])
        lcps[b if a_first else a] = n
        return (a, b) if a_first else (b, a)

    top = 0 if k else None
    for i in range(k):
        w: int | None = i
        at = (i + k) // 2
        while at:
            if losers[at] is None:
                losers[at], w = w, None
                break
            w, losers[at] = play(w, losers[at])
            at //= 2
        top = w if w is not None else top
    while top is not None and heads[top] is not None:
        yield (lcps[top], *heads[top][1:])
        heads[top] = next(runs[top], None)
        lcps[top] = heads[top][0] if heads[top] else 0
        w, at = top, (top + k) // 2
        while at:
            w, losers[at] = play(w, losers[at])
            at //= 2
        top = w


class Path:
    """The open path, a stack; nodes go to columns when they are finished, children before parents."""

    def __init__(self, before: int, after: int):
        self.before, self.after = before, after  # turns shared with the row before this part and after it, -1 without one
        self.key = b""
        self.open: list[list] = []  # conv_id, n_convs, n_children, n_leaves, saved_tokens, digest of ends, whether an earlier part has it
        self.out = {n: array("q") for n in _LONGS if n != "parent_conv_id"}
        self.ends: dict[int, str] = {}
        self.shared: dict[int, bytes] = {}

    def close(self, to: int, last: bool = False) -> None:
        while len(self.open) - 1 > to:
            d = len(self.open) - 1
            conv, n, children, leaves, saved, ends, earlier = self.open.pop()
            later = last and d <= self.after
            if d * UNIT == len(self.key) and not later:  # the last row's end, which nothing has extended
                leaves = 1
            size = int.from_bytes(self.key[d * UNIT - UNIT + DIGEST : d * UNIT]) if d else 0
            saved += (n if earlier else n - 1) * size
            at = len(self.out["depth"])
            for name, value in zip(("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"), (conv, d, n, children, leaves, saved), strict=True):
                self.out[name].append(value)
            if ends is not None:
                self.ends[at] = ends.hexdigest()
            if earlier or later:
                self.shared[at] = hashlib.sha256(self.key[: d * UNIT]).digest()
            if self.open:
                up = self.open[-1]
                up[0] = min(up[0], conv)
                up[1] += n
                up[2] += not earlier
                up[3] += leaves
                up[4] += saved

    def add(self, lcp: int, key: bytes, n: int, ids: str) -> None:
        first = not self.open
        if first or len(key) != len(self.key) or lcp * UNIT != len(key):
            if not first:
                self.close(lcp)
            self.key = key
            least = int(ids[: ids.find(",")] if "," in ids else ids)
            while len(self.open) <= len(key) // UNIT:
                self.open.append([least, 0, 0, 0, 0, None, first and len(self.open) <= self.before])
        top = self.open[-1]
        top[0] = min(top[0], int(ids.split(",", 1)[0]))
        top[1] += n
        if top[5] is None:
            top[5] = hashlib.sha256(ids.encode())
        else:
            top[5].update(b"," + ids.encode())

    def table(self) -> pa.Table:
        self.close(-1, last=True)
        n, depth, conv = len(self.out["depth"]), self.out["depth"], self.out["conv_id"]
        parent_conv: list[int | None] = [None] * n
        parent: list[bytes | None] = [None] * n
        above: dict[int, int] = {}
        for i in range(n - 1, -1, -1):  # parents before children
            up = above.get(depth[i] - 1)
            above[depth[i]] = i
            if up is not None:
                parent[i] = self.shared.get(up)
                parent_conv[i] = None if up in self.shared else conv[up]
        columns = [pa.array(parent_conv, pa.int64()) if c == "parent_conv_id" else pa.array(memoryview(self.out[c]), pa.int64()) for c in _LONGS]
        columns += [pa.array([self.ends.get(i) for i in range(n)], pa.string()), pa.array([self.shared.get(i) for i in range(n)], pa.binary()), pa.array(parent, pa.binary())]
        return pa.table(columns, names=_NODE.names)


def _nodes(runs: pa.Table, edge: pa.Table) -> pa.Table:
    (near,) = edge.to_pylist()
    path = Path(-1 if near["before"] is None else shared(near["before"], near["first"]), -1 if near["after"] is None else shared(near["last"], near["after"]))
    for lcp, key, _, n, ids in merged([unfolded(r) for r in runs.to_pylist()]):
        path.add(lcp, key, n, ids)
    return path.table()


def prefix_trie(sequences: DataFrame, part_bytes: int = 16 << 20, run_bytes: int = 4 << 20) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of conv_id, units rows.

    conv_ids are distinct. A part's bytes, of keys and ids, are about part_bytes, and the number of parts follows; a
    conversation is one row. No conversations give no nodes; one without turns is a member of the root.
    """
    spark = sequences.sparkSession
    whole = stored(sequences.select("conv_id", F.unhex(F.array_join("units", "")).alias("key")), "trie-keys")
    near = whole.repartitionByRange("conv_id").withColumn("chunk", F.spark_partition_id())  # chunks are ranges of ids, in order
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")), ",")
    chunks = stored(near.groupBy("key", "chunk").agg(F.count("*").alias("n"), ids.alias("ids")), "trie-chunks")
    dropped(whole)
    size = chunks.agg(F.sum(F.octet_length("key") + F.octet_length("ids") + 64)).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / part_bytes))
    parted = chunks.repartitionByRange(n_parts, "key").withColumn("part", F.spark_partition_id())
    runs = stored(parted.mapInArrow(_runs(run_bytes), _RUN), "trie-runs")
    dropped(chunks)
    in_order = W.orderBy("part")  # a row for each part
    edges = runs.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumns({"before": F.lag("last").over(in_order), "after": F.lead("first").over(in_order)})
    nodes = stored(runs.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(_nodes, _NODE), "trie-nodes")
    dropped(runs)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    met = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.max("parent").alias("parent"))
    met = stored(met.select(*_NODE.names), "trie-shared")
    every = nodes.where("node IS NULL").unionByName(met)
    above = met.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv"))
    below = every.where("parent IS NOT NULL").join(above, "parent").withColumn("parent_conv_id", F.col("parent_conv")).drop("parent_conv")
    out = every.where("parent IS NULL").unionByName(below)
    return out.select(*_LONGS, F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), sha256(strlen(role) || ':' || role || text)) AS pos FROM t),
events AS (SELECT conv_id, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: list_concat([ascii((conv_id::VARCHAR)[i])::BIGINT], [256::BIGINT, 256, 256, 256, 256, 256, 256, 256]))) AS e FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, e), lambda a, x: CASE WHEN x = 256 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, x) END), 4294967295) % 9 AS h FROM events),
r AS (SELECT c.conv_id, 0 AS side, pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN o USING (conv_id) WHERE pos > h),
w AS (SELECT conv_id, list([role, text]) OVER (PARTITION BY conv_id ORDER BY side, pos) AS path, strlen(text) AS size, lead(pos) OVER (PARTITION BY conv_id ORDER BY side, pos) IS NULL AS ends FROM r),
m AS (SELECT conv_id, path, size, ends FROM w UNION ALL SELECT conv_id, [], 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (SELECT path, len(path) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path),
k AS (SELECT path[:-2] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[:up] AS path, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS up FROM x) GROUP BY ALL)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN s USING (path) LEFT JOIN n p ON x.depth > 0 AND p.path = x.path[:-2]
"""
