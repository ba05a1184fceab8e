"""Mixing sources to target weights, by systematic sampling. DataFrame functions only.

Within a source, documents stand in order of size, and each has the same expected number of copies: the source's target
over its size. A random offset is added once to the running sum of these, and a document is emitted once for each
integer that the sum crosses in it. As the order is by size, the words taken differ from the target by about one
document's. The running sum is a rank times a rate; ranks come from one range shuffle of ids and sizes, in which a source that
holds a third of all rows spans a third of the partitions, and from the row counts of the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperproof.llm.common import dropped, stored

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """sizes(source, source_size) with target and u, a source's offset in [0, 1).

    Sources in code point order, null last, weigh as weights says, over and over, and share all sizes. No target passes
    most times its source's size; the rest is shared by weight again until none does. That ends at one level L with target
    least(most * size, weight * L), and L is the largest of the levels met while sources fill up in order of size to weight.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), ((nth - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    from_here = F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every) - before).cast("double") / from_here)
    s = s.withColumn("level", F.max("level").over(every))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"), u.alias("u"))


def copies_of(sized: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """The rows of sized(source, size, id, tie, ...) with source_size, target and copies. Rows stand in the order of these four columns."""
    by = ["source", "size", "id", "tie"]
    ordered = stored(sized.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "mix-order").withColumn("part", F.shiftright("at", 33))
    runs = stored(ordered.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.sum("size").alias("words")), "mix-runs")
    start = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    aims = targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most, seed)
    runs = runs.withColumn("start", start)
    aims = stored(runs.join(aims, runs["source"].eqNullSafe(aims["source"])).select(runs["source"], "part", "first_at", "start", "source_size", "target", "u"), "mix-aims")
    both = ordered.join(aims, ordered["source"].eqNullSafe(aims["source"]) & (ordered["part"] == aims["part"])).drop(aims["source"])
    rank = (F.col("start") + F.col("at") - F.col("first_at")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor((rank + 1) * rate + F.col("u")) - F.floor(rank * rate + F.col("u"))
    return both.withColumn("copies", copies.cast("long"))


def mix_plan(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of docs(doc_id, text, source, ...).

    size is the number of words [^\\x20\\x09-\\x0D]+, 0 for a null text. A null source is a source. Rows that tie in size
    stand by doc_id and text; equal rows are interchangeable. A source of size 0 has target 0 and copies 0. No document
    has more than most copies. Further columns of docs aren't read. Reruns give the same copies. Texts are read once and never moved.
    """
    sized = stored(docs.select("source", n_words("text").alias("size"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie")), "mix-sizes")
    return copies_of(sized, **settings).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """docs with each row as often as mix_plan says, columns as they are. The plan is made of ids and sizes; texts meet it by one join.

    Equal rows (by doc_id, source and text) share their copies evenly, a remainder going to any of them."""
    key = F.struct(F.col("source"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))  # a struct equals another with the same nulls
    docs = docs.select(F.struct("*").alias("doc"), key.alias("key"))
    sized = stored(docs.select("key.*", n_words("doc.text").alias("size")), "mix-sizes")
    plan = copies_of(sized, **settings).groupBy(F.struct("source", "id", "tie").alias("key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    plan = stored(plan.where("copies > 0"), "mix-plan")
    dropped(sized)
    met = docs.join(plan, "key")
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.lit(0)))
    share = lambda k: F.floor(k * F.col("copies") / F.col("rows"))
    met = met.withColumn("nth", nth).withColumn("own", (share(F.col("nth")) - share(F.col("nth") - 1)).cast("int")).where("own > 0")
    return met.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("own")))).select("doc.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * max(level) OVER ()) AS target,
        CAST(CAST('0x' || substr(md5('42:' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS DOUBLE) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(k * rate + u) - floor((k - 1) * rate + u)) AS BIGINT) AS taken FROM r
"""
