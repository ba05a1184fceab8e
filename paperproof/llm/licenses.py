"""License scans: an exact set-similarity join of text blocks with license templates, beside fixed phrases.

A block (a line of a text, or a run of lines that may hold a wrapped notice) meets a template if it holds at least the share ``threshold`` of the template's distinct words.
Template words are ordered by their frequency over all documents, rarest first. A block that misses more than the
allowed words of a template still holds one of its prefix, the rarest few, so only blocks that share a prefix word are
candidates; then the length filter (too few template words in the block) and the positional filter (too few words left
behind the first shared one) drop pairs before the rest is counted. The templates are a fixed set of a few hundred words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperproof.llm.common import parts, stored
from paperproof.llm.decontaminate import plain_words

# Phrases that are licenses where their words stand consecutively.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Notices as they are commonly given with a work.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT license"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl-3", "Licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "Licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal public domain dedication"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced or distributed without the prior written permission of the publisher"),
    ("proprietary", "All rights reserved"),
)

# Words that tell templates of one wording apart; a template asks for its own in full. Of a family's templates that one
# block meets, one with more of them covers one with fewer.
DISTINCT = ("lesser", "affero", "sharealike", "noncommercial", "noderivatives", "nc", "nd", "sa", "2", "3")
FAMILIES = {"gpl-2": "gnu", "gpl-3": "gnu", "lgpl-3": "gnu", "agpl-3": "gnu", "cc-by": "cc", "cc-by-sa": "cc", "cc-by-nc": "cc", "cc-by-nd": "cc"}


def phrase_places(w: list[bytes], phrases: list[list[bytes]]) -> list[list[int]]:
    """For each phrase the word positions where it starts; every place counts."""
    out: list[list[int]] = [[] for _ in phrases]
    for k, phrase in enumerate(phrases):
        if not all(x in w for x in phrase):
            continue
        at = -1
        try:
            while True:
                at = w.index(phrase[0], at + 1)
                if w[at : at + len(phrase)] == phrase:
                    out[k].append(at)
        except ValueError:
            pass
    return out


def line_runs(lines: list[list[bytes]], sets: list[tuple[frozenset, int, int]]) -> Iterator[frozenset]:
    """Template and distinguishing words of the shortest run of two lines or more with enough of them, for each of the templates' (words, need,
    length) and each first line that has such a run. A template's distinguishing words are all asked for.

    A run may hold any words in its first and last line, and fewer than length words between them: a notice of that length that is
    wrapped over lines is in one whole. Each template's window passes over the lines once."""
    marks = frozenset(x.encode() for x in DISTINCT)
    every = marks.union(*(x for x, _, _ in sets)) if sets else marks
    upto, told = [0], []  # words before each line; the lines that hold a word of a template, with those words
    for i, line in enumerate(lines):
        upto.append(upto[-1] + len(line))
        if line and (some := every.intersection(line)):
            told.append((i, some))
    whole = frozenset().union(*(x for _, x in told))
    for all_words, need, length in sets:
        if len(all_words & whole) < need:
            continue
        own = all_words & marks
        enough = lambda got: len(got) >= need and own <= got  # noqa: B023, E731
        mine = [(k, i, x) for k, (i, some) in enumerate(told) if (x := all_words & some)]
        n: Counter = Counter()  # of the window's lines that hold each word; both its ends only move on
        end = 0
        for at, (k, i, first) in enumerate(mine):
            if end <= at:
                end = at + 1
                n.update(first)
            while not enough(n.keys()) and end < len(mine) and upto[mine[end][1]] - upto[i + 1] < length:
                n.update(mine[end][2])
                end += 1
            if end > at + 1 and enough(n.keys()) and not enough(first):
                last = mine[end - 1][0]
                yield frozenset(n) | marks & frozenset().union(*(x for _, x in told[k : last + 1]))
            for x in first:
                n[x] -= 1
                if not n[x]:
                    del n[x]


def blocks(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.9, wrapped: bool = False) -> DataFrame:
    """One pass over the texts. With wrapped, runs of lines are blocks too, numbered after the lines. Rows of three kinds: of each document (kind 'd': key and phrase findings), of each block that
    holds enough template words for the easiest template (kind 'b': the words), and of word counts (kind 'w')."""
    split = [p.encode().split() for p, _ in phrases]
    vocabulary = frozenset(x for _, t in templates for x in plain_words(t))
    least = min((ceil(threshold * len(set(plain_words(t))) - 1e-9) for _, t in templates), default=1 << 30)
    sets = [(frozenset(x), max(1, ceil(threshold * len(set(x)) - 1e-9)), len(x)) for _, t in templates if (x := plain_words(t))]
    schema = pa.schema([("kind", pa.string()), ("row", pa.string()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.list_(pa.int64()))), ("block", pa.int32()), ("words", pa.list_(pa.string())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, counts = TaskContext.get().partitionId(), 0, Counter()
        for b in parts(batches, "text"):
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                row, w = f"{task}.{number}", plain_words(text)
                number += 1
                rows.append(("d", row, doc_id, len(w), phrase_places(w, split), None, None, None))
                lines = [plain_words(line) for line in (text or "").split("\n")]
                if wrapped:
                    for i, held in enumerate(line_runs(lines, sets), len(lines)):
                        rows.append(("b", row, doc_id, None, None, i, sorted(x.decode() for x in held), None))
                for i, line in enumerate(lines):
                    held = vocabulary.intersection(line)
                    counts.update(held)
                    if len(held) >= least:
                        rows.append(("b", row, doc_id, None, None, i, sorted(x.decode() for x in held), None))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows = [("w", None, None, None, None, None, [x.decode()], n) for x, n in counts.items()]
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "kind string, row string, doc_id long, n_words long, starts array<array<long>>, block int, words array<string>, n long")


def template_words(spark, counts: DataFrame, templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """(template, label, size, need, word, place, rank) for the words of each template in the order of their frequency, rarest first.

    need is the number of words a block must hold; the prefix is the words with place <= size - need. rank is a word's place in
    the same order of all templates' words."""
    rows = [(n, label, len(w), max(1, ceil(threshold * len(w) - 1e-9)), x.decode()) for n, (label, text) in enumerate(templates) if (w := set(plain_words(text))) for x in sorted(w)]
    words = spark.createDataFrame(rows, "template int, label string, size int, need int, word string").coalesce(1)
    known = words.join(F.broadcast(counts), "word", "left").fillna(0, ["n"])  # counts: a row per word of the fixed templates
    place = F.row_number().over(W.partitionBy("template").orderBy("n", "word")) - 1
    rank = F.dense_rank().over(W.orderBy("n", "word"))  # of the fixed templates' words
    return known.select("template", "label", "size", "need", "word", place.alias("place"), rank.alias("rank"))


def template_matches(held: DataFrame, order: DataFrame) -> DataFrame:
    """(row, block, template, label, containment) for each pair that meets the threshold: the join proper.

    held(row, block, words), order as of template_words. Exact: the filters drop no pair that meets it.
    """
    ranks = F.create_map(*[x for r in order.select("word", "rank").distinct().collect() for x in (F.lit(r["word"]), F.lit(r["rank"]))] or [F.lit(""), F.lit(0)])  # of the fixed templates' words
    sort = F.array_sort(F.transform("words", lambda w: F.struct(F.try_element_at(ranks, w).alias("rank"), w.alias("word"))))
    tokens = held.select("row", "block", F.size("words").alias("n"), F.posexplode(sort).alias("pos", "token")).select("row", "block", "n", "pos", "token.word")
    prefix = order.where("place <= size - need")
    # prefix and length filter: the block holds a rare word of the template, and words enough
    shared = tokens.join(F.broadcast(prefix), "word").where("n >= need")
    first = shared.groupBy("row", "block", "template").agg(F.min(F.struct("place", "pos")).alias("first"), F.any_value("n").alias("n"), F.any_value("size").alias("size"), F.any_value("need").alias("need"))
    # positional filter: of either side, what stands in the order from the first shared word on must be enough
    pairs = first.where("least(size - first.place, n - first.pos) >= need").select("row", "block", "template")
    counted = held.join(pairs, ["row", "block"]).join(F.broadcast(order.groupBy("template", "label", "size", "need").agg(F.collect_list("word").alias("all"))), "template")
    overlap = F.size(F.array_intersect("words", "all"))
    return counted.where(overlap >= F.col("need")).select("row", "block", "template", "label", (overlap / F.col("size")).alias("containment"))


def told_apart(met: DataFrame, held: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Those of met that hold their template's distinguishing words in full and that no other of their family in the block covers."""
    own = [(n, FAMILIES.get(label, label), [x for x in DISTINCT if x.encode() in plain_words(text)]) for n, (label, text) in enumerate(templates)]
    marks = F.broadcast(met.sparkSession.createDataFrame(own, "template int, family string, own array<string>"))  # a row per fixed template
    whole = met.join(marks, "template").join(held, ["row", "block"]).where(F.size(F.array_except("own", "words")) == 0).drop("words")
    others = whole.groupBy("row", "block").agg(F.collect_set(F.struct("family", "own")).alias("others"))
    covers = lambda x: (x["family"] == F.col("family")) & (F.size(x["own"]) > F.size("own")) & (F.size(F.array_except("own", x["own"])) == 0)
    return whole.join(others, ["row", "block"]).where(~F.exists("others", covers)).select("row", "block", "template", "label", "containment")


def license_scan(docs: DataFrame, *, phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.9, apart: bool = False, wrapped: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs(doc_id, text, ...).

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; a null text has none. n_base counts
    the places of all phrases, first_word and last_word are the least and greatest of their starts (null without any).
    labels are those of the phrases and of the templates that a line of the text contains; '' if there are none. score is
    1 with a phrase, otherwise the largest containment at the threshold or above, otherwise 0. Repeated rows are scanned each;
    further columns aren't read; an empty table gives no rows.
    With apart, templates of nearly the same words are told apart (see told_apart); without, each one that meets the threshold counts.
    With wrapped, notices over several lines are found too.
    """
    spark = docs.sparkSession
    scan = stored(blocks(docs, phrases, templates, threshold, wrapped), "licenses")
    counts = scan.where("kind = 'w'").groupBy(F.element_at("words", 1).alias("word")).agg(F.sum("n").alias("n"))
    order = stored(template_words(spark, counts, templates, threshold), "templates")
    held = scan.where("kind = 'b'").select("row", "block", "words")
    met = template_matches(held, order)
    if apart:
        met = told_apart(met, held, templates)
    met = stored(met.groupBy("row").agg(F.collect_set("label").alias("met"), F.max("containment").alias("containment")), "license-matches")
    starts = F.flatten("starts")
    base = F.filter(F.array(*[F.when(F.size(F.get("starts", k)) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull()) if phrases else F.array().cast("array<string>")
    found = scan.where("kind = 'd'").join(met, "row", "left")
    both = F.array_sort(F.array_union(base, F.coalesce("met", F.array().cast("array<string>"))))
    score = F.when(F.size(starts) > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def license_spans(docs: DataFrame, *, templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """doc_id, line (from 0), label, containment for each line of docs that meets a template."""
    scan = stored(blocks(docs, (), templates, threshold), "licenses")
    counts = scan.where("kind = 'w'").groupBy(F.element_at("words", 1).alias("word")).agg(F.sum("n").alias("n"))
    order = stored(template_words(docs.sparkSession, counts, templates, threshold), "templates")
    held = scan.where("kind = 'b'")
    met = template_matches(held.select("row", "block", "words"), order)
    return met.join(held.select("row", "block", "doc_id"), ["row", "block"]).select("doc_id", F.col("block").alias("line"), "label", "containment")
