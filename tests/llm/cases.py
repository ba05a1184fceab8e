"""Awkward documents: nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size long, fingerprint string, label int"


def docs(spark, rows):
    """rows: (doc_id, text[, source]); the further columns bear names that operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 7, 7, "x", 7) for r in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One two three four five six seven."), (4, "One two three four five six seven."), (5, "été größe 'S don't İ ǅ Σς 42 x²\ta b é <|endoftext|>"), (6, "word " * 30_000), (None, "No id here at all."), (7, "漢字かな交じり文 😀!! ...")]
