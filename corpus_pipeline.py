"""A training corpus from documents: quality, near copies, benchmark passages, source weights, token files.

Each stage works on all rows that its predecessor kept, takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet in the shared folder and reads them again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperproof.llm.common import documents, stored
from paperproof.llm.decontaminate import decontaminated
from paperproof.llm.mixing import mixed
from paperproof.llm.quality import good_documents
from paperproof.llm.queries import tokenizer_path
from paperproof.llm.near import without_near_copies
from paperproof.llm.tokens import token_digest

#: The share of five-word shingles that near copies have in common.
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents' own labels, scores 0.5 or more. Empty texts are scored too."""
    return good_documents(docs, documents(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the least doc_id. SimHash fingerprints meet in shards of
    vantage-point trees; every link is counted from whole shingle sets."""
    return without_near_copies(docs, k=5, similarity=SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's passage."""
    return decontaminated(docs, documents(spark, sf_dir, "benchmark"), seed_words=5, threshold=0.5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, up to three times or not at all."""
    return mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the mix, read back from the token files."""
    return token_digest(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokenize", tokenize)]

#: No stage is SQL's: models, fingerprints, tilings and token files are tested against plain versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
