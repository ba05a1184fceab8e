"""The queries of this subpackage, one per numbered operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperproof.llm.common import documents


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids, read back from its file set. A null text is empty: the end id alone; repeated rows are all written; further columns aren't read. An empty table gives no rows."""
    from paperproof.llm.tokens import token_digest

    return token_digest(documents(spark, sf_dir), tokenizer_path())


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold at least half of. Nulls and empty texts hold none; repeated rows are reported each. An empty table gives no rows."""
    from paperproof.llm.decontaminate import contaminated

    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), seed_words=5, threshold=0.5)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. A null text has size 0, a null source is one; equal rows are interchangeable. An empty table gives no rows."""
    from paperproof.llm.mixing import mix_plan

    plan = mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and empty texts have fingerprint zero; repeated rows are returned each. An empty table gives no rows."""
    from paperproof.llm.simhash import simhash_groups

    return simhash_groups(documents(spark, sf_dir), k=3, bits=2)


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversion and a metadata record for every page. A null html is an empty page; repeated rows give equal records. An empty table gives no rows."""
    from paperproof.llm.warc import derivative_table

    return derivative_table(documents(spark, sf_dir, "pages"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text. A null text is empty; null ids come first, equal ids stand in order of a hash of their texts. An empty table gives no rows."""
    from paperproof.llm.minhash import edited_pairs

    return edited_pairs(documents(spark, sf_dir), k=5, bins=256, bits=8)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document. A null text is empty and scored like any other; repeated rows are scored each. An empty table gives no rows."""
    from paperproof.llm.quality import quality_scores

    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document. A null text has no words; repeated rows are scanned each. An empty table gives no rows."""
    from paperproof.llm.licenses import license_scan

    return license_scan(documents(spark, sf_dir), threshold=0.9, apart=True, wrapped=True)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. A null html is an empty page with text ''; repeated rows are extracted each. An empty table gives no rows."""
    from paperproof.llm.html import extract

    return extract(documents(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without frequent lines. A null text is one empty line; rows with equal id and text count as one document. An empty table gives no rows."""
    from paperproof.llm.lines import without_frequent_lines

    return without_frequent_lines(documents(spark, sf_dir), digest=True, min_docs=10, min_chars=1)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as SentencePiece ids and back. A null text is empty: no ids; repeated rows are encoded each. An empty table gives no rows."""
    from paperproof.llm.pieces import piece_digest

    return piece_digest(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the rebuilt conversations' prefix trie. Null roles and texts are '', null turns come first, equal turns stand in order of role and digest; rows without a conv_id are in no conversation. An empty table gives no rows."""
    from paperproof.llm.prefixes import prefix_trie, rebuilt

    return prefix_trie(rebuilt(documents(spark, sf_dir, "conversations")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source's words differ from other sources' and from its language's. Nulls are ''; repeated rows count each. An empty table gives no rows."""
    from paperproof.llm.divergence import source_divergence

    return source_divergence(documents(spark, sf_dir), min_docs=3, top=200)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from paperproof.llm import divergence, lines, mixing, prefixes

    return {"op3_source_mix": mixing.ORACLE, "op10_line_dedup": lines.ORACLE, "op12_prefix_trie": prefixes.ORACLE, "op13_source_divergence": divergence.ORACLE}
