"""The row-local steps on a stream: adapters, validation and decisions run as they do in batch, and counts keep a running state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperproof.operators.annotation import adapt_annotations
from paperproof.operators.profile import profile_state
from paperproof.operators.validate import decide


def annotation_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files with ground_truth as they arrive."""
    return spark.readStream.schema("ground_truth string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def decided(annotations: DataFrame, **settings) -> DataFrame:
    """document_id, requires_review, reasons of each annotation that can be read. Append mode; no state."""
    good = adapt_annotations(annotations).where("error IS NULL")
    return decide(good, **settings).select("document_id", "decision.requires_review", "decision.reasons")


def reason_counts(decisions: DataFrame) -> DataFrame:
    """reason, documents; 'accepted' counts those without a reason. Complete or update mode: the state is a row per reason."""
    reason = F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("accepted"))))
    return decisions.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("documents"))


def running_profile(annotations: DataFrame) -> DataFrame:
    """The profile's state of all that has arrived, a row for each counter; update mode gives the counters that have changed."""
    return profile_state(annotations)
