"""A store of model answers: a prompt is sent once, whatever fails afterwards.

Answers are rows of a Parquet table, keyed by a hash of the prompt and of what else decides the answer. What is asked meets the store in an
anti-join, and what is left is sent in rounds of bounded size, each a Spark job that appends its answers when it is done. A task that
fails repeats its own part of its round at most; a run that is stopped goes on after its last round.
"""

from __future__ import annotations

import hashlib
import json
import math
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperproof.sources.model_client import BUSY, HttpPost, call_model, post_json, request_body
from paperproof.sources.shared import new_path

ANSWERS = "prompt_sha256 string, status_code int, body string, asked_at long"


def prompt_key(url: str, temperature: float) -> Column:
    """The hash that a prompt's answer is kept under: of the address, the settings and the shape asked for, and the prompt. No key of access is in it."""
    rest = hashlib.sha256(json.dumps([url, request_body("", temperature)], sort_keys=True).encode()).hexdigest()
    return F.sha2(F.concat(F.lit(rest), F.col("prompt")), 256)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """prompt_sha256, status_code, body: the best answer of each prompt so far, one that is final before one of a busy server, then the latest."""
    try:
        kept = spark.read.schema(ANSWERS).parquet(store)
    except AnalysisException:  # nothing is written yet
        kept = spark.createDataFrame([], ANSWERS)
    rank = F.struct((~F.col("status_code").isin(*BUSY)).alias("final"), "asked_at", "status_code", "body")
    return kept.groupBy("prompt_sha256").agg(F.max(rank).alias("x")).select("prompt_sha256", "x.status_code", "x.body")


def ask(asked: DataFrame, store: str, *, url: str, api_key: str, http_post: HttpPost = post_json, temperature: float = 0.0, per_round: int = 20_000, per_task: int = 500, threads: int = 4) -> DataFrame:
    """asked(document_id, prompt) to document_id, status_code, body (JSON text), by the store at that path.

    Equal prompts are sent once. A round holds about per_round prompts in tasks of about per_task, and a task has ``threads`` calls open.
    Prompts that only a busy server has answered are sent again by the next ``ask``; a null prompt is an empty one.
    """
    spark = asked.sparkSession
    asked = asked.select("document_id", F.coalesce("prompt", F.lit("")).alias("prompt")).withColumn("prompt_sha256", prompt_key(url, temperature))
    kept, shape = new_path(spark, "prompts"), asked.schema
    asked.write.parquet(kept)  # prompts are made once, and read for what is left and for whose answer is whose
    asked = spark.read.schema(shape).parquet(kept)
    final = stored_answers(spark, store).where(~F.col("status_code").isin(*BUSY)).select("prompt_sha256")
    left = asked.groupBy("prompt_sha256").agg(F.first("prompt").alias("prompt")).join(final, "prompt_sha256", "left_anti")
    todo = new_path(spark, "asked")
    left.write.parquet(todo)
    kind = "prompt_sha256 string, prompt string"
    n = spark.read.schema(kind).parquet(todo).count()
    rounds = max(1, math.ceil(n / per_round))
    if n:
        by_round = new_path(spark, "rounds")
        turn = F.pmod(F.conv(F.substring("prompt_sha256", 1, 8), 16, 10).cast("long"), F.lit(rounds)).cast("int")
        spark.read.schema(kind).parquet(todo).withColumn("round", turn).repartition(rounds, "round").write.partitionBy("round").parquet(by_round)
    for k in range(rounds if n else 0):
        mine = spark.read.schema(f"{kind}, round int").parquet(by_round).where(F.col("round") == k).withColumnRenamed("prompt_sha256", "document_id")
        mine = mine.repartition(max(1, math.ceil(n / rounds / per_task)))
        got = call_model(mine, url=url, api_key=api_key, http_post=http_post, temperature=temperature, threads=threads)
        got.select(F.col("document_id").alias("prompt_sha256"), "status_code", "body", F.lit(time.time_ns()).alias("asked_at")).write.mode("append").parquet(store)
    return asked.select("document_id", "prompt_sha256").join(stored_answers(spark, store), "prompt_sha256", "left").select("document_id", "status_code", "body")
