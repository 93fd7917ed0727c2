"""Generation that asks once: answers are kept by the prompt's hash, failures are tried again and stay by themselves."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stash
from .numbering import with_running
from .summarize import Stub, Summarizer

ANSWERS = "prompt_sha string, ai_summary string, ai_model string"


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """prompt_sha, ai_summary and ai_model of all answers so far."""
    spark.createDataFrame([], ANSWERS).write.mode("append").parquet(path)
    return spark.read.schema(ANSWERS).parquet(path)


def generate_once(asked: DataFrame, path: str, summarizer: Summarizer | None = None, attempts: int = 3, wait: float = 1.0, at_once: int = 4, wave: int = 1000) -> DataFrame:
    """topic_id, ai_summary, ai_model and error of every prompt of ``asked`` (topic_id, prompt).

    Prompts that ``path`` has an answer to are not asked again, and equal prompts are asked once. The others go in waves
    of ``wave`` prompts, ``at_once`` at a time; each wave's answers are stored before the next begins, so that a lost
    executor repeats no more than what it was asking. A failing prompt is tried ``attempts`` times, with a pause of ``wait``
    seconds that doubles; if it still fails it has an error, is not stored, and the others go on. Null prompts are errors.
    """
    make, spark = summarizer or Stub(), asked.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sha, prompt in zip(b["prompt_sha"], b["prompt"], strict=True):
                for n in range(attempts):
                    try:
                        out.append((sha, make.generate(prompt), make.model, None))
                        break
                    except Exception as e:  # concerns this prompt only
                        if n + 1 == attempts:
                            out.append((sha, None, None, str(e) or type(e).__name__))
                        else:
                            time.sleep(wait * 2**n)
            yield pd.DataFrame(out, columns=["prompt_sha", "ai_summary", "ai_model", "error"])

    keyed = stash(asked.select("topic_id", "prompt", F.sha2("prompt", 256).alias("prompt_sha")))
    new = keyed.where("prompt IS NOT NULL").groupBy("prompt_sha").agg(F.first("prompt").alias("prompt")).join(stored_answers(spark, path), "prompt_sha", "left_anti")
    waves = stash(with_running(new, ["prompt_sha"], n=F.lit(1)).withColumn("wave", F.floor(F.col("n") / wave)))
    errors = spark.createDataFrame([], "prompt_sha string, error string")
    for k in range((waves.agg(F.max("wave").alias("k")).first()["k"] or 0) + 1):
        tasks = waves.where(F.col("wave") == k).select("prompt_sha", "prompt").repartition(at_once)
        got = stash(tasks.mapInPandas(run, ANSWERS + ", error string"))
        got.where("error IS NULL").select("prompt_sha", "ai_summary", "ai_model").write.mode("append").parquet(path)
        errors = errors.unionByName(got.where("error IS NOT NULL").select("prompt_sha", "error"))
    answered = keyed.join(stored_answers(spark, path).dropDuplicates(["prompt_sha"]), "prompt_sha", "left").join(errors, "prompt_sha", "left")
    return answered.select("topic_id", "ai_summary", "ai_model", F.when(F.col("prompt").isNull(), "no prompt").otherwise(F.col("error")).alias("error"))
