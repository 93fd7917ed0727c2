"""Topic summaries: prompts and a pluggable generator."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

# The prompt's frame and the longest description in it.
HEADER = "다음은 동일한 이슈를 다루는 여러 언론사의 뉴스 헤드라인과 간략한 설명입니다.\n\n[기사 목록]\n"
FOOTER = (
    "\n위 기사들이 다루는 이슈의 핵심을 1~2문장으로 팩트 중심으로 요약해주세요.\n"
    "언론사 성향 비교나 분석은 하지 말고, 공통된 사실만 간결하게 서술해주세요.\n"
    "한국어로 답변하고, 요약문만 출력해주세요. 다른 설명은 불필요합니다."
)
LONGEST = 120


class Summarizer(Protocol):
    """Makes a text from a prompt; ``model`` names what made it."""

    model: str

    def generate(self, prompt: str) -> str: ...


class Stub:
    """Answers every prompt with one fixed text."""

    model = "stub"

    def generate(self, prompt: str) -> str:
        return "[AI 요약 비활성화]"


class Fallback:
    """Asks generators in order until one answers with text."""

    def __init__(self, *generators: Summarizer):
        self.generators, self.model = generators, ""

    def generate(self, prompt: str) -> str:
        failure: Exception = ValueError("no generator")
        for g in self.generators:
            try:
                text = g.generate(prompt)
            except Exception as e:
                failure = e
                continue
            if text and text.strip():
                self.model = g.model
                return text
            failure = ValueError(f"{g.model} gave no text")
        raise failure


def shortened(x: Column) -> Column:
    """The first LONGEST UTF-16 units and an ellipsis if there are more; half a character at the cut is a question mark."""
    units = F.encode(x, "UTF-16BE")
    cut = F.substring(units, 1, 2 * LONGEST)
    halved = F.hex(F.substring(units, 2 * LONGEST - 1, 1)).between("D8", "DB")
    whole = F.when(halved, F.concat(F.decode(F.substring(units, 1, 2 * LONGEST - 2), "UTF-16BE"), F.lit("?"))).otherwise(F.decode(cut, "UTF-16BE"))
    return F.when(F.octet_length(units) > 2 * LONGEST, F.concat(whole, F.lit("…"))).otherwise(x)


def prompt_line(publisher: Column, headline: Column, description: Column) -> Column:
    short = shortened(description)
    return F.concat(F.lit("- ["), publisher, F.lit("] "), headline, F.when(is_blank(description), "").otherwise(F.concat(F.lit(" / "), short)), F.lit("\n"))


def prompts(topics: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """topic_id and prompt of every ACTIVE topic without a summary that has links, newest link first."""
    pending = topics.where("ai_summary IS NULL AND status = 'ACTIVE'").select(F.col("id").alias("topic_id"))
    a = articles.select(F.col("id").alias("article_id"), "publisher_name", "headline", "description")
    line = prompt_line(F.col("publisher_name"), F.col("headline"), F.col("description"))
    rows = links.join(pending, "topic_id", "left_semi").join(a, "article_id").select("topic_id", F.struct("linked_at", "article_id", line.alias("line")).alias("x"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("x"), asc=False), lambda x: x["line"]), "")
    return rows.groupBy("topic_id").agg(F.concat(F.lit(HEADER), body, F.lit(FOOTER)).alias("prompt"))


def summarize(asked: DataFrame, summarizer: Summarizer | None = None) -> DataFrame:
    """topic_id, ai_summary, ai_model and error of every prompt; a failure concerns its own row only."""
    make = summarizer or Stub()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for topic, prompt in zip(b["topic_id"], b["prompt"], strict=True):
                try:
                    out.append((topic, make.generate(prompt), make.model, None))
                except Exception as e:
                    out.append((topic, None, None, str(e)))
            yield pd.DataFrame(out, columns=["topic_id", "ai_summary", "ai_model", "error"])

    return asked.mapInPandas(run, "topic_id long, ai_summary string, ai_model string, error string")


def apply_summaries(topics: DataFrame, made: DataFrame, as_of: str) -> DataFrame:
    """Topics with their new summaries."""
    m = made.where("error IS NULL").select(F.col("topic_id").alias("id"), F.col("ai_summary").alias("new"), F.col("ai_model").alias("model"))
    now = F.lit(as_of).cast("timestamp_ntz")
    return (
        topics.join(m, "id", "left").withColumn("ai_summary", F.coalesce("new", "ai_summary")).withColumn("ai_model", F.coalesce("model", "ai_model"))
        .withColumn("summary_generated_at", F.when(F.col("new").isNotNull(), now).otherwise(F.col("summary_generated_at"))).select(topics.columns)
    )
