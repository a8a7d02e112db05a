"""Joins of spans and scores, and the relational surface that Spark brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored_spans(spans: DataFrame, scores: DataFrame) -> DataFrame:
    return scores.where("target_type = 'span'").join(spans, F.col("target_id") == F.col("span_id"))


def mean_by_model(spans: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score by model and name: scores meet only the two columns of spans that are needed."""
    named = scored_spans(spans.select("span_id", "model"), scores.select("target_id", "target_type", F.col("name").alias("score"), "num_value"))
    return named.groupBy("model", "score").agg(F.avg("num_value").alias("mean"), F.count("num_value").alias("n"))


def parent_child(spans: DataFrame) -> DataFrame:
    """Kind of parent and child, with the number of such pairs."""
    child = spans.select("trace_id", F.col("parent_span_id").alias("span_id"), F.col("oi_kind").alias("child"))
    return child.join(spans.select("trace_id", "span_id", F.col("oi_kind").alias("parent")), ["trace_id", "span_id"]).groupBy("parent", "child").agg(F.count(F.lit(1)).alias("pairs"))


def language_tax(answers: DataFrame) -> DataFrame:
    """lang, model, text, tokens: answers, characters, tokens, tokens per character, and the ratio to the same model's English."""
    rate = F.sum("tokens") / F.sum(F.char_length("text"))
    rows = answers.where("lang IS NOT NULL").groupBy("lang", "model").agg(F.count(F.lit(1)).alias("answers"), F.sum(F.char_length("text")).alias("chars"), F.sum("tokens").alias("tokens"), rate.alias("tokens_per_char"))
    english = rows.where("lang = 'en'").select(F.col("model").alias("m"), F.col("tokens_per_char").alias("base"))
    return rows.join(english, F.col("model").eqNullSafe(F.col("m")), "left").select("lang", "model", "answers", "chars", "tokens", "tokens_per_char", (F.col("tokens_per_char") / F.col("base")).alias("vs_english"))
