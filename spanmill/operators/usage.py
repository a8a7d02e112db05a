"""Usage series, histograms, tool counters and egress, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.attributes import JSON, TOOL_NAME, attr, duration_ns, first_attr, is_llm, tool_failed, ttft_seconds

BOUNDS = [0.01 * 2**k for k in range(16)]
EGRESS_SERVICE = "spanmill-egress"


def _labels():
    return [F.coalesce(F.col(c), F.lit("unknown")).alias(k) for c, k in (("provider", "provider"), ("model", "model"), ("service_name", "service"))]


def series(spans: DataFrame) -> DataFrame:
    """Counters of model calls by provider, model and service."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return spans.where(is_llm()).groupBy(*_labels()).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status_code") == 2).alias("errors"), zero("prompt_tokens").alias("input_tokens"), zero("completion_tokens").alias("output_tokens"),
        zero("cache_read_tokens").alias("cache_read_tokens"), zero("cache_write_tokens").alias("cache_write_tokens"), zero("reasoning_tokens").alias("reasoning_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced"))


def histogram(spans: DataFrame, what: str = "latency") -> DataFrame:
    """Cumulative counts of model calls' latency or time to first token below each bound, with sum and count."""
    seconds = duration_ns() / 1e9 if what == "latency" else ttft_seconds()
    rows = spans.where(is_llm()).select(*_labels(), seconds.alias("v")).where("v IS NOT NULL")
    return rows.groupBy("provider", "model", "service").agg(*(F.count_if(F.col("v") <= b).alias(f"le_{k:02}") for k, b in enumerate(BOUNDS)), F.count("v").alias("n"), F.sum("v").alias("total"))


def tools(spans: DataFrame) -> DataFrame:
    rows = spans.where(F.upper("oi_kind") == "TOOL")
    return rows.groupBy(F.coalesce(first_attr(TOOL_NAME), F.col("name")).alias("tool"), F.coalesce("service_name", F.lit("unknown")).alias("service")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.coalesce(tool_failed(), F.lit(False))).alias("errors"))


def rolling_scores(scores: DataFrame, window: int = 1024, names: int = 64) -> DataFrame:
    """Mean of each evaluator's last ``window`` finite scores, runs' own left out, for the first ``names`` evaluators."""
    rows = scores.where("target_type <> 'run' AND num_value IS NOT NULL AND NOT isnan(num_value) AND NOT startswith(id, 'run:agg:')")
    newest = lambda *by: Window.partitionBy(*by).orderBy(F.desc("ts_unix_nano"), F.desc("id"))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))  # a hot name is cut off in 64 parts before it meets
    some = parts.withColumn("rn", F.row_number().over(newest("name", "part"))).where(F.col("rn") <= window).drop("part")
    last = some.withColumn("rn", F.row_number().over(newest("name"))).where(F.col("rn") <= window)
    return last.groupBy("name").agg(F.avg("num_value").alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("name").limit(names)


def egress(spans: DataFrame, since_ns: int = 0) -> DataFrame:
    """Where data went: calls, refusals, errors and bytes by host, address, jurisdiction and purpose."""
    text = lambda key: F.coalesce(attr(JSON, key), F.lit("-"))
    bytes_ = lambda key: F.coalesce(attr(JSON, key).try_cast("long"), F.lit(0))
    rows = spans.where((F.col("service_name") == EGRESS_SERVICE) & (F.col("start_unix_nano") >= since_ns)).select(
        text("server.address").alias("host"), text("network.peer.address").alias("ip"), text("spanmill.egress.jurisdiction").alias("jurisdiction"), text("spanmill.egress.purpose").alias("purpose"),
        text("spanmill.egress.outcome").alias("outcome"), bytes_("spanmill.egress.bytes_out").alias("bytes_out"), bytes_("spanmill.egress.bytes_in").alias("bytes_in"), "start_unix_nano")
    return rows.groupBy("host", "ip", "jurisdiction", "purpose").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("outcome") == "refused").alias("refused"), F.count_if(F.col("outcome") == "error").alias("errors"), F.sum("bytes_out").alias("bytes_out"),
        F.sum("bytes_in").alias("bytes_in"), F.min("start_unix_nano").alias("first"), F.max("start_unix_nano").alias("last")).orderBy(F.desc("bytes_out"), F.desc("calls"))


def bounded(spans: DataFrame, providers: int = 16, models: int = 100, services: int = 32) -> DataFrame:
    """The series with each label's values after the first seen so many folded into ``other``."""
    out = spans.where(is_llm()).select(*_labels(), "start_unix_nano", "span_id", "total_tokens")
    for label, most in (("provider", providers), ("model", models), ("service", services)):
        first = out.groupBy(label).agg(F.min(F.struct("start_unix_nano", "span_id")).alias("seen")).orderBy("seen").limit(most).select(F.col(label).alias("known"))
        out = out.join(first, F.col(label) == F.col("known"), "left").withColumn(label, F.coalesce("known", F.lit("other"))).drop("known")
    return out.groupBy("provider", "model", "service").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))
