"""Latency percentiles, time to first token and the server's share of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.attributes import JSON, PHASES, attr, duration_ns, is_llm, number, ttft_seconds
from spanmill.operators.ordered import in_ranges, with_before

DIMENSIONS = {"model": "model", "provider": "provider", "service": "service_name"}


def nearest_rank(value: str | Column, p: float) -> Column:
    """The value at rank ceil(p * n), at least 1; NULL over nothing. Exact, by a sort within the group's partial buffers."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def report(spans: DataFrame, by: str = "model") -> DataFrame:
    """Model calls by dimension: errors, p50, p95, p99 and greatest duration, and time to first token where known."""
    column = DIMENSIONS[by]
    calls = spans.where(is_llm()).select(F.col(column).alias("k"), "status_code", duration_ns().alias("ns"), (ttft_seconds() * 1e3).alias("ttft"))
    out = calls.groupBy("k").agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(F.col("status_code") == 2).alias("errors"), *(nearest_rank("ns", p).cast("long").alias(f"p{round(p * 100)}_ns") for p in (0.5, 0.95, 0.99)),
        F.max("ns").alias("max_ns"), F.count("ttft").alias("ttft_known"), *(nearest_rank("ttft", p).alias(f"ttft_p{round(p * 100)}_ms") for p in (0.5, 0.95)))
    return out.select(F.coalesce("k", F.lit("(untagged)")).alias("attribution"), *out.columns[1:]).orderBy(F.desc("spans"), "attribution")


def server_breakdown(spans: DataFrame) -> DataFrame:
    """Where served requests spend their time: phases by model, and the client's time less the server's, not negative."""
    served = spans.where((F.col("name") == "llm_request") & (F.col("otel_kind") == 2) & attr(JSON, PHASES[-1][1]).isNotNull())
    served = served.select("trace_id", F.col("parent_span_id").alias("up"), F.col("model").alias("own"), *((number(attr(JSON, key)) * 1e3).alias(name) for name, key in PHASES))
    client = spans.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("model").alias("theirs"), "start_unix_nano", "end_unix_nano", F.lit(True).alias("met"))
    both = served.join(client, (F.col("trace_id") == F.col("t")) & (F.col("up") == F.col("s")), "left")
    measured = F.col("end_unix_nano") >= F.col("start_unix_nano")
    gap = F.when(measured, F.greatest((F.col("end_unix_nano") - F.col("start_unix_nano")) / 1e6 - F.col("server"), F.lit(0.0)))
    both = both.select(F.coalesce("theirs", "own", F.lit("(unknown)")).alias("model"), *(name for name, _ in PHASES), F.col("met"), gap.alias("gap"))
    quantiles = [nearest_rank(c, p).alias(f"{c}_p{round(p * 100)}_ms") for c in [*(name for name, _ in PHASES), "gap"] for p in (0.5, 0.95)]
    return both.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.count("met").alias("parented"), *quantiles).orderBy(F.desc("calls"), "model")


def rolling_p95(spans: DataFrame, window: int = 100, least: int = 20, ranges: int | None = None) -> DataFrame:
    """p95 of each service's last ``window`` call durations at every call, once ``least`` are there; a service lies in many ranges of time."""
    by, order = "service_name", ["start_unix_nano", "span_id"]
    calls = in_ranges(spans.where(is_llm()).select(by, *order, duration_ns().alias("ns")), by, order, ranges)
    frame = Window.partitionBy(by, "range_").orderBy(*order).rowsBetween(-(window - 1), 0)
    last = with_before(calls, by, order, window - 1).withColumn("last", F.sort_array(F.collect_list("ns").over(frame))).where(~F.col("carried_"))
    p95 = F.when(F.size("last") >= least, F.element_at("last", F.ceil(F.size("last") * 0.95).cast("int")))
    return last.select(by, "span_id", p95.alias("p95_ns"))
