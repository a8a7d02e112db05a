"""Cost attribution and re-pricing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.attributes import COST_KEYS, JSON, is_llm
from spanmill.operators import pricing

DIMENSIONS = {"model": "model", "user": "user_id", "session": "session_id", "service": "service_name", "provider": "provider"}
UNTAGGED = "(untagged)"


def _label(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(UNTAGGED)).alias("attribution")


def attribution(spans: DataFrame, by: str = "model") -> DataFrame:
    """Spans, tokens, cost and spans without a cost by dimension; groups are of the raw value, NULL is labelled after."""
    column = DIMENSIONS[by]
    rows = spans.groupBy(column).agg(
        F.count(F.lit(1)).alias("spans"), F.sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("missing_cost"))
    return rows.select(_label(column), "spans", "tokens", "cost_usd", "missing_cost").orderBy(F.desc_nulls_last("cost_usd"), F.desc("spans"), "attribution")


def grand_total(spans: DataFrame, by: str = "model") -> DataFrame:
    """One row of totals and the number of groups, NULL counted as one."""
    column = F.col(DIMENSIONS[by])
    return spans.agg(
        F.count(F.lit(1)).alias("spans"), F.sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("missing_cost"),
        (F.countDistinct(column) + F.max(column.isNull().cast("long"))).alias("groups"))


def usage_shapes(spans: DataFrame, by: str = "model") -> DataFrame:
    """One row per distinct usage (dimension, model, counts, cost and how they are to be read) with its number of spans."""
    reported = F.lit(False)
    for key in COST_KEYS:
        reported = reported | F.contains(F.col(JSON), F.lit(f'"{key}":'))
    basis = lambda word: F.col(JSON).like(f'%"spanmill.cost.basis":"%{word}%').cast("int")
    return spans.groupBy(
        F.col(DIMENSIONS[by]).alias("attribution"), "model", *pricing.COUNTS, "cost_usd", (F.col("cost_usd").isNotNull() & ~reported).cast("int").alias("derived"),
        basis("cache_excl").alias("cache_excl"), basis("reasoning_add").alias("reasoning_add")).agg(F.count(F.lit(1)).alias("n"))


def _basis() -> Column:
    """As recorded where the cost was derived, else worked out; a total that is only prompt + completion is no evidence."""
    told = F.struct((F.col("cache_excl") == 1).alias("cache_excl"), (F.col("reasoning_add") == 1).alias("reasoning_add"))
    real = F.when(F.col("total_tokens").eqNullSafe(F.col("prompt_tokens") + F.col("completion_tokens")), None).otherwise(F.col("total_tokens"))
    return F.when(F.col("derived") == 1, told).otherwise(pricing.detect_basis(real))


def reprice(spans: DataFrame, prices: dict, by: str = "model") -> DataFrame:
    """Attribution with reported costs kept and all others derived again; a TOTAL row carries the number of groups."""
    shapes = pricing.with_price(usage_shapes(spans, by), prices)
    countable = F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull()
    derived = F.when(countable & F.col("price").isNotNull(), pricing.price_tokens(_basis()))
    cost = F.when(F.col("cost_usd").isNotNull() & (F.col("derived") == 0), F.col("cost_usd")).otherwise(derived)
    priced = shapes.withColumn("cost", cost)
    exact = F.round(F.col("cost") * 1e12).cast("decimal(20,0)") * F.col("n").cast("decimal(17,0)")  # sums of doubles depend on their order
    sums = [
        F.sum("n").alias("spans"), F.sum(F.coalesce("total_tokens", F.lit(0)) * F.col("n")).alias("tokens"), (F.sum(exact).cast("double") / 1e12).alias("cost_usd"),
        F.coalesce(F.sum(F.when(F.col("cost").isNull(), F.col("n"))), F.lit(0)).alias("missing_cost")]
    groups = priced.groupBy(_label("attribution")).agg(*sums).withColumn("groups", F.lit(None).cast("long"))
    total = priced.agg(*sums, (F.countDistinct("attribution") + F.max(F.col("attribution").isNull().cast("long"))).alias("groups")).withColumn("attribution", F.lit("TOTAL"))
    return groups.unionByName(total)


def reprice_as(spans: DataFrame, prices: dict, hosted: str, by: str = "model", models: list[str] | None = None) -> DataFrame:
    """Model calls' stored cost beside what they would cost as ``hosted``; TOTAL is a row of its own."""
    key = pricing.lookup(hosted, prices)
    if key is None:
        raise ValueError(f"{hosted!r} is not in the price table")
    calls = spans.where(is_llm()) if not models else spans.where(is_llm() & F.col("model").isin(models))
    shapes = usage_shapes(calls, by).withColumn("price", pricing.price_literal(prices[key]))
    countable = F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull()
    priced = shapes.withColumn("hosted", F.when(countable, pricing.price_tokens(_basis())))
    n = F.col("n")
    sums = [
        F.sum(n).alias("calls"), F.sum(F.coalesce("total_tokens", F.lit(0)) * n).alias("tokens"), F.sum(F.col("cost_usd") * n).alias("cost_usd"),
        F.coalesce(F.sum(F.when(F.col("cost_usd").isNull(), n)), F.lit(0)).alias("missing_cost"), F.coalesce(F.sum(F.col("hosted") * n), F.lit(0.0)).alias("as_hosted_usd"),
        F.coalesce(F.sum(F.when(F.col("hosted").isNull(), n)), F.lit(0)).alias("no_tokens")]
    return priced.groupBy(_label("attribution")).agg(*sums).unionByName(priced.agg(*sums).withColumn("attribution", F.lit("TOTAL")))


def gpu_rate(spans: DataFrame, models: list[str], window_ns: int, now_ns: int, gpus: int, gpu_hour_usd: float, output_ratio: float = 4.0) -> DataFrame:
    """What a token costs on own GPUs: their cost over the window, spread over input and weighted output tokens."""
    if not models or gpus < 1 or gpu_hour_usd <= 0 or output_ratio <= 0 or window_ns <= 0:
        raise ValueError("models, gpus, gpu_hour_usd, output_ratio and the window must be positive")
    used = spans.where(is_llm() & F.col("model").isin(models) & (F.col("start_unix_nano") >= max(0, now_ns - window_ns)))
    one = used.agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("output_tokens"),
        F.min("start_unix_nano").alias("first"), F.max("end_unix_nano").alias("last"))
    cost = gpus * (window_ns / 3.6e12) * gpu_hour_usd
    weighted = F.col("input_tokens") + output_ratio * F.col("output_tokens")
    coverage = F.when(F.col("last") > F.col("first"), F.least((F.col("last") - F.col("first")) / float(window_ns), F.lit(1.0))).otherwise(0.0)
    return one.select(
        "calls", "input_tokens", "output_tokens", F.lit(cost).alias("gpu_cost_usd"), coverage.alias("coverage"),
        F.when(weighted > 0, cost / weighted).alias("input_per_token"), F.when(weighted > 0, cost / weighted * output_ratio).alias("output_per_token"))
