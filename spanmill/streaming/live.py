"""Structured Streaming: ingest, deduplication, usage counters, sampling and rolling state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanmill.functions.attributes import is_llm
from spanmill.operators.usage import series
from spanmill.schema import SPANS

JUDGE_SERVICE = "spanmill-judge"


def read_spans(spark: SparkSession, path: str, **options) -> DataFrame:
    """Spans as they land in a folder of Parquet files; rate limits are source options (maxFilesPerTrigger)."""
    return spark.readStream.schema(SPANS).options(**options).parquet(path)


def event_time(spans: DataFrame, delay: str = "1 hour") -> DataFrame:
    return spans.withColumn("event_time", F.timestamp_micros((F.col("start_unix_nano") / 1000).cast("long"))).withWatermark("event_time", delay)


def deduplicated(spans: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first copy of each span; copies more than ``delay`` apart both pass."""
    return event_time(spans, delay).dropDuplicatesWithinWatermark(["trace_id", "span_id"]).drop("event_time")


def usage_series(spans: DataFrame) -> DataFrame:
    """Running counters by provider, model and service (output mode update or complete)."""
    return series(spans)


def unit_hash() -> Column:
    """A span's place in [0, 1), the same whenever it is seen."""
    return F.shiftrightunsigned(F.xxhash64("trace_id", F.lit("/"), "span_id"), 11) / float(1 << 53)


def sampled(spans: DataFrame, rate: float, errors: bool = False, cost_over: float | None = None, services: list[str] = (), models: list[str] = ()) -> DataFrame:
    """Model calls to judge, with ``why``: always errors or costs if so set, others by hash."""
    rows = spans.where(is_llm() & ~F.coalesce(F.col("service_name") == JUDGE_SERVICE, F.lit(False)) & (F.col("output_value") != ""))
    rows = rows.where(F.col("service_name").isin(list(services))) if services else rows
    rows = rows.where(F.col("model").isin(list(models))) if models else rows
    why = F.when(F.lit(errors) & (F.col("status_code") == 2), "error")
    why = why.when(F.col("cost_usd") >= cost_over, "cost") if cost_over is not None else why
    return rows.withColumn("why", why.when(unit_hash() < rate, "rate")).where("why IS NOT NULL")


def write_batches(spans: DataFrame, path: str, checkpoint: str, transform=None):
    """Each micro-batch, transformed and deduplicated, appended by day and hour; run to the end of what is there."""
    from spanmill.operators.maintenance import partitioned

    def put(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(["trace_id", "span_id"])
        partitioned(transform(rows) if transform else rows).write.partitionBy("date", "hour").mode("append").parquet(path)

    return spans.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class DailyBudget(StatefulProcessor):
    """Passes a day's calls of a judge until its token budget is used; the rest are marked, not dropped."""

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0
        for pdf in rows:
            pdf = pdf.sort_values(["start_unix_nano", "span_id"])
            fits = []
            for tokens in pdf["tokens"]:
                ok = used + tokens <= self.budget
                used += tokens if ok else 0
                fits.append(ok)
            yield pd.DataFrame({"day": key[0], "span_id": pdf["span_id"], "tokens": pdf["tokens"], "within": fits})
        self.used.update((used,))

    def close(self) -> None:
        pass


def within_budget(spans: DataFrame, budget: int) -> DataFrame:
    """day, span_id, tokens, within: the day's token budget, kept in state (RocksDB provider)."""
    day = F.date_format(F.timestamp_micros((F.col("start_unix_nano") / 1000).cast("long")), "yyyy-MM-dd").alias("day")
    rows = spans.select(day, "span_id", "start_unix_nano", F.coalesce("total_tokens", F.lit(0)).cast("long").alias("tokens"))
    return rows.groupBy("day").transformWithStateInPandas(DailyBudget(budget), "day string, span_id string, tokens long, within boolean", "Append", "None")


class RollingMean(StatefulProcessor):
    """Mean of each evaluator's last values, in a bounded list."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "ts long, id string, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = list(self.last.get()) if self.last.exists() else []
        for pdf in rows:
            held += list(zip(pdf["ts_unix_nano"].tolist(), pdf["id"].tolist(), pdf["num_value"].tolist()))
        held = sorted(held)[-self.window :]
        self.last.put(held)
        yield pd.DataFrame({"name": [key[0]], "mean": [sum(h[2] for h in held) / len(held)], "n": [len(held)]})

    def close(self) -> None:
        pass


def rolling_scores(scores: DataFrame, window: int = 1024) -> DataFrame:
    rows = scores.where("target_type <> 'run' AND num_value IS NOT NULL AND NOT isnan(num_value)").select("name", "id", "ts_unix_nano", "num_value")
    return rows.groupBy("name").transformWithStateInPandas(RollingMean(window), "name string, mean double, n long", "Update", "None")
