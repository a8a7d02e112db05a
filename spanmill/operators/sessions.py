"""Session rollups: usage, model and tool calls, nested tool spans, repeats and loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.attributes import AGENT_NAME, TOOL_ARGUMENTS, TOOL_CALL_ID, TOOL_NAME, first_attr, tool_failed
from spanmill.operators.traces import forest
from spanmill.plans.scratch import save

LOOP_RUN = 3
TOKENS = ["prompt_tokens", "completion_tokens", "total_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]


def base(spans: DataFrame) -> DataFrame:
    """Spans, traces, cost, tokens, times and model calls by session."""
    kind = F.upper("oi_kind")
    return spans.where("session_id IS NOT NULL").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("span_count"), F.countDistinct("trace_id").alias("trace_count"), F.sum("cost_usd").alias("cost_usd"), *(F.sum(c).alias(c) for c in TOKENS),
        F.min("start_unix_nano").alias("start_unix_nano"), F.max("end_unix_nano").alias("end_unix_nano"), F.count_if(kind == "LLM").alias("llm_calls"),
        F.count_if((kind == "LLM") & (F.col("status_code") == 2)).alias("llm_errors"), F.array_sort(F.collect_set(F.when(kind == "LLM", F.col("model")))).alias("models"),
        F.array_sort(F.collect_set(first_attr(AGENT_NAME))).alias("agents"))


def tool_calls(spans: DataFrame) -> DataFrame:
    """One row per tool call of a session: copies with one call id merged, unnamed nested spans folded into their outermost namesake.

    Calls that are each other's parents fold into the one with the smallest key.
    """
    tools = spans.where("session_id IS NOT NULL AND upper(oi_kind) = 'TOOL'")
    call_id = first_attr(TOOL_CALL_ID)
    key = F.coalesce(F.concat(F.lit("id:"), call_id), F.concat(F.lit("span:"), "trace_id", F.lit(":"), "span_id"))
    rows = tools.select("session_id", key.alias("call"), "trace_id", "span_id", "parent_span_id", "name", "start_unix_nano", call_id.isNotNull().alias("by_id"), first_attr(TOOL_NAME).alias("named"), first_attr(TOOL_ARGUMENTS).alias("arguments"), F.coalesce(tool_failed(), F.lit(False)).alias("failed"))
    order = F.struct("start_unix_nano", "trace_id", "span_id")
    first = lambda c: F.min_by(F.col(c), order)
    known = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("start_unix_nano", "trace_id", "span_id", F.col(c).alias("v"))))["v"]
    calls = rows.groupBy("session_id", "call").agg(
        first("trace_id").alias("trace_id"), first("span_id").alias("span_id"), first("parent_span_id").alias("parent"), F.coalesce(known("named"), first("name")).alias("name"),
        F.min("start_unix_nano").alias("start"), known("arguments").alias("arguments"), F.bool_or("failed").alias("failed"), F.bool_or("by_id").alias("by_id"))
    calls = save(calls, "tool-calls")
    up = calls.select(F.col("session_id").alias("s2"), F.col("trace_id").alias("t2"), F.col("span_id").alias("p2"), F.col("name").alias("n2"), F.col("call").alias("up"))
    met = (F.col("session_id") == F.col("s2")) & (F.col("trace_id") == F.col("t2")) & (F.col("parent") == F.col("p2")) & (F.col("name") == F.col("n2")) & (F.col("call") != F.col("up"))
    into = calls.join(up, met, "left").select(F.col("session_id").alias("trace_id"), F.col("call").alias("span_id"), F.col("up").alias("parent_span_id"), F.col("start").alias("start_unix_nano"))
    into = forest(into).where("up IS NOT NULL").select(F.col("trace_id").alias("session_id"), F.col("span_id").alias("call"), "up")  # cycles are cut
    into = save(into, "tool-up")
    while True:  # doubling: each round leads twice as far up
        other = into.select(F.col("session_id").alias("s2"), F.col("call").alias("c2"), F.col("up").alias("next"))
        step = into.join(other, (F.col("session_id") == F.col("s2")) & (F.col("up") == F.col("c2")), "left")
        if step.where("next IS NOT NULL").isEmpty():
            break
        into = save(step.select("session_id", "call", F.coalesce("next", "up").alias("up")), "tool-up")
    moved = calls.where("NOT by_id").join(into, ["session_id", "call"]).select("session_id", "call", "up", "failed")
    blame = moved.groupBy("session_id", F.col("up").alias("call")).agg(F.bool_or("failed").alias("below"))
    kept = calls.join(moved.select("session_id", "call"), ["session_id", "call"], "left_anti").join(blame, ["session_id", "call"], "left")
    return kept.withColumn("failed", F.col("failed") | F.coalesce("below", F.lit(False))).drop("below", "parent")


def repeats(calls: DataFrame) -> DataFrame:
    """Calls equal to the one before in their trace (same name, same known arguments) and the longest run, by session."""
    order = Window.partitionBy("session_id", "trace_id").orderBy("start", "span_id")
    same = (F.lag("name").over(order) == F.col("name")) & (F.lag("arguments").over(order) == F.col("arguments"))
    marked = calls.withColumn("same", F.coalesce(same, F.lit(False)))
    islands = marked.withColumn("island", F.sum((~F.col("same")).cast("int")).over(order))
    runs = islands.groupBy("session_id", "trace_id", "island").agg(F.count(F.lit(1)).alias("run"), F.count_if("same").alias("again"), F.bool_or(F.col("arguments").isNotNull()).alias("known"))
    return runs.groupBy("session_id").agg(F.sum("again").alias("repeated_tool_calls"), F.max(F.when(F.col("known"), F.col("run")).otherwise(0)).alias("longest_repeat_run"))


def rollup(spans: DataFrame) -> DataFrame:
    """One row per session, newest first."""
    calls = save(tool_calls(spans), "session-calls")
    hist = calls.groupBy("session_id", "name").agg(F.count(F.lit(1)).alias("k"), F.count_if("failed").alias("bad"))
    per = hist.groupBy("session_id").agg(F.sum("k").alias("tool_calls"), F.sum("bad").alias("tool_errors"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "k")))).alias("tools"))
    own = base(spans)
    out = own.join(per, "session_id", "left").join(repeats(calls), "session_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = out.select(
        *own.columns, zero("tool_calls"), zero("tool_errors"), F.coalesce("tools", F.create_map().cast("map<string,bigint>")).alias("tools"), zero("repeated_tool_calls"), zero("longest_repeat_run"),
        (F.col("llm_calls") / F.col("trace_count")).alias("steps_per_trace"), (F.col("tool_errors") / F.col("tool_calls")).alias("tool_error_rate"),
        (F.coalesce("longest_repeat_run", F.lit(0)) >= LOOP_RUN).alias("loop_suspected"))
    return out.orderBy(F.desc("end_unix_nano"), "session_id")
