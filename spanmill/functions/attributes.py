"""Columns read out of a span's attribute JSON, and the predicates that need them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

JSON = "raw_attributes_json"
# fixed values: attribute names of the semantic conventions, canonical spelling first
TTFT_KEYS = [
    ("gen_ai.response.time_to_first_chunk", 1.0),
    ("ai.response.msToFirstChunk", 1e-3),
    ("ai.stream.msToFirstChunk", 1e-3),
    ("time_to_first_token_ms", 1e-3),
    ("gen_ai.latency.time_to_first_token", 1.0),
]
PHASES = [
    ("queue", "gen_ai.latency.time_in_queue"),
    ("prefill", "gen_ai.latency.time_in_model_prefill"),
    ("decode", "gen_ai.latency.time_in_model_decode"),
    ("server", "gen_ai.latency.e2e"),
]
TOOL_NAME = ["gen_ai.tool.name", "tool.name", "ai.toolCall.name", "tool_name"]
TOOL_CALL_ID = ["gen_ai.tool.call.id", "tool_call.id", "ai.toolCall.id", "tool_use_id"]
TOOL_ARGUMENTS = ["gen_ai.tool.call.arguments", "ai.toolCall.args", "tool_input", "input.value"]
AGENT_NAME = ["gen_ai.agent.name", "agent.name"]
AGENT_ID = ["gen_ai.agent.id", "agent.id"]
COST_KEYS = ["llm.cost.total", "gen_ai.usage.cost"]


def attr(column: str | Column, key: str) -> Column:
    """An attribute as text: strings as they are, numbers and booleans as text, arrays and maps as JSON, absent or null NULL.

    The key is literal; dots in it are no path.
    """
    return F.get_json_object(column, "$['" + key.replace("'", "\\'") + "']")


def register(spark: SparkSession) -> None:
    """``attr(json, key)`` in SQL, for keys known only at run time."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION attr(j STRING, k STRING) RETURNS STRING RETURN from_json(j, 'map<string,string>', map('mode', 'PERMISSIVE'))[k]")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION strpos(s STRING, part STRING) RETURNS INT RETURN instr(s, part)")


def first_attr(keys: list[str], column: str = JSON) -> Column:
    return F.coalesce(*(attr(column, k) for k in keys))


def number(text: Column) -> Column:
    """A finite double, or NULL."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def ttft_seconds(column: str = JSON) -> Column:
    """Time to first token: the first key with a usable value, finite and not negative, in seconds."""
    usable = []
    for key, scale in TTFT_KEYS:
        value = number(attr(column, key))
        usable.append(F.when(value >= 0, value * scale))
    return F.coalesce(*usable)


def is_llm() -> Column:
    """Model calls: of kind LLM, or of no excluding kind with a model or request, response or usage attributes."""
    kind = F.upper("oi_kind")
    marked = [F.instr(F.col(JSON), f'"gen_ai.{part}.') > 0 for part in ("request", "response", "usage")]
    open_ = F.col("oi_kind").isNull() | ~kind.isin("AGENT", "CHAIN", "TOOL")
    return F.coalesce(kind == "LLM", F.lit(False)) | (open_ & (F.col("model").isNotNull() | marked[0] | marked[1] | marked[2]))


def duration_ns() -> Column:
    """End less start, never negative."""
    return F.greatest(F.col("end_unix_nano") - F.col("start_unix_nano"), F.lit(0).cast("long"))


def tool_failed() -> Column:
    return (F.col("status_code") == 2) | attr(JSON, "error.type").isNotNull()
